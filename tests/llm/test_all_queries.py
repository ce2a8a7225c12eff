"""All queries of the training-data operators on the smallest tables, where these are there."""

import glob
import os

import pytest
from ledgerloom.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["id", "region_id"], "p2_found": ["id", "engineering_project_id"], "p3_found": ["id", "pii_kind", "pii_value"], "p4_found": ["id", "field_name"], "p5_found": ["id_a", "id_b"],
    "p6_found": ["spelling_a", "spelling_b"], "p7_found": ["id", "line_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}
TYPES = {"id": "bigint", "region_id": "int", "engineering_project_id": "bigint", "line_no": "int", "doc_id": "bigint", "ids": "array<int>", "id_a": "bigint", "id_b": "bigint"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    got = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and all(t == TYPES.get(c, "string") for c, t in df.dtypes)
        assert got and len(set(map(str, got))) == len(got)
    if sql := registry.oracle_sql().get(name):
        import duckdb

        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        cols = ", ".join(sorted(df.columns))
        want = con.execute(f"SELECT {cols} FROM ({sql})").fetchall()
        assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in got), key=str) == sorted(want, key=str)
