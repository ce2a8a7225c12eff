"""A store of versioned snapshots on plain files: nothing is updated in place, nothing is lost.

Each table is a folder of snapshots ``v=<n>`` with a ledger of what was written. A writer makes a
new snapshot from the last one and the new rows; readers see the newest complete one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        """Numbers of the complete snapshots, oldest first: those whose write left its success mark."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._fs(f"{self.root}/{table}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        known = self.versions(table)
        if not known or version is not None and version not in known:
            return None
        return self.spark.read.parquet(f"{self.root}/{table}/v={known[-1] if version is None else version}")

    def write(self, table: str, rows: DataFrame) -> int:
        """A new snapshot; its number."""
        version = (self.versions(table) or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/v={version}")
        return version

    def upsert(self, table: str, new: DataFrame, keys: list[str], kept: str | None = None) -> int:
        """New rows replace those of the same key; ``kept`` (an id) stays what it was first. A full join, so both sides are read once."""
        old = self.read(table)
        if old is None:
            return self.write(table, new)
        rest = [c for c in new.columns if c not in keys]
        a = old.select(*keys, F.struct(*rest).alias("_old"))
        b = new.select(*keys, F.struct(*rest).alias("_new"))
        one = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c == kept else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        return self.write(table, a.join(b, keys, "full").select(*keys, *(one(c).alias(c) for c in rest)))

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows to a history that only grows."""
        rows.write.mode("append").parquet(f"{self.root}/{table}-history")

    def history(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}-history")

    def difference(self, table: str, keys: list[str], old: int, new: int) -> DataFrame:
        """(keys, change): ADDED, REMOVED or CHANGED between two snapshots."""
        a, b = self.read(table, old), self.read(table, new)
        rest = [c for c in b.columns if c not in keys]
        both = a.select(*keys, F.struct(*rest).alias("_a")).join(b.select(*keys, F.struct(*rest).alias("_b")), keys, "full")
        change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
        return both.select(*keys, change.alias("change")).filter("change is not null")
