"""Observations as a stream: daily counts with a watermark, and change flags with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpointed


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors share."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path as a stream; a folder of files or a single file."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*")


def daily_counts(observations: DataFrame, delay: str | None = "3650 days") -> DataFrame:
    """(source_id, day, n, first_seen, changed) by event time; rows later than the delay are dropped, null for no limit."""
    at = observations.withColumn("ts", F.col("observed_at").cast("timestamp"))
    at = at.withWatermark("ts", delay) if delay else at
    agg = at.groupBy("source_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("is_first_seen").alias("first_seen"), F.sum("content_changed").alias("changed"))
    return agg.select("source_id", F.to_date("w.start").alias("day"), "n", "first_seen", "changed")


def _flags(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_run, last = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values(["run_id", "id"])
    out = []
    for r in rows.itertuples(index=False):
        if last_run is None or r.run_id > last_run:
            out.append((r.id, r.run_id, key[0], last_run is None, last_run is not None and r.content_hash != last))
            last_run, last = r.run_id, r.content_hash
    state.update((last_run, last))
    yield pd.DataFrame(out, columns=["id", "run_id", "notice_id", "is_first", "is_changed"])


def change_flags(observations: DataFrame) -> DataFrame:
    """(id, run_id, notice_id, is_first, is_changed): each notice's state is its last run and content.

    Within a micro-batch rows are taken in order of run; a row of a run already passed is ignored.
    """
    return observations.groupBy("notice_id").applyInPandasWithState(_flags, "id long, run_id long, notice_id long, is_first boolean, is_changed boolean", "run_id long, content_hash string", "append", GroupStateTimeout.NoTimeout)


def run_all(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there now and give its result as a table; state and output lie in the shared folder."""
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")
