"""Queries that run as streams over what is there, held against their batch counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import observations as S
from . import tracking


def stream_business_days(spark: SparkSession, d: str) -> DataFrame:
    return S.run_all(S.daily_counts(S.read(spark, f"{d}/notice_observation.parquet")), "complete", "business-days")


def stream_cdc_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = S.read(spark, f"{d}/notice_observation.parquet").select("id", "run_id", "notice_id", "content_hash")
    return S.run_all(S.change_flags(rows), "append", "cdc-flags")


QUERIES = {f.__name__: f for f in (stream_business_days, stream_cdc_flags)}
SQL = {"stream_business_days": tracking.SQL["business_day_counts"], "stream_cdc_flags": tracking.SQL["cdc_flags"]}
