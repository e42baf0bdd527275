"""Where results go: memos as text files, payload-free app events as an appended table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.plans import dims


def write_memos(memos: DataFrame, path: str, key: str) -> None:
    """One folder for each inspection with its memo as text."""
    memos.select(key, F.col("memo").alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def app_events(events: DataFrame, host: str) -> DataFrame:
    """(event_name, ts) of the known events on one host; nothing else about them is kept."""
    return events.where((F.col("host") == host) & F.col("event_name").isin(dims.APP_EVENTS)).select("event_name", "ts")


def append_events(events: DataFrame, path: str, host: str) -> None:
    app_events(events, host).write.mode("append").parquet(path)
