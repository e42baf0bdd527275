"""Utterances as a stream: each batch is parsed, logged and folded into the items as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karakuri.operators import fold, parse
from karakuri.sources.json_store import iso_time

SCHEMA = "inspection_id string, uid bigint, alternatives array<string>"
LOG = "inspection_id string, uid bigint, alt int, raw string, score bigint, ord int, matched boolean, item_id string, match_type string, status string, front_rear string, left_right string, inner_outer string, value double, co double, hc double, note string, custom_name string"
ITEMS = "inspection_id string, item_id string, status string, front_rear string, left_right string, inner_outer string, value double, measurements map<string, double>, note string, updated_at string"


def read(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of recognition results: one final result a row, its alternatives best first."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the name=number folders in a folder; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.partition("=")[2]) for n in names if "=" in n)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(c.split()[0]).cast(c.partition(" ")[2]) for c in schema.replace("map<string, double>", "map<string,double>").split(", ")))


def start(stream: DataFrame, log: str, checkpoint: str, state: str | None = None, **trigger):
    """Parse the stream into the log, a folder for each batch, and fold each batch into state, the items as they stand,
    a folder for each version. A batch that runs again overwrites its own folders and starts from the version before it,
    and an utterance that was delivered before, in this batch or an earlier one, is left out: each counts once. Log and
    state are all there is, so they survive the loss of any executor."""

    def keep(batch: DataFrame, number: int) -> None:
        spark, key = batch.sparkSession, ["inspection_id", "uid"]
        batch = batch.dropDuplicates(key)
        if any(n < number for n in _versions(spark, log)):
            batch = batch.join(logged(spark, log).where(F.col("batch") < number).select(*key).distinct(), key, "left_anti")
        _typed(parse.choose_best(batch, *key), LOG).write.mode("overwrite").parquet(f"{log}/batch={number}")
        if state:
            before = [n for n in _versions(spark, state) if n < number]
            held = spark.read.schema(ITEMS).parquet(f"{state}/version={before[-1]}") if before else spark.createDataFrame([], ITEMS)
            fresh = spark.read.schema(LOG).parquet(f"{log}/batch={number}")
            now = iso_time(F.unix_millis(F.current_timestamp()))
            _typed(fold.applied(held, fresh, "inspection_id", now=now, only_stored=False), ITEMS).write.mode("overwrite").parquet(f"{state}/version={number}")
            for old in before[:-1]:  # the one before stays, should this batch run again
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/version={old}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def logged(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG + ", batch bigint").parquet(log)


def current(spark: SparkSession, log: str) -> DataFrame:
    """Every inspection's items as of the last batch, folded from the whole log."""
    return fold.snapshot(logged(spark, log), "inspection_id")


def items(spark: SparkSession, state: str) -> DataFrame:
    """Every inspection's items as of the last batch, from the state: no history is read."""
    return spark.read.schema(ITEMS).parquet(f"{state}/version={_versions(spark, state)[-1]}")


def queue(spark: SparkSession, log: str) -> DataFrame:
    return fold.unmatched_queue(logged(spark, log), "inspection_id")
