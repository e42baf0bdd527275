"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karakuri.sources.tables import table  # noqa: F401  the operators' queries read with it

#: Runs of the white space that separates words, as a regular expression for the JVM and for Python.
SPACE = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. Only on one machine (master local[...]), where every folder is
    shared, one is made if none is named; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="karakuri-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text) -> F.Column:
    """The words of a text: maximal runs without white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and where it is."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that written() made and nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files go as soon as the query that wrote them has ended, where Spark has that setting."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """df.where(condition), without the optimiser moving the filter below the columns that it reads.

    Moved, it would compute their expressions a second time, and nested ones many times. A filter on what an outer
    explode makes stays where it is.
    """
    return df.withColumn("_one", F.explode_outer(F.when(F.expr(condition), F.array(F.lit(True))))).where("_one IS NOT NULL").drop("_one")
