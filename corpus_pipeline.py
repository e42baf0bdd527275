"""The corpus pipeline: documents through quality rules, near-dedup, decontamination, PII and packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from karakuri.llm.common import removed, shared_folder, table
from karakuri.llm.decontaminate import decontamination_stage
from karakuri.llm.near_copies import near_copy_stage
from karakuri.llm.packing import packing_stage
from karakuri.llm.pii import pii_stage
from karakuri.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: Fingerprints, hashed n-grams and the conditional random field can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written as Parquet to the shared folder and reread. A stage's
    folder goes once the next one's is written; the last one stays, as the rows returned are read from it."""
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", []
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}_{name}")
        docs = spark.read.parquet(path)
        removed(spark, *before)
        before = [path]
    return docs
