"""The corpus pipeline: quality, toxicity, near-duplicates, contamination, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again as the next one's docs. All
but the last return the columns of documents. Documents go by their doc_id; rows that share one share its fate in the
stages that decide by pairs. An empty or null text stays where a stage finds nothing against it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake.llm import decontaminate, neardup, pieces, quality, toxicity
from orbitlake.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of low quality; the model is learnt from the labels of the whole table."""
    model = quality.model_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.with_scores(docs.select(*COLUMNS), model).where("score >= 0.3").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents."""
    model = toxicity.model_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, nulls last; of rows with one doc_id, one."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain a benchmark item."""
    found = decontaminate.contaminations(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    d = docs.select(*COLUMNS)
    return d.join(found, d["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: Model scores and best paths can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
