"""A corpus in five stages: toxic documents go, boilerplate lines go, one document of each class of near duplicates
stays, contaminated documents go, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
documents of the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import op3_line_dedup, op4_toxicity, op6_packing, op7_decontamination, op10_jaccard_join
from textloom.llm.common import dropped, stored, table, with_settings


#: Texts are long, and all stages share the executors' memory: fewer rows in a batch for Python workers.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = with_settings(docs, **SMALL)
    return op4_toxicity.reject(docs, op4_toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_line_dedup.drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_jaccard_join.deduplicate(with_settings(docs, **SMALL))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_decontamination.decontaminate(with_settings(docs, **SMALL), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids: what a model is trained on."""
    # other stages share the workers: remember fewer words, and none when a task is done
    return op6_packing.pack(with_settings(docs, **SMALL), op6_packing.tokenizer_file(), cache_words=100_000, idle_words=0, lean=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Packing depends on a tokenizer, which SQL cannot state; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}", spark)
        dropped(before)
    return docs
