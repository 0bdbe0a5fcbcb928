"""Corpus pipeline: quality rules, one document of each near-duplicate group, passage dedup,
benchmark decontamination, packing into token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet under
the shared folder and reads again as the next stage's documents. All stages but the last return the
columns of documents. Near duplicates are stage 2: components of the Jaccard join, of which the
document with the smallest id stays. Stage 3 cuts repeated passages out of texts and keeps every row.

Null and empty texts, and texts under 50 words, fail the quality rules and go in stage 1; a null id or
language is a value like any other; texts of any length are read whole. Of repeated rows one stays (stage
2). An empty table passes through all stages. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup
from footfall.llm.common import work_dir
from footfall.llm.queries import PACKING, byte_bpe, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe(), **PACKING)


STAGES = [("quality_rules", rules), ("jaccard_join", near_duplicates), ("suffix_dedup", passages),
          ("decontamination", decontamination), ("packing", sequences)]

# Perplexity bands, edit distances and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
