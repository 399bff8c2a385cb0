"""A corpus made ready for training, stage by stage: each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

An empty table gives an empty result at every stage. Columns beside those of documents are carried through all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import free_prefix, load, settle, settle_table, small
from quire.llm.mixing import mixed_rows
from quire.llm.near_dedup import near_duplicates
from quire.llm.packing import pack
from quire.llm.pii import key_of, replace
from quire.llm.quality_rules import judge


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts, texts that repeat themselves, and outliers. Repeated rows are judged alike."""
    prefix = free_prefix("rules__", docs.columns)
    return judge(docs, carry=list(docs.columns), prefix=prefix).where(f"{prefix}kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id, with all rows of that id. Rows without an id or without words stay."""
    found = near_duplicates(docs)
    gone = settle(found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("doc_id")).distinct())
    kept = docs.join(small(gone), "doc_id", "left_anti")
    return kept.select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text. A null text stays null, with null n_chars."""
    return replace(docs, key_of(spark), count=free_prefix("pii_entities", docs.columns)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; rows without words go, a null source is a source of its own."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, one row a piece, with the ids. A null text is the closing id alone."""
    return pack(docs, keep_ids=True)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("personal data", pii), ("mixing", mixing), ("packing", packing)]

#: Estimates by concentration steps, components and tokenization have no SQL of bearable length; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle_table(stage(spark, docs, sf_dir))
    return docs
