"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import settled_table, shared_folder

#: White space is space and U+0009 to U+000D, and a word is a run of anything else.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the shared folder; Spark's cleaner removes the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """As settle(), but as Parquet, for wide rows that are read column by column; the files go with the session."""
    return settled_table(df)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is computed inside, where rows are large on both sides of the border to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner see what is no longer referenced, so that shuffle files and checkpoints of finished rounds go; else they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Mark a settled df for broadcasting if its counted rows are few; else Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_prefix(prefix: str, columns: list[str]) -> str:
    """The prefix, made longer until no column starts with it."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def without(columns: list[str], taken: list[str]) -> list[str]:
    """The columns that are not named like any of the others; names differ in more than case."""
    return [c for c in columns if c.lower() not in {t.lower() for t in taken}]


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def words(text: Column) -> Column:
    """Array of the words; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")
