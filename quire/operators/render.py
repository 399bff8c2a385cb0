"""Pairs to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t

KEY = ["doc_id", "article_index"]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bilingual(pair: Column) -> Column:
    """Blocks of one pair."""
    en, zh, same = t.escape_currency(pair["en"]), t.escape_currency(pair["zh"]), trimmed(pair["zh"]) == trimmed(pair["en"])
    heading = F.when(pair["failed"] | same, F.array(F.concat(F.lit("## "), en))).otherwise(F.array(F.concat(F.lit("## "), zh, F.lit(" | "), en)))
    body = F.when(pair["failed"], F.array(en, F.lit(t.FAILED_MARK), en)).when(same, F.array(en)).otherwise(F.array(en, t.pad_inline_math(zh)))
    return F.when(pair["is_heading"], heading).otherwise(body)


def chinese_only(pair: Column) -> Column:
    zh = t.escape_currency(pair["zh"])
    return F.array(F.when(pair["is_heading"], F.concat(F.lit("## "), zh)).otherwise(t.pad_inline_math(zh)))


def bold(text: Column, keep: Column) -> Column:
    return F.when(keep, F.array(F.concat(F.lit("**"), t.escape_currency(text), F.lit("**")))).otherwise(F.array().cast("array<string>"))


def header(as_of: str) -> Column:
    """Title line and a line on the source."""
    only = F.col("mode") == "chinese_only"
    both = F.when((F.col("zh_title") != "") & (F.col("zh_title") != t.FAILED_MARK), F.concat(F.col("zh_title"), F.lit(" | "), F.col("title"))).otherwise(F.col("title"))
    title = F.when(only, F.coalesce(F.nullif(F.col("zh_title"), F.lit("")), F.col("title"))).otherwise(both)
    note = F.when(only, "Converted to Simplified Chinese").otherwise("Machine translation — verify before quoting")
    about = F.concat(F.lit("> Source: `"), F.col("source_name"), F.lit("` · Style: "), F.col("base_style"), F.lit(" × "), F.array_join("domains", "+"), F.lit(f" · Generated on {as_of} · "), note, F.lit("."))
    return F.array(F.concat(F.lit("# "), t.escape_currency(title)), about)


def markdown(articles: DataFrame, as_of: str) -> DataFrame:
    """articles (.., title, subtitle, zh_title, zh_subtitle, mode, source_name, base_style, domains, pairs: array of en, zh, failed, is_heading in
    order) with column md, the whole document."""
    only = F.col("mode") == "chinese_only"
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    zh_sub = (empty("zh_subtitle") != "") & (only | (F.col("zh_subtitle") != t.FAILED_MARK) & (empty("subtitle") != ""))
    subtitles = F.concat(bold(F.col("subtitle"), ~only & (empty("subtitle") != "")), bold(F.col("zh_subtitle"), zh_sub))
    body = F.when(only, F.flatten(F.transform("pairs", chinese_only))).otherwise(F.flatten(F.transform("pairs", bilingual)))
    return articles.withColumn("md", F.concat(F.array_join(F.concat(header(as_of), subtitles, body), "\n\n"), F.lit("\n")))


def results(articles: DataFrame) -> DataFrame:
    """One row a written article."""
    path = F.concat(F.lpad(F.col("article_index").cast("string"), 2, "0"), F.lit("-"), t.slug(F.col("title")), F.lit(".md"))
    return articles.select(*KEY, "title", path.alias("output_path"), F.size("pairs").alias("n_paragraphs"), F.size(F.filter("pairs", lambda p: p["failed"])).alias("n_failed"), "mode")
