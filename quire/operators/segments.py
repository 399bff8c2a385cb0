"""Paragraphs to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t

#: Characters of a preview, of leading text that is kept, of a subtitle; replies that may confirm headings.
PREVIEW, LEADING, SUBTITLE, ATTEMPTS = 200, 400, 160, 2


def in_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("para_seq")


def heading_candidates(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_seq, heading, preview): large headings with the start of the two paragraphs behind them."""
    text = F.concat_ws(" ", F.lead("text", 1).over(in_document()), F.lead("text", 2).over(in_document()))
    return paragraphs.withColumn("preview", t.preview(text, PREVIEW)).where("font_heading").select("doc_id", "para_seq", F.col("text").alias("heading"), "preview")


def confirmed_starts(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc_id, para_seq, fallback): of the replies (doc_id, attempt from 0, ids) the first that names a candidate counts; without one of two, all candidates do."""
    named = replies.where(F.col("attempt") < ATTEMPTS).select("doc_id", "attempt", F.explode("ids").alias("para_seq")).join(candidates.select("doc_id", "para_seq"), ["doc_id", "para_seq"], "left_semi")
    first = named.groupBy("doc_id").agg(F.min("attempt").alias("attempt"))
    sure = named.join(first, ["doc_id", "attempt"]).select("doc_id", "para_seq").distinct().withColumn("fallback", F.lit(False))
    rest = candidates.select("doc_id", "para_seq").join(first, "doc_id", "left_anti").withColumn("fallback", F.lit(True))
    return sure.unionByName(rest)


def notes(paragraphs: DataFrame, candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc_id, severity, note) of documents without a heading, and of those whose replies confirmed none."""
    bare = paragraphs.groupBy("doc_id").agg(F.bool_or("font_heading").alias("any")).where(~F.col("any")).select("doc_id", F.lit("no headings; the whole document is one article").alias("note"))
    unsure = confirmed_starts(candidates, replies).where("fallback").select("doc_id").distinct().withColumn("note", F.lit("no reply confirmed a heading; all candidates kept"))
    return bare.unionByName(unsure).withColumn("severity", F.lit("error"))


def subtitle(title: Column, following: Column, special: Column) -> Column:
    """The paragraph behind a title, if it is short, is no sentence, and has Han where the title has; else empty."""
    fits = following.isNotNull() & special.isNull() & (F.length(following) <= SUBTITLE) & ~following.rlike("[.。！？]$") & ~(t.has_han(title) & ~t.has_han(following))
    return F.when(fits, following).otherwise("")


def article_slices(paragraphs: DataFrame, starts: DataFrame | None = None, stems: DataFrame | None = None) -> DataFrame:
    """One row an article: doc_id, article_index, title, subtitle, body (array of text and is_heading), kind.

    starts (doc_id, para_seq) are the confirmed headings, or else all large ones. What stands before the first is an article without title if
    it is long, and goes if it is not. A document without start is one article, named by stems (doc_id, stem) or its id."""
    rows = paragraphs.withColumn("starts", F.col("font_heading"))
    if starts is not None:
        rows = paragraphs.join(starts.select("doc_id", "para_seq", F.lit(True).alias("starts")), ["doc_id", "para_seq"], "left").withColumn("starts", F.coalesce("starts", F.lit(False)))
    doc = Window.partitionBy("doc_id")
    slice_no = F.sum(F.col("starts").cast("int")).over(in_document().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("slice", slice_no).withColumn("n_starts", F.max("slice").over(doc))
    in_slice = Window.partitionBy("doc_id", "slice")
    rows = rows.withColumn("place", F.row_number().over(in_slice.orderBy("para_seq")) - 1).withColumn("chars", F.sum(F.length("text")).over(in_slice))
    rows = rows.where((F.col("slice") > 0) | (F.col("n_starts") == 0) | (F.col("chars") > LEADING))
    at = lambda k, c: F.max(F.when((F.col("place") == k) & (F.col("slice") > 0), F.col(c)))
    listed = rows.groupBy("doc_id", "slice", "n_starts").agg(
        at(0, "text").alias("heading"), at(1, "text").alias("following"), at(1, "special").alias("special"),
        F.sort_array(F.collect_list(F.struct("place", "text", "is_heading"))).alias("parts"),
    )
    if stems is not None:
        listed = listed.join(stems, "doc_id", "left")
    else:
        listed = listed.withColumn("stem", F.col("doc_id").cast("string"))
    kind = F.when(F.col("n_starts") == 0, "whole").when(F.col("slice") == 0, "leading").otherwise("titled")
    listed = listed.withColumn("kind", kind).withColumn("subtitle", F.when(F.col("slice") > 0, subtitle(F.col("heading"), F.col("following"), F.col("special"))).otherwise(""))
    skip = F.when(F.col("slice") == 0, 0).when(F.col("subtitle") != "", 2).otherwise(1)
    title = F.when(F.col("kind") == "whole", F.col("stem")).when(F.col("kind") == "leading", F.concat("stem", F.lit(" (untitled leading section)"))).otherwise(F.col("heading"))
    body = F.transform(F.filter("parts", lambda p: p["place"] >= F.col("skip")), lambda p: F.struct(p["text"].alias("text"), p["is_heading"].alias("is_heading")))
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("slice")) - 1).cast("int")
    return listed.withColumn("skip", skip).select("doc_id", index.alias("article_index"), title.alias("title"), "subtitle", body.alias("body"), "kind")


def exploded(articles: DataFrame) -> DataFrame:
    """(doc_id, article_index, seg_seq, text, is_heading) of the bodies."""
    return articles.select("doc_id", "article_index", F.posexplode("body").alias("seg_seq", "p")).select("doc_id", "article_index", "seg_seq", "p.text", "p.is_heading")


def split_by_language(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles to be translated, and those to be converted: Latin letters outnumber Han, or not."""
    whole = F.concat_ws(" ", "title", "subtitle", F.array_join(F.transform("body", lambda p: p["text"]), " "))
    marked = articles.withColumn("has_english", t.latin_count(whole) > t.han_count(whole))
    return marked.where("has_english").drop("has_english"), marked.where(~F.col("has_english")).drop("has_english")
