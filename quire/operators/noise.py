"""Lines without the page's furniture.

Lines: doc_id, line_seq, page, x0, y0, x1, y1, text, font_size, math_only, special. Statistics come from all lines of a document, before any rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t

#: Labels that note programs print into a page.
UI_LABELS = ["Favorite", "Status", "Notebooks", "Edited", "Archive", "Pin"]
BAND = 4


def text_layer(lines: DataFrame, least: int = t.MIN_TEXT_CHARS) -> DataFrame:
    """(doc_id, n_chars, usable): a document with too little text is a scan."""
    return lines.groupBy("doc_id").agg(F.sum(F.length("text")).cast("long").alias("n_chars")).withColumn("usable", F.col("n_chars") >= least)


def running_copies(lines: DataFrame) -> Column:
    """True for the copies of a short text that stands on two pages or more: all but the one in the largest type, first page, highest place."""
    same = Window.partitionBy("doc_id", "text")
    first = F.row_number().over(same.orderBy(F.col("font_size").desc(), "page", "y0", "line_seq"))
    return (F.length("text") <= 60) & (F.min("page").over(same) != F.max("page").over(same)) & (first > 1)


def copies(lines: DataFrame) -> DataFrame:
    """The rows that running_copies marks, where "documents" are so large that one text may be most of them: the best copy is an aggregate, and a join
    brings it back, which Spark splits where a key is crowded."""
    key = ["doc_id", "text"]
    rank = F.struct((-F.col("font_size")).alias("size"), "page", "y0", "line_seq")
    short = lines.where(F.length("text") <= 60)
    best = short.groupBy(*key).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min(rank).alias("best")).where("first_page <> last_page").select(*key, "best")
    return short.join(best, key).where(rank != F.col("best")).drop("best")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size): the upper median of the type sizes, each weighing its characters."""
    sizes = lines.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).alias("n"))
    along = Window.partitionBy("doc_id").orderBy("font_size").rowsBetween(Window.unboundedPreceding, 0)
    upto = sizes.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("doc_id").agg(F.min("font_size").alias("body_size"))


def ui_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, page, band) of rows that hold a label."""
    return lines.where(F.col("text").isin(UI_LABELS)).select("doc_id", "page", band().alias("band")).distinct()


def band() -> Column:
    return F.floor(F.col("y0") / BAND)


def without_ui_rows(lines: DataFrame) -> DataFrame:
    """A label takes all of its row with it."""
    hit = F.max(F.col("text").isin(UI_LABELS)).over(Window.partitionBy("doc_id", "page", band()))
    return lines.withColumn("ui", hit).where(~F.col("ui")).drop("ui")


def scripts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.sum(t.latin_count(F.col("text"))).cast("long").alias("latin"), F.sum(t.han_count(F.col("text"))).cast("long").alias("han"))


def strip_noise(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """One pass over statistics of all lines: page numbers, header dates, running copies, label rows, tiny type, and short Latin lines in
    a document that is mostly Han. Everything is partitioned by document, so one exchange serves the joins and windows."""
    stats = body_sizes(lines).join(scripts(lines), "doc_id").select("doc_id", "body_size", (F.col("han") > F.col("latin")).alias("han_majority"))
    label = F.max(F.col("text").isin(UI_LABELS)).over(Window.partitionBy("doc_id", "page", band()))
    marked = lines.withColumn("copy", running_copies(lines)).withColumn("ui", label)
    marked = marked.join(stats, "doc_id", "left").join(pages.select("doc_id", "page", "height"), ["doc_id", "page"], "left")
    drop = (
        F.coalesce(t.is_page_number(F.col("text"), F.col("y0"), F.col("height")) | t.is_header_date(F.col("text"), F.col("y1"), F.col("height")), F.lit(False))
        | F.col("copy")
        | F.col("ui")
        | (F.col("font_size") < 0.75 * F.col("body_size"))
        | (F.col("han_majority") & (F.length("text") < 30) & ~t.has_han(F.col("text")))
    )
    return marked.where(~drop).select(*lines.columns)


def drop_embedded_translation(lines: DataFrame) -> DataFrame:
    """Where Latin letters outnumber Han, Chinese lines are a translation and go."""
    doc = Window.partitionBy("doc_id")
    latin, han = F.sum(t.latin_count(F.col("text"))).over(doc), F.sum(t.han_count(F.col("text"))).over(doc)
    return lines.withColumn("english", latin > han).where(~(F.col("english") & t.is_chinese(F.col("text")))).drop("english")


#: Fixed value: characters of an article that tell its script.
SCRIPT_SAMPLE = 4000


def route(articles: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """articles (.., title, subtitle, paragraphs) with latin, han, has_english and script_state. table: traditional to simplified characters; a text that
    either direction would change within its first characters has that script, or both."""
    whole = F.concat_ws(" ", "title", "subtitle", F.array_join("paragraphs", " "))
    sample = t.preview(F.col("whole"), SCRIPT_SAMPLE)
    old, new = "".join(table or {}), "".join((table or {}).values())
    a, b = F.translate(sample, new, old) != sample, F.translate(sample, old, new) != sample
    state = F.when(F.col("han") == 0, "none").when(a & b, "mixed").when(b, "traditional").otherwise("simplified")
    counted = articles.withColumn("whole", whole).withColumn("latin", t.latin_count(F.col("whole")).cast("long")).withColumn("han", t.han_count(F.col("whole")).cast("long"))
    return counted.withColumn("has_english", F.col("latin") > F.col("han")).withColumn("script_state", state).drop("whole")


def english_paragraphs(paragraphs: DataFrame, titles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Paragraphs that are not Chinese, with their other columns, and one row for each article that lost some; of titles (.., title) 40 characters."""
    chinese = t.is_chinese(F.col("text"))
    lost = paragraphs.where(chinese).groupBy("doc_id", "article_index").agg(F.count(F.lit(1)).alias("n_dropped"))
    if titles is not None:
        lost = lost.join(titles.select("doc_id", "article_index", t.preview(F.col("title"), 40).alias("title")), ["doc_id", "article_index"], "left")
    return paragraphs.where(~chinese), lost.withColumn("severity", F.lit("info"))
