"""Translation: segments, batches, replies and aligned pairs. The model itself is behind quire.sources.boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t

#: Segments and characters of a batch, and attempts.
BATCH_ITEMS, BATCH_CHARS, ATTEMPTS = 8, 2400, 3
KEY = ["doc_id", "article_index"]


def segments(articles: DataFrame) -> DataFrame:
    """articles (.., title, subtitle, body) to (.., seg_seq, role, text, is_heading): title, subtitle if there is one, then the body."""
    part = lambda role, text, heading: F.struct(F.lit(role).alias("role"), text.alias("text"), heading.alias("is_heading"))
    head = F.array(part("title", F.col("title"), F.lit(False)))
    sub = F.when(F.coalesce(F.col("subtitle"), F.lit("")) != "", F.array(part("subtitle", F.col("subtitle"), F.lit(False))))
    body = F.transform("body", lambda p: part("body", p["text"], F.coalesce(p["is_heading"], F.lit(False))))
    whole = F.concat(head, F.coalesce(sub, F.slice(head, 1, 0)), body)
    return articles.select(*KEY, F.posexplode(whole).alias("seg_seq", "s")).select(*KEY, "seg_seq", "s.*")


def verbatim(rows: DataFrame) -> DataFrame:
    """With column verbatim: body text that is no prose and no heading stays as it is."""
    return rows.withColumn("verbatim", (F.col("role") == "body") & ~F.col("is_heading") & t.is_non_prose(F.col("text")))


def batch_numbers(lengths: Column) -> Column:
    """For an array of lengths the number of each one's batch: a batch ends before its ninth item, or before more than 2400 characters."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("chars"))

    def step(acc: Column, n: Column) -> Column:
        new = (acc["items"] > 0) & ((acc["items"] >= BATCH_ITEMS) | (acc["chars"] + n > BATCH_CHARS))
        batch = acc["batch"] + new.cast("int")
        return F.struct(
            F.array_append(acc["out"], batch).alias("out"), batch.alias("batch"), F.when(new, 1).otherwise(acc["items"] + 1).alias("items"), F.when(new, n).otherwise(acc["chars"] + n).cast("long").alias("chars")
        )

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def batches(rows: DataFrame, keys: list[str] | None = None, order: str = "seg_seq") -> DataFrame:
    """rows (.., seg_seq, text) with batch, numbered from 0 for each article."""
    keys = keys or KEY
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("items"))
    numbered = listed.withColumn("batch", batch_numbers(F.transform("items", lambda x: F.length(x["text"]).cast("long"))))
    zipped = numbered.select(*keys, F.explode(F.arrays_zip("items", "batch")).alias("x"))
    return zipped.select(*keys, F.col(f"x.items.{order}").alias(order), F.col("x.items.text").alias("text"), F.col("x.batch").alias("batch"))


def prompts(batched: DataFrame) -> DataFrame:
    """One numbered request a batch."""
    item = F.concat(F.lit("["), (F.col("seg_seq") + 1).cast("string"), F.lit("] "), F.col("text"))
    listed = F.sort_array(F.collect_list(F.struct("seg_seq", item.alias("item"))))
    return batched.groupBy(*KEY, "batch").agg(F.array_join(F.transform(listed, lambda x: x["item"]), "\n\n").alias("payload"), F.count(F.lit(1)).cast("int").alias("n_segments"))


def parsed_replies(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """replies (.., batch, attempt, body) to (.., batch, seg_seq, zh) of the first attempt that has every segment of its batch, none blank."""
    table = t.repaired_json(t.strip_fences(F.col("body")), "map<string,string>")
    tries = replies.where(F.col("attempt") <= ATTEMPTS).withColumn("table", table).where(F.col("table").isNotNull()).select(*KEY, "batch", "attempt", "table")
    wanted = batched.select(*KEY, "batch", "seg_seq")
    rows = wanted.join(tries, [*KEY, "batch"]).withColumn("zh", F.trim(F.element_at("table", (F.col("seg_seq") + 1).cast("string")))).drop("table")
    whole = Window.partitionBy(*KEY, "batch", "attempt")
    rows = rows.withColumn("lost", F.count_if(F.coalesce(F.col("zh"), F.lit("")) == "").over(whole)).where("lost = 0")
    return rows.withColumn("best", F.min("attempt").over(Window.partitionBy(*KEY, "batch"))).where("attempt = best").drop("best", "lost")


def failed_batches(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """Batches without a usable reply, and how many segments each has."""
    lost = batched.join(parsed.select(*KEY, "batch").distinct(), [*KEY, "batch"], "left_anti")
    return lost.groupBy(*KEY, "batch").agg(F.count(F.lit(1)).alias("n_segments"))


def pairs(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Segments (.., role, text, is_heading, verbatim) with zh and failed: verbatim text stands for itself, a missing rendering is marked."""
    held = rows.join(parsed.select(*KEY, "seg_seq", F.col("zh").alias("made")), [*KEY, "seg_seq"], "left")
    zh = F.when(F.col("verbatim"), F.col("text")).otherwise(F.coalesce("made", F.lit(t.FAILED_MARK)))
    return held.select(*KEY, "seg_seq", "role", F.col("text").alias("en"), zh.alias("zh"), (~F.col("verbatim") & F.col("made").isNull()).alias("failed"), "is_heading")


def titles(paired: DataFrame) -> DataFrame:
    """(.., zh_title, zh_subtitle): marked where translation failed, an empty subtitle where there is none."""
    one = lambda role: F.max(F.when(F.col("role") == role, F.col("zh")))
    return paired.groupBy(*KEY).agg(one("title").alias("zh_title"), F.coalesce(one("subtitle"), F.lit("")).alias("zh_subtitle"))


def usage(replies: DataFrame, node: str) -> DataFrame:
    """Tokens of every attempt that came back, whether it could be used or not."""
    return replies.where(F.col("body").isNotNull()).select(F.lit(node).alias("node"), F.col("tokens_in").alias("input_tokens"), F.col("tokens_out").alias("output_tokens"))


def converted(rows: DataFrame, table: dict[str, str]) -> DataFrame:
    """Chinese articles (.., script_state, text): traditional and mixed text by the character table, with mainland quotation marks; simplified text
    stays. Phrases need an outside dictionary, which can replace `table` by a column of its own."""
    source = "".join(table) + "「」『』"
    target = "".join(table.values()) + "“”‘’"
    zh = F.when(F.col("script_state").isin("traditional", "mixed"), F.translate("text", source, target)).otherwise(F.col("text"))
    return rows.withColumn("zh", zh).withColumn("failed", F.lit(False))
