"""Formulas and tables: runs of visual rows that become one line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import numbered, settle

#: A row of a table has three fragments, a table three rows; rows are four points high.
FRAGMENTS, ROWS, REACH, TOLERANCE = 3, 3, 3, 4.0
TABLE_TEXT = "[table omitted]"


def band_numbers(rows: list[dict]) -> list[dict]:
    """Rows by the y0 of their first line: a line within the tolerance of it joins."""
    out, first, band, place = [], rows[0]["y0"], 0, 0
    for r in rows:
        if abs(r["y0"] - first) > TOLERANCE:
            first, band, place = r["y0"], band + 1, 0
        out.append({"band": band, "place": place})
        place += 1
    return out


def row_bands(lines: DataFrame) -> DataFrame:
    """lines with band (from 0 on each page) and place in the band."""
    return numbered(lines, ["doc_id", "page"], ["y0", "x0", "line_seq"], band_numbers, "band int, place int")


def table_spans(banded: DataFrame) -> DataFrame:
    """(doc_id, page, lo, hi): first and last band of each table."""
    strong = banded.groupBy("doc_id", "page", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FRAGMENTS)
    along = Window.partitionBy("doc_id", "page").orderBy("band")
    new = F.when(F.col("band") - F.lag("band").over(along) <= REACH, 0).otherwise(1)
    grouped = strong.withColumn("new", new).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "page", "island").agg(F.min("band").alias("lo"), F.max("band").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= ROWS).drop("island", "n")


def row_kinds(banded: DataFrame) -> DataFrame:
    """(doc_id, page, band, kind, run): kind is table, formula or text; equal neighbours share a run."""
    numbered = F.col("text").rlike(r"^\(\p{Nd}{1,3}\)$")
    rows = banded.groupBy("doc_id", "page", "band").agg(
        F.count_if(~numbered).alias("parts"), F.count_if(~numbered & ~F.coalesce("math_only", F.lit(False))).alias("prose")
    )
    spans = table_spans(banded).select("doc_id", "page", "lo", "hi")
    inside = rows.join(spans, ["doc_id", "page"]).where(F.col("band").between(F.col("lo"), F.col("hi"))).select("doc_id", "page", "band").distinct().withColumn("table", F.lit(True))
    kinds = rows.join(inside, ["doc_id", "page", "band"], "left").withColumn(
        "kind", F.when(F.col("table"), "table").when((F.col("parts") > 0) & (F.col("prose") == 0), "formula").otherwise("text")
    )
    along = Window.partitionBy("doc_id", "page").orderBy("band")
    change = F.when(F.col("kind") == F.lag("kind").over(along), 0).otherwise(1)
    return kinds.withColumn("change", change).withColumn("run", F.sum("change").over(along.rowsBetween(Window.unboundedPreceding, 0))).select("doc_id", "page", "band", "kind", "run")


def mask_special_regions(lines: DataFrame) -> DataFrame:
    """Formulas and tables as one line each, with special (and clip for formulas); text lines in band order. line_seq is numbered anew."""
    banded = settle(row_bands(lines))
    rows = settle(banded.join(row_kinds(banded), ["doc_id", "page", "band"]))
    order = F.struct("band", "place")
    box = {"x0": F.min("x0"), "y0": F.min("y0"), "x1": F.max("x1"), "y1": F.max("y1")}
    nothing = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    special = rows.where(F.col("kind") != "text").groupBy("doc_id", "page", "run", "kind").agg(
        F.min(order).alias("at"),
        *(f.alias(k) for k, f in box.items()),
        F.min_by("x0", order).alias("first_x0"),
        F.min_by("y0", order).alias("first_y0"),
        F.max("font_size").alias("font_max"),
        F.min_by("font_size", order).alias("font_first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band", "place", "text"))), lambda s: s["text"]), " ").alias("joined"),
    )
    table = F.col("kind") == "table"
    special = special.select(
        "doc_id", "page", "at.band", "at.place",
        F.when(table, F.col("first_x0")).otherwise(F.col("x0")).alias("x0"), F.when(table, F.col("first_y0")).otherwise(F.col("y0")).alias("y0"), "x1", "y1",
        F.when(table, F.lit(TABLE_TEXT)).otherwise(F.col("joined")).alias("text"),
        F.when(table, F.col("font_first")).otherwise(F.col("font_max")).alias("font_size"),
        F.lit(False).alias("math_only"), F.col("kind").alias("special"), F.when(~table, F.struct(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).otherwise(nothing).alias("clip"),
    )
    plain = rows.where(F.col("kind") == "text").select("doc_id", "page", "band", "place", "x0", "y0", "x1", "y1", "text", "font_size", "math_only", F.lit(None).cast("string").alias("special"), nothing.alias("clip"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "band", "place")) - 1
    return plain.unionByName(special).withColumn("line_seq", seq.cast("int")).drop("band", "place")
