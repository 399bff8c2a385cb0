"""Lines to paragraphs: columns, gaps, paragraphs, headings, and what belongs together across columns and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.folds import numbered, per_document, settle

#: Lines farther apart are other columns; a gap this many times the usual one parts paragraphs.
COLUMN_GAP, GAP_RATIO = 100.0, 1.5


def middle(values: list[float]) -> float:
    """The median; the mean of the middle two of an even number."""
    s, n = sorted(values), len(values)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def column_numbers(rows: list[dict]) -> list[dict]:
    """From left to right: a line joins the last column if it starts near its rightmost start or left of its usual end."""
    out, number, starts, ends = [], -1, 0.0, []
    for r in rows:
        joins = bool(ends) and (r["x0"] - starts <= COLUMN_GAP or r["x0"] <= middle(ends) - 1.0)
        if joins:
            starts = max(starts, r["x0"])
        else:
            number, starts, ends = number + 1, r["x0"], []
        ends.append(r["x1"])
        out.append({"col": number})
    return out


def columns(lines: DataFrame) -> DataFrame:
    """lines with col (from 0 on each page) and pos, the place in the column."""
    found = numbered(lines, ["doc_id", "page"], ["x0", "line_seq"], column_numbers, "col int")
    inside = Window.partitionBy("doc_id", "page", "col").orderBy("y0", "x0", "line_seq")
    return found.withColumn("pos", F.row_number().over(inside) - 1)


def in_column() -> Window:
    return Window.partitionBy("doc_id", "page", "col").orderBy("pos")


def gap_thresholds(placed: DataFrame) -> DataFrame:
    """(doc_id, page, col, size, gap): the usual gap between lines of a rounded type size; size null is the column's own."""
    after = F.lead("y0").over(in_column()) - F.col("y0")
    alike = F.abs(F.lead("font_size").over(in_column()) - F.col("font_size")) <= 1.0
    gaps = placed.withColumn("gap", after).withColumn("alike", alike).withColumn("first_size", F.first("font_size").over(in_column()))
    key = ["doc_id", "page", "col"]
    own = gaps.where((F.col("gap") > 0) & F.col("alike")).groupBy(*key, F.bround("font_size").cast("int").alias("size")).agg(F.median("gap").alias("gap"))
    default = gaps.groupBy(*key).agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.first("first_size") * 1.4).alias("gap"))
    return own.unionByName(default.withColumn("size", F.lit(None).cast("int")))


def short_line_cutoffs(placed: DataFrame) -> DataFrame:
    """(doc_id, page, col, right_edge, cutoff): how far from the right edge a line ends a paragraph; columns of three lines or more."""
    key = ["doc_id", "page", "col"]
    edge = placed.withColumn("right_edge", F.max("x1").over(Window.partitionBy(*key)))
    ranked = edge.withColumn("deficit", F.col("right_edge") - F.col("x1"))
    listed = ranked.groupBy(*key, "right_edge").agg(F.sort_array(F.collect_list("deficit")).alias("d"), F.median("font_size").alias("usual"), F.count(F.lit(1)).alias("n"))
    typical = F.get("d", F.floor(F.size("d") / 2).cast("int"))
    return listed.where(F.col("n") >= 3).select(*key, "right_edge", (3 * typical + 2 * F.col("usual")).alias("cutoff"))


def joined(a: str, b: str) -> str:
    """As text.join_text, for a fold."""
    if a.endswith("-"):
        return a[:-1] + b
    return a + b if is_cjk(a[-1:]) or is_cjk(b[:1]) else f"{a} {b}"


def is_han(c: str) -> bool:
    return len(c) == 1 and ("一" <= c <= "鿿" or "㐀" <= c <= "䶿")


def is_cjk(c: str) -> bool:
    return is_han(c) or len(c) == 1 and ("　" <= c <= "〿" or "！" <= c <= "～")


def open_paragraphs(rows: list[dict]) -> list[dict]:
    """Paragraphs of one document's lines, which carry what parts them but for the size of the paragraph's first line."""
    out: list[dict] = []
    head, column = None, None
    for r in rows:
        here = (r["page"], r["col"])
        if here != column or r["breaks"] or abs(r["font_size"] - head) > 1.0:
            head, column = r["font_size"], here
            out.append({"para_seq": len(out), "page": r["page"], "font_size": head, "special": r["special"], "clip": r["clip"], "text": r["text"], "n_lines": 1})
        else:
            out[-1]["text"] = joined(out[-1]["text"], r["text"])
            out[-1]["n_lines"] += 1
    return out


CLIP = "struct<x0:double,y0:double,x1:double,y1:double>"
PARAGRAPH = f"para_seq int, page int, font_size double, special string, clip {CLIP}, text string, n_lines int"


def reflow_columns(lines: DataFrame) -> DataFrame:
    """(doc_id, para_seq, page, font_size, special, clip, text, n_lines) in reading order; a formula is a paragraph of its own and keeps its clip. Thresholds are windows and joins; the fold carries one number."""
    placed = settle(columns(with_clip(lines)))
    key = ["doc_id", "page", "col"]
    gaps, cut = gap_thresholds(placed), short_line_cutoffs(placed)
    own = gaps.where(F.col("size").isNotNull()).withColumnRenamed("gap", "own_gap")
    rows = placed.withColumn("size", F.bround("font_size").cast("int")).join(own, [*key, "size"], "left").join(gaps.where(F.col("size").isNull()).drop("size"), key).join(cut, key, "left")
    back = lambda c: F.lag(c).over(in_column())
    step = F.col("y0") - back("y0")
    breaks = (
        F.col("special").isNotNull()
        | back("special").isNotNull()
        | (step > F.coalesce("own_gap", "gap") * GAP_RATIO)
        | (F.col("cutoff").isNotNull() & (step > 0.5 * back("font_size")) & (F.col("right_edge") - back("x1") > F.col("cutoff")))
    )
    rows = rows.withColumn("breaks", F.coalesce(breaks, F.lit(False))).select(*key, "pos", "font_size", "special", "clip", "text", "breaks")
    return per_document(rows, ["doc_id"], ["page", "col", "pos"], open_paragraphs, PARAGRAPH)


def in_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("para_seq")


def mark_headings(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with font_heading (large type) and is_heading (that, or the shape of a heading; never a formula or table)."""
    sizes = paragraphs.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).alias("chars"))
    body = sizes.where("chars > 0").groupBy("doc_id").agg(F.expr("percentile(font_size, 0.5, chars)").alias("body"))
    text = F.col("text")
    before = F.lag("text").over(in_document())
    shape = (
        (F.length(text) < 60)
        & (t.word_count(text) + t.han_count(text) >= 2)
        & ~t.ends_terminal(text)
        & (text.rlike(r"^\p{Lu}") | text.rlike(f"^[{t.HAN}]"))
        & ~text.rlike(f"[{t.BLOCKED}]")
        & (before.isNull() | t.ends_terminal(before))
    )
    marked = paragraphs.join(body, "doc_id", "left").withColumn("shape", shape).withColumn("font_heading", F.coalesce((F.col("font_size") >= F.col("body") + 1.5) & (F.length(text) < 120), F.lit(False)))
    return marked.withColumn("is_heading", (F.col("font_heading") | F.col("shape")) & F.col("special").isNull()).drop("body", "shape")


def demote_split_callouts(paragraphs: DataFrame) -> DataFrame:
    """A heading that stops inside a clause, with its continuation behind it, is one paragraph and no heading. Such pairs can't chain."""
    after = lambda c: F.lead(c).over(in_document())
    text = F.col("text")
    joins = F.coalesce(
        F.col("is_heading") & ~t.ends_terminal(text) & text.rlike(f"[{t.CLAUSE}]") & ~after("is_heading") & t.starts_like_continuation(after("text"), text), F.lit(False)
    )
    held = paragraphs.withColumn("joins", joins).withColumn("next_text", after("text")).withColumn("next_size", after("font_size"))
    held = held.withColumn("taken", F.coalesce(F.lag("joins").over(in_document()), F.lit(False))).where(~F.col("taken"))
    merged = lambda new, old: F.when(F.col("joins"), new).otherwise(F.col(old)).alias(old)
    kept = [c for c in paragraphs.columns if c not in ("text", "font_size", "is_heading", "font_heading")]
    return held.select(*kept, merged(t.join_text(text, F.col("next_text")), "text"), merged(F.col("next_size"), "font_size"), merged(F.lit(False), "is_heading"), merged(F.lit(False), "font_heading"))


def stitch(rows: list[dict]) -> list[dict]:
    """Continuations joined to the paragraph they belong to; `continues` holds all of the rule but the size of that paragraph."""
    out: list[dict] = []
    for r in rows:
        if out and r["continues"] and abs(out[-1]["font_size"] - r["font_size"]) <= 1.0:
            out[-1]["text"] = joined(out[-1]["text"], r["text"])
        else:
            out.append({k: r[k] for k in ("para_seq", "page", "font_size", "special", "clip", "text", "is_heading", "font_heading")})
    return out


STITCHED = f"para_seq int, page int, font_size double, special string, clip {CLIP}, text string, is_heading boolean, font_heading boolean"


def merge_continuations(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs parted by a column or page: the first stops without a final mark, the next goes on with a small letter or Han after Han.

    Whatever was joined before, the merged paragraph ends as its last part does, so all but the type size is a look at the row before."""
    back = lambda c: F.lag(c).over(in_document())
    text = F.col("text")
    continues = (
        ~back("is_heading") & ~F.col("is_heading") & back("special").isNull() & F.col("special").isNull() & ~t.ends_terminal(back("text")) & t.starts_like_continuation(text, back("text"))
    )
    rows = with_clip(paragraphs).withColumn("continues", F.coalesce(continues, F.lit(False))).select("doc_id", "para_seq", "page", "font_size", "special", "clip", "text", "is_heading", "font_heading", "continues")
    return per_document(rows, ["doc_id"], ["para_seq"], stitch, STITCHED)


def with_clip(rows: DataFrame) -> DataFrame:
    return rows if "clip" in rows.columns else rows.withColumn("clip", F.lit(None).cast(CLIP))


def reflow(lines: DataFrame) -> DataFrame:
    """Lines to paragraphs with headings marked; para_seq has holes where paragraphs were joined."""
    if "special" not in lines.columns:
        lines = lines.withColumn("special", F.lit(None).cast("string"))
    return merge_continuations(demote_split_callouts(mark_headings(settle(reflow_columns(lines)))))


#: What a crop takes around a formula, in points, and its dots per inch.
CROP_PAD, CROP_DPI = 4.0, 200


def crops(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_seq, page, x0, y0, x1, y1, zoom) of the formulas: the part of the page that a picture has to show. The picture is the PDF library's to make."""
    c = lambda name, by: (F.col(f"clip.{name}") + by).alias(name)
    rows = paragraphs.where((F.col("special") == "formula") & F.col("clip").isNotNull())
    return rows.select("doc_id", "para_seq", "page", c("x0", -CROP_PAD), c("y0", -CROP_PAD), c("x1", CROP_PAD), c("y1", CROP_PAD), F.lit(CROP_DPI / 72).alias("zoom"))


def formula_plan(paragraphs: DataFrame, replies: DataFrame | None = None, most: int = 30) -> DataFrame:
    """paragraphs with formulas transcribed: of each document the first `most` are asked for, and replies (doc_id, para_seq, body) fill
    them; the others, and those without a reply, get a fenced placeholder. Column asked says which were sent."""
    formula = F.col("special") == "formula"
    number = F.row_number().over(Window.partitionBy("doc_id", formula).orderBy("para_seq"))
    rows = paragraphs.withColumn("asked", F.coalesce(formula & (number <= most), F.lit(False)))
    if replies is None:
        rows = rows.withColumn("body", F.lit(None).cast("string"))
    else:
        rows = rows.join(replies.select("doc_id", "para_seq", "body"), ["doc_id", "para_seq"], "left")
    latex = F.btrim(F.regexp_replace(t.strip_fences(F.regexp_replace("body", r"^\s*```(?:latex)?", "")), r"^[$\s]+|[$\s]+$", ""))
    filled = F.when(F.col("asked") & (F.length(latex) > 0), F.concat(F.lit("$$\n"), latex, F.lit("\n$$"))).otherwise(F.concat(F.lit("```\n[formula] "), F.col("text"), F.lit("\n```")))
    return rows.withColumn("text", F.when(F.coalesce(formula, F.lit(False)), filled).otherwise(F.col("text"))).drop("body")

