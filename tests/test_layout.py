"""Layout: scenarios, and folds against a plain statement on random pages."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import noise, reflow, regions
from quire.sources import tables

LINE = "doc_id int, line_seq int, page int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, math_only boolean"


def lines(spark, rows, doc=1):
    """rows of (page, y0, text, then optionally font_size, x0, x1)."""
    full = []
    for k, (page, y0, text, *rest) in enumerate(rows):
        size, x0, x1 = (list(rest) + [12.0, 10.0, 400.0][len(rest) :])[:3]
        full.append((doc, k, page, float(x0), float(y0), float(x1), float(y0 + size), text, float(size), False))
    return spark.createDataFrame(full, LINE)


def pages(spark, df):
    return df.select("doc_id", "page").distinct().select("*", F.lit(842.0).alias("width"), F.lit(595.0).alias("height"))


def stripped(spark, rows):
    df = lines(spark, rows)
    return [r["text"] for r in noise.strip_noise(df, pages(spark, df)).orderBy("line_seq").collect()]


def paragraphs(spark, rows):
    df = lines(spark, rows).withColumn("special", F.lit(None).cast("string"))
    return reflow.reflow(df).orderBy("para_seq").collect()


BODY = "Some words of a body that runs on for long enough to weigh."


def test_page_numbers_go_but_digits_in_the_text_stay(spark):
    assert stripped(spark, [(0, 100, BODY), (0, 120, "7"), (0, 540, "7")]) == [BODY, "7"]


def test_the_largest_of_running_headers_stays(spark):
    df = lines(spark, [(0, 60, "The Weekly", 30.0), (0, 200, BODY), (1, 60, "The Weekly"), (1, 200, BODY + " More.")])
    kept = noise.strip_noise(df, pages(spark, df)).orderBy("line_seq").collect()
    assert [(r["text"], r["font_size"]) for r in kept if r["text"] == "The Weekly"] == [("The Weekly", 30.0)]


def test_label_rows_go_with_their_values(spark):
    assert stripped(spark, [(0, 100, "Status"), (0, 101, "Open"), (0, 200, BODY)]) == [BODY]


def test_tiny_type_goes(spark):
    assert stripped(spark, [(0, 100, BODY), (0, 120, "a web address", 7.5)]) == [BODY]


def test_short_latin_lines_go_in_han_documents(spark):
    assert stripped(spark, [(0, 100, "这是一个以中文为主的文件内容"), (0, 120, "Brand"), (0, 140, "中文 Brand")]) == ["这是一个以中文为主的文件内容", "中文 Brand"]


def test_gaps_part_paragraphs(spark):
    rows = [(0, 100, "One line"), (0, 114, "goes on"), (0, 128, "and on."), (0, 188, "Another"), (0, 202, "ends.")]
    assert [r["text"] for r in paragraphs(spark, rows)] == ["One line goes on and on.", "Another ends."]


def test_hyphens_and_han_join_without_space(spark):
    assert [r["text"] for r in paragraphs(spark, [(0, 100, "a bro-"), (0, 124, "ken word.")])] == ["a broken word."]
    assert [r["text"] for r in paragraphs(spark, [(0, 100, "中文的一行"), (0, 124, "接着下一行。")])] == ["中文的一行接着下一行。"]


def test_a_short_line_ends_a_paragraph(spark):
    ends = [516, 516, 516, 200, 516, 180]
    rows = [(0, 100 + 24 * k, f"{'Start' if k in (0, 4) else 'then'} of line {k}{'.' if k in (3, 5) else ''}", 12.0, 10, e) for k, e in enumerate(ends)]
    assert len(paragraphs(spark, rows)) == 2


def test_paragraphs_go_on_across_pages(spark):
    first, second = "The end of a page that is longer than a heading may be, and is", "no end of a sentence."
    assert [r["text"] for r in paragraphs(spark, [(0, 500, first), (1, 30, second)])] == [f"{first} {second}"]


def test_headings(spark):
    body = [(0, y, BODY) for y in (200, 214, 228, 242)] + [(0, 280, "A crosshead here")] + [(0, y, BODY) for y in (320, 334, 348, 362)]
    got = paragraphs(spark, [(0, 60, "A large title", 20.0), *body])
    assert [(r["is_heading"], r["font_heading"]) for r in got] == [(True, True), (False, False), (True, False), (False, False)]


def test_rows_drift_apart_from_the_first_line(spark):
    df = lines(spark, [(0, y, f"l{y}") for y in (0, 3, 6, 9, 12)])
    assert [r["band"] for r in regions.row_bands(df).orderBy("line_seq").collect()] == [0, 0, 1, 1, 2]


def column_rule(xs):
    """Plain statement of the column rule."""
    out, cols = {}, []
    for k, (x0, x1) in sorted(enumerate(xs), key=lambda r: (r[1][0], r[0])):
        if cols and (x0 - max(a for a, _ in cols[-1]) <= 100 or x0 <= statistics.median(b for _, b in cols[-1]) - 1):
            cols[-1].append((x0, x1))
        else:
            cols.append([(x0, x1)])
        out[k] = len(cols) - 1
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_columns_against_the_plain_rule(spark, parts):
    r = random.Random(8)
    docs = {d: [(float(r.choice([10, 60, 130, 250, 310, 420])), 0.0) for _ in range(r.randint(1, 25))] for d in range(40)}
    docs = {d: [(x, x + r.choice([50, 90, 200])) for x, _ in xs] for d, xs in docs.items()}
    rows = [(d, k, 0, x0, 10.0 * k, float(x1), 10.0 * k + 9, "t", 12.0, False) for d, xs in docs.items() for k, (x0, x1) in enumerate(xs)]
    got = {(c["doc_id"], c["line_seq"]): c["col"] for c in reflow.columns(spark.createDataFrame(rows, LINE).repartition(parts)).collect()}
    assert got == {(d, k): c for d, xs in docs.items() for k, c in column_rule(xs).items()}


def test_continuations_carry_the_first_size(spark):
    """12, 12.8, 13.6: the third is too far from the first, though near to the second."""
    rows = [(1, k, 0, size, None, text, False, False) for k, (size, text) in enumerate([(12.0, "a start"), (12.8, "goes on"), (13.6, "and stops.")])]
    df = spark.createDataFrame(rows, "doc_id int, para_seq int, page int, font_size double, special string, text string, is_heading boolean, font_heading boolean")
    assert [r["text"] for r in reflow.merge_continuations(df).orderBy("para_seq").collect()] == ["a start goes on", "and stops."]


@pytest.mark.parametrize("parts", [1, 5])
def test_reflow_does_not_depend_on_partitions(spark, parts):
    docs = spark.createDataFrame([(i, "\n".join(f"{'Line' if j % 4 == 0 else 'line'} {j} of {i}{'.' if j % 3 == 2 else ''}" for j in range(30))) for i in range(8)], "doc_id long, text string")
    rows = tables.document_lines(docs.repartition(parts)).withColumn("special", F.lit(None).cast("string"))
    got = sorted((r["doc_id"], r["para_seq"], r["text"]) for r in reflow.reflow(rows).collect())
    want = sorted((r["doc_id"], r["para_seq"], r["text"]) for r in reflow.reflow(tables.document_lines(docs.coalesce(1)).withColumn("special", F.lit(None).cast("string"))).collect())
    assert got == want and got


def test_padding_against_a_plain_walk(spark):
    r = random.Random(2)
    texts = ["".join(r.choices(["$", "x", "价", " ", "\\", "\n", "1"], k=r.randint(0, 12))) for _ in range(1500)]

    def spans(text):
        """Pairs of signs, the first neither escaped nor behind another, the next sign closing it on the same line and with no third behind it."""
        i = 0
        while 0 <= (i := text.find("$", i)):
            j = text.find("$", i + 1)
            if text[max(0, i - 1) : i] not in ("$", "\\") and j > i + 1 and "\n" not in text[i:j] and text[j + 1 : j + 2] != "$":
                yield i, j
                i = j
            i += 1

    def walk(text):
        gaps = {i for i, _ in spans(text) if i and not text[i - 1].isspace()} | {j + 1 for _, j in spans(text) if text[j + 1 : j + 2].strip()}
        return "".join(" " * (k in gaps) + c for k, c in enumerate(text))

    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r["i"]: r["p"] for r in df.select("i", t.pad_inline_math(F.col("s")).alias("p")).collect()}
    bad = [(texts[i], got[i], walk(texts[i])) for i in got if got[i] != walk(texts[i])]
    assert not bad, bad[:5]
