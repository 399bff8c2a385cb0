"""Glossary files, sinks, the boundary, and the progress stream."""

import json

from pyspark.sql import functions as F

from quire.operators import glossary as g
from quire.operators import jobs, translate
from quire.sources import boundary, pdf, tables
from quire.streaming import progress


def test_seed_files(spark, tmp_path):
    (tmp_path / "glossary_x.json").write_text(json.dumps({"domain": "x", "description": "d", "terms": [{"en": "Yield", "zh": "收益率", "category": "c", "source": "seed", "added_date": "2020-01-01", "note": "n"}]}))
    seeds = g.read_seed(spark, str(tmp_path))
    grown, seeded = g.seed_once(spark.createDataFrame([], g.SCHEMA), spark.createDataFrame([], "domain string"), seeds, "2024-01-01")
    assert [tuple(r) for r in grown.collect()] == [("x", "yield", "Yield", "收益率", "c", "seed", "2020-01-01")]
    kept, _ = g.remove_terms(grown, spark.createDataFrame([("x", "YIELD")], "domain string, en string"))
    again, _ = g.seed_once(kept, seeded, seeds, "2024-01-02")
    assert again.count() == 0


def test_many_terms_go_through_an_automaton(spark):
    texts = spark.createDataFrame([(1, 0, "Term17 and term9, xterm23y"), (2, 0, "none")], "doc_id int, article_index int, full_text string")
    terms = spark.createDataFrame([("d", f"term{i}", f"Term{i}", "词", "c", "s", "t") for i in range(1500)], g.SCHEMA)
    many = {(r["doc_id"], r["block"]) for r in g.constraints(texts, terms).collect()}
    few = {(r["doc_id"], r["block"]) for r in g.constraints(texts, terms.where("en_lower rlike '^term(1|2|9|17|23)$'")).collect()}
    assert many == few and len(many) == 1


def test_styles_and_domains():
    assert tables.styles_and_domains(["b_style.md", "a_style.md", "x.md"], ["glossary_econ.json", "glossary_econ_rejected.json", "glossary_cs.json"]) == (["a", "b"], ["cs", "econ"])


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"pdf": "a.pdf", "base_style": "s", "domains": ["x"], "expected_articles": 2}, {"pdf": "b.pdf", "base_style": "s", "domains": [], "expected_articles": 1}]))
    assert [r["pdf"] for r in tables.manifest(spark, str(tmp_path / "m.json"), "a").collect()] == ["a.pdf"]
    (tmp_path / "ref.txt").write_text(" one \n\ntwo\n")
    assert [r["text"] for r in tables.reference_paragraphs(spark, str(tmp_path / "ref.txt")).collect()] == ["one", "two"]
    rendered = spark.createDataFrame([("00-a.md", "# A\n\ntext\n"), ("01-标题-b.md", "# B\n")], "output_path string, md string")
    for _ in range(2):
        tables.write_markdown(rendered, str(tmp_path / "out"))
    found = {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert found == {"00-a.md": "# A\n\ntext\n", "01-标题-b.md": "# B\n"}
    assert tables.reference_paragraphs(spark, str(tmp_path / "none.txt")).count() == 0
    tables.write_json(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "log"))
    assert json.loads(spark.read.text(str(tmp_path / "log")).first()[0]) == {"n": 1, "s": "x"}
    for _ in range(2):
        tables.append_archive(rendered, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 4


def test_replies_are_settled_and_failures_are_rows(spark):
    def flaky(kind, payload, max_tokens):
        if payload == "never":
            raise ValueError("no")
        return boundary.echo(kind, payload, max_tokens)

    asked = spark.createDataFrame([("translate", "1/0/0", "[1] one\n\n[2] two"), ("translate", "2/0/0", "never")], "kind string, key string, payload string")
    replies = boundary.answer(asked, flaky)
    assert replies.where("error is not null").count() == 3
    assert [r["key"] for r in boundary.errors(replies).collect()] == ["2/0/0"]
    batched = spark.createDataFrame([(1, 0, 0, "one", 0), (1, 0, 1, "two", 0)], "doc_id int, article_index int, seg_seq int, text string, batch int")
    rows = replies.where("body is not null").select(F.lit(1).alias("doc_id"), F.lit(0).alias("article_index"), F.lit(0).alias("batch"), "attempt", "body")
    assert sorted((r["seg_seq"], r["zh"]) for r in translate.parsed_replies(batched, rows).collect()) == [(0, "one"), (1, "two")]


def test_batches_against_a_plain_walk(spark):
    import random

    r = random.Random(3)
    docs = {d: [r.choice([10, 300, 900, 2400, 2401, 3000]) for _ in range(r.randint(1, 30))] for d in range(60)}
    rows = [(d, 0, k, "x" * n) for d, ns in docs.items() for k, n in enumerate(ns)]
    got = {(x["doc_id"], x["seg_seq"]): x["batch"] for x in translate.batches(spark.createDataFrame(rows, "doc_id int, article_index int, seg_seq int, text string").repartition(5)).collect()}
    for d, ns in docs.items():
        batch, items, chars = 0, 0, 0
        for k, n in enumerate(ns):
            if items and (items == 8 or chars + n > 2400):
                batch, items, chars = batch + 1, 0, 0
            items, chars = items + 1, chars + n
            assert got[d, k] == batch


def test_progress_stream_matches_the_batch(spark, tmp_path):
    rows = [("a", s, s >= 1, s >= 2, 2 if s >= 3 else 0, max(0, s - 4) if s >= 4 else None) for s in range(8)] + [("b", 0, False, False, 0, None), ("b", 1, True, False, 0, None), ("b", 2, True, False, 0, None)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == k], progress.SNAPSHOT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(progress.SNAPSHOT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    run = progress.stage_stream(stream).writeStream.format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = {(r["job_id"], r["seq"], r["stage"]) for r in spark.sql("select * from stages").collect()}
    want = {(r["job_id"], r["seq"], r["stage"]) for r in jobs.stage_changes(spark.createDataFrame(rows, progress.SNAPSHOT)).collect()}
    assert got == want and ("a", 6, "finished 2 article(s)") in got


class Page:
    def __init__(self, lines):
        self.rect = type("Rect", (), {"width": 595.0, "height": 842.0})()
        self.lines = lines

    def get_text(self, kind):
        assert kind == "dict"
        spans = lambda parts: [{"font": f, "text": s, "size": z} for f, s, z in parts]
        return {"blocks": [{"type": 1}, {"lines": [{"bbox": (10.0, y, 300.0, y + 12), "spans": spans(parts)} for y, parts in self.lines]}]}


class Pdf(list):
    __enter__, __exit__ = lambda self: self, lambda self, *a: None


def test_pdf_lines_enter_the_engine(spark, monkeypatch):
    """A stand-in for the library, read as a task would, and all the way to formulas and paragraphs."""
    import sys
    import types

    from quire.operators import noise, reflow, regions

    body = [(100.0 + 14 * k, [("Times", f"A  line\xa0of  prose {k}", 12.0), ("Times-Bold", " and more.", 11.0)]) for k in range(12)]
    formula = [(100.0 + 14 * 12 + 10, [("CMMI10", "E = mc", 12.0)])]
    pages = Pdf([Page(body + formula + [(400.0, [("Times", " \n ", 12.0)])]), Page([(800.0, [("Times", "2", 9.0)]), (90.0, [("Times", "The last words stand here.", 12.0)])])])
    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda path: pages))
    rows = list(pdf.PdfReader({"path": "/x/an article.pdf"}).read(pdf.OneFile("/x/an article.pdf")))
    assert [r[1] for r in rows] == list(range(15)) and rows[0][9:11] == ("A line of prose 0 and more.", 12.0)
    raw = spark.createDataFrame(rows, pdf.SCHEMA)
    lines = pdf.as_lines(raw)
    assert lines.where("math_only").count() == 1 and pdf.as_pages(raw).count() == 2 and pdf.stems(raw).first()["stem"] == "an article"
    kept = noise.strip_noise(lines, pdf.as_pages(raw))
    paragraphs = reflow.reflow(regions.mask_special_regions(kept))
    assert [r["special"] for r in paragraphs.orderBy("para_seq").collect()].count("formula") == 1 and paragraphs.where("text = '2'").count() == 0
    crop = reflow.crops(paragraphs).first()
    assert (crop["page"], crop["x0"], crop["x1"], crop["zoom"]) == (0, 6.0, 304.0, 200 / 72)


def test_items_without_a_reference_have_no_metric(spark):
    from quire.operators import metrics

    made = spark.createDataFrame([("a", "x"), ("b", "y")], "item string, text string")
    got = metrics.boundary_f1(made, made.where("item = 'a'"), ["item"], made.select("item"))
    assert {r["item"]: r["f1"] for r in got.collect()} == {"a": 1.0, "b": None}


def test_dropped_paragraphs_are_told(spark):
    from quire.operators import noise

    rows = spark.createDataFrame([(1, 0, "English text", True), (1, 0, "中文", False), (1, 0, "More of it", False)], "doc_id int, article_index int, text string, is_heading boolean")
    kept, lost = noise.english_paragraphs(rows, spark.createDataFrame([(1, 0, "t" * 60)], "doc_id int, article_index int, title string"))
    assert [(r["text"], r["is_heading"]) for r in kept.collect()] == [("English text", True), ("More of it", False)]
    assert lost.first().asDict() == {"doc_id": 1, "article_index": 0, "n_dropped": 1, "title": "t" * 40, "severity": "info"}


def test_pdf_source_says_what_is_missing(spark):
    if not pdf.available():
        try:
            pdf.read_pdfs(spark, ["a.pdf"])
        except RuntimeError as e:
            assert "pymupdf" in str(e)
        else:
            raise AssertionError
