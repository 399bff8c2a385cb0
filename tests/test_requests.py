"""Each call to a model, from the request through a reply to the operator that reads it."""

import pytest
from pyspark.sql import functions as F

from quire.operators import glossary as g
from quire.operators import metrics as m
from quire.operators import reflow, requests, segments
from quire.plans import stages
from quire.sources import boundary

GLOSSARY = [("econ", "yield", "Yield", "收益率", "c", "seed", "2024-01-01")]


@pytest.fixture(scope="module")
def reply():
    """A table of replies, by kind."""

    import json
    import re

    def reply(kind, payload, max_tokens):
        if "Never answered" in payload:
            raise TimeoutError("no answer")
        body = payload.split("\n\n", 1)[1]
        table = {
            "confirm_headings": lambda: json.dumps({"article_start_ids": [int(re.search(r"\[(\d+)\]", body)[1])]}) if "Real" in body else "no json",
            "extract_terms": lambda: '```json\n{"terms": ["Swap Line", "swap line", "Yield", "not in it", "Carry"]}\n```',
            "judge_terms": lambda: json.dumps({"verdicts": [{"term": "Carry", "verdict": "reject"}, {"term": "swap line", "verdict": "rewrite", "minimal": "Swap"}, {"term": "x", "verdict": "maybe"}]}),
            "resolve_terms": lambda: '{"Swap Line": "互换额度", "Basis": " "',
            "transcribe_formula": lambda: "$E = mc^2$",
            "judge_pairs": lambda: '{"accuracy": 4, "fluency": 5}' if "good" in body else "none",
            "baseline": lambda: "整篇",
        }
        return table[kind](), len(payload), 10

    return reply


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([(1, 0, "A swap line and its carry; yield. Swap lines."), (2, 0, "Never answered")], "doc_id long, article_index int, full_text string")


def test_headings(spark, reply):
    rows = [(d, k, 0, 20.0 if k % 2 == 0 else 12.0, None, f"{'Real' if d == 1 else 'Other'} heading {k}", k % 2 == 0, k % 2 == 0) for d in (1, 2) for k in range(4)] + [(3, 0, 0, 12.0, None, "plain", False, False)]
    paragraphs = spark.createDataFrame(rows, "doc_id long, para_seq int, page int, font_size double, special string, text string, is_heading boolean, font_heading boolean")
    found = segments.heading_candidates(paragraphs)
    ids = requests.heading_ids(boundary.answer(requests.headings(found), reply, attempts=2))
    assert {(r["doc_id"], r["para_seq"], r["fallback"]) for r in segments.confirmed_starts(found, ids).collect()} == {(1, 0, False), (2, 0, True), (2, 2, True)}
    assert {(r["doc_id"], r["note"].split(";")[0]) for r in segments.notes(paragraphs, found, ids).collect()} == {(2, "no reply confirmed a heading"), (3, "no headings")}


def test_terms_verdicts_and_renderings(spark, articles, reply):
    glossary = spark.createDataFrame(GLOSSARY, g.SCHEMA)
    asked = requests.terms(articles, g.known_terms(glossary))
    assert "Known: Yield" in asked.first()["payload"]
    replies = boundary.answer(asked, reply)
    assert [r["key"] for r in boundary.errors(replies).collect()] == ["2/0"]  # no candidates, and that is all
    found = g.filter_candidates(requests.named_terms(replies), articles, glossary)
    assert [(r["doc_id"], r["cand_seq"], r["term"]) for r in found.orderBy("cand_seq").collect()] == [(1, 0, "Swap Line"), (1, 4, "Carry")]
    ruled = g.normal_verdicts(requests.rulings(boundary.answer(requests.verdicts(found, "economist"), reply)))
    done = g.apply_verdicts(found, ruled, articles, glossary)
    assert {(r["outcome"], r["term"]) for r in done.collect()} == {("accepted", "Swap"), ("rejected", "Carry")}
    digests = found.where("term = 'Swap Line'").withColumn("digest", F.lit("- a: b"))
    asked = requests.resolutions(found, digests)
    assert asked.first()["payload"].endswith("- Swap Line: - a: b\n- Carry: (nothing found)")
    got = g.resolved_terms(found, digests, requests.renderings(boundary.answer(asked, reply)))
    assert [(r["term"], r["zh"], r["source"]) for r in got.collect()] == [("Swap Line", "互换额度", "web_search")]


def test_formulas(spark, reply):
    rows = [(1, 0, 0, 12.0, "formula", {"x0": 10.0, "y0": 20.0, "x1": 30.0, "y1": 40.0}, "E = mc"), (1, 1, 0, 12.0, None, None, "Prose.")]
    paragraphs = spark.createDataFrame(rows, f"doc_id long, para_seq int, page int, font_size double, special string, clip {reflow.CLIP}, text string")
    asked = requests.formulas(reflow.crops(paragraphs))
    assert asked.first()["payload"].endswith("0 6.0 16.0 34.0 44.0 2.7777777777777777")
    bodies = requests.key_columns(boundary.answer(asked, reply), "transcribe_formula", ["doc_id", "para_seq"])
    assert [r["text"] for r in reflow.formula_plan(paragraphs, bodies).orderBy("para_seq").collect()] == ["$$\nE = mc^2\n$$", "Prose."]


def test_judge_and_baseline(spark, reply):
    pairs = spark.createDataFrame([(1, k, "good" if k % 2 else "bad", "好", False) for k in range(20)], "item long, seq int, en string, zh string, failed boolean")
    samples = m.judge_samples(pairs, ["item"], ["seq"])
    assert samples.count() == m.SAMPLES
    scores = requests.key_columns(boundary.answer(requests.judgements(samples, ["item"]), reply), "judge_pairs", ["item", "sample"])
    assert m.judge_means(scores, ["item"]).first().asDict() == {"item": 1, "accuracy": 4.0, "fluency": 5.0, "n": 3}
    whole = spark.createDataFrame([(1, "some text", False), (2, "Never answered", True)], "doc_id long, text string, truncated boolean")
    got = requests.baseline_run(whole, boundary.answer(requests.baselines(whole), reply)).orderBy("doc_id").collect()
    assert [(r["zh"], r["truncated"], r["n_articles"]) for r in got] == [("整篇", False, 1), (None, True, 1)]


def test_stages_by_name(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"Line {j} of {k} goes on here for more than forty characters." for j in range(12))) for k in range(3)], "doc_id long, text string")
    assert stages.run(docs, ["lines", "strip_noise", "drop_embedded_translation", "mask_special_regions", "reflow", "articles"]).count() == 3
    with pytest.raises(KeyError):
        stages.run(docs, ["lines", "none"])
    with pytest.raises(ValueError):
        stages.stage("lines")(lambda df: df)
