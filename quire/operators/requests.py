"""What models are asked: one row (kind, key, payload) a call, for quire.sources.boundary. Keys are the keys of the rows that a reply belongs to, joined by slashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.glossary import prompt_text

#: What each kind of call is told.
TASKS = {
    "confirm_headings": 'Which of these numbered headings start an article? Answer {"article_start_ids": [..]}.',
    "extract_terms": 'List up to eight technical terms of the text that are not known yet. Answer {"terms": [..]}.',
    "judge_terms": 'For each term say keep, rewrite or reject, with a minimal form. Answer {"verdicts": [{"term": .., "verdict": .., "minimal": ..}]}.',
    "resolve_terms": 'Give the usual Chinese rendering of each term; what a search found is behind it. Answer {"<term>": "<rendering>"}.',
    "transcribe_formula": "Write the formula in this picture as LaTeX, without dollar signs.",
    "judge_pairs": 'Score accuracy and fluency of this translation from 1 to 5. Answer {"accuracy": .., "fluency": ..}.',
    "baseline": "Translate this document into Simplified Chinese as one Markdown article.",
}
ARTICLE = ["doc_id", "article_index"]


def request(df: DataFrame, kind: str, keys: list[str], body: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key"), F.concat(F.lit(TASKS[kind] + "\n\n"), body).alias("payload"))


def listed(order: list[str], line: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")


def headings(candidates: DataFrame) -> DataFrame:
    """One call a document: its large headings, each with what follows it."""
    line = F.concat(F.lit("["), F.col("para_seq").cast("string"), F.lit("] "), F.col("heading"), F.lit(" / "), F.col("preview"))
    return request(candidates.groupBy("doc_id").agg(listed(["para_seq"], line).alias("body")), "confirm_headings", ["doc_id"], F.col("body"))


def terms(articles: DataFrame, known: DataFrame) -> DataFrame:
    """One call an article (.., full_text): the start of its text, and the known terms (one row)."""
    rows = articles.crossJoin(F.broadcast(known.select("known")))  # one row
    return request(rows, "extract_terms", ARTICLE, F.concat(F.lit("Known: "), F.col("known"), F.lit("\n\n"), prompt_text(F.col("full_text"))))


def verdicts(candidates: DataFrame, style: str) -> DataFrame:
    """One call an article: its candidates (.., cand_seq, term), judged in a style."""
    body = candidates.groupBy(*ARTICLE).agg(listed(["cand_seq"], F.concat(F.lit("- "), F.col("term"))).alias("body"))
    return request(body, "judge_terms", ARTICLE, F.concat(F.lit(f"Style: {style}\n"), F.col("body")))


def resolutions(accepted: DataFrame, digests: DataFrame) -> DataFrame:
    """One call an article: its accepted terms with their search digests (.., term, digest)."""
    rows = accepted.join(digests.select(*ARTICLE, "term", "digest"), [*ARTICLE, "term"], "left")
    line = F.concat(F.lit("- "), F.col("term"), F.lit(": "), F.coalesce("digest", F.lit("(nothing found)")))
    return request(rows.groupBy(*ARTICLE).agg(listed(["cand_seq"], line).alias("body")), "resolve_terms", ARTICLE, F.col("body"))


def formulas(crops: DataFrame) -> DataFrame:
    """One call a formula: the box of its picture, which a responder that has the file cuts out."""
    box = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("page", "x0", "y0", "x1", "y1", "zoom")))
    return request(crops, "transcribe_formula", ["doc_id", "para_seq"], box)


def judgements(samples: DataFrame, by: list[str]) -> DataFrame:
    """One call a sample (.., sample, en, zh)."""
    return request(samples, "judge_pairs", [*by, "sample"], F.concat(F.lit("EN: "), F.col("en"), F.lit("\nZH: "), F.col("zh")))


def baselines(whole: DataFrame) -> DataFrame:
    """One call a document (doc_id, text), whatever it holds."""
    return request(whole, "baseline", ["doc_id"], F.col("text"))


def key_columns(replies: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Replies of one kind that came back, with their keys as whole numbers."""
    part = F.split("key", "/")
    return replies.where((F.col("kind") == kind) & F.col("body").isNotNull()).select(*(part[i].cast("long").alias(k) for i, k in enumerate(keys)), "attempt", "body", "tokens_in", "tokens_out")


def heading_ids(replies: DataFrame) -> DataFrame:
    """(doc_id, attempt, ids) for segments.confirmed_starts; a reply that is no JSON names none."""
    ids = F.from_json(t.strip_fences(F.col("body")), "article_start_ids array<int>")["article_start_ids"]
    return key_columns(replies, "confirm_headings", ["doc_id"]).select("doc_id", "attempt", F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def named_terms(replies: DataFrame) -> DataFrame:
    """(doc_id, article_index, cand_seq, raw) for glossary.filter_candidates."""
    found = t.repaired_json(t.strip_fences(F.col("body")), "terms array<string>")["terms"]
    return key_columns(replies, "extract_terms", ARTICLE).select(*ARTICLE, F.posexplode(found).alias("cand_seq", "raw"))


def rulings(replies: DataFrame) -> DataFrame:
    """(doc_id, article_index, term, verdict, minimal) for glossary.normal_verdicts."""
    found = t.repaired_json(t.strip_fences(F.col("body")), "verdicts array<struct<term:string,verdict:string,minimal:string>>")["verdicts"]
    return key_columns(replies, "judge_terms", ARTICLE).select(*ARTICLE, F.explode(found).alias("v")).select(*ARTICLE, "v.*")


def renderings(replies: DataFrame) -> DataFrame:
    """(doc_id, article_index, term, zh) for glossary.resolved_terms."""
    found = t.repaired_json(t.strip_fences(F.col("body")), "map<string,string>")
    return key_columns(replies, "resolve_terms", ARTICLE).select(*ARTICLE, F.explode(found).alias("term", "zh"))


def baseline_run(whole: DataFrame, replies: DataFrame) -> DataFrame:
    """whole (doc_id, text, truncated) with what the single prompt made of it: always one article; zh null where the call failed."""
    made = key_columns(replies, "baseline", ["doc_id"]).select("doc_id", F.col("body").alias("zh"), "tokens_in", "tokens_out")
    return whole.join(made, "doc_id", "left").withColumn("n_articles", F.lit(1))
