"""Terminology, boundaries, scores and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t

#: Prices for a million tokens, samples of a judge, characters a judge and a baseline see.
PRICE_IN, PRICE_OUT, SAMPLES, JUDGE_CHARS, BASELINE_CHARS = 0.27, 1.10, 6, 1500, 12000
#: Rows of a glossary that may be broadcast.
SMALL = 100_000


def term_occurrences(pairs: DataFrame, glossary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a pair and term: pairs' keys, term, zh, hit.

    A term's first run of letters and digits stands as a token of its own wherever the term does, so tokens and terms meet in an equi-join,
    which a checked, small glossary turns into a broadcast hash join; only what meets is tested with the boundaries of the whole term.
    `by`: columns that a pair and the glossary share, such as an item with its own domains."""
    by = by or []
    keys = [c for c in pairs.columns if c not in ("en", "zh", "failed", "is_heading")]
    live = pairs.where(~F.coalesce("failed", F.lit(False)) & (F.coalesce("en", F.lit("")) != "")).withColumn("low", F.lower("en")).withColumn("zh", F.coalesce("zh", F.lit("")))
    terms = glossary.select(*by, F.col("en_lower").alias("term"), F.col("zh").alias("rendering"), F.regexp_extract("en_lower", "[a-z0-9]+", 0).alias("token"))
    terms = terms.withColumn("variants", t.zh_variants(F.col("rendering")))
    tokens = live.withColumn("token", F.explode(F.array_distinct(F.concat(F.split("low", "[^a-z0-9]+"), F.array(F.lit(""))))))
    few = F.broadcast(terms) if terms.limit(SMALL + 1).count() <= SMALL else terms
    met = tokens.join(few, [*by, "token"]).where(F.contains("low", "term") & t.has_term(F.col("low"), F.col("term")))
    hit = F.exists("variants", lambda v: F.contains("zh", v))
    return met.withColumn("hit", hit).drop("zh").withColumnRenamed("rendering", "zh").select(*keys, "term", "zh", "hit")


def adherence(occurrences: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(.., adherence, n_occurrences); 1.0 of 0 where there are none (without keys only)."""
    return occurrences.groupBy(*(by or [])).agg(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(1.0)).alias("adherence"), F.count(F.lit(1)).alias("n_occurrences"))


def consistency(occurrences: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(.., consistency, n_terms): of the terms that occur twice or more, the share that hits everywhere."""
    by = by or []
    terms = occurrences.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"), F.bool_and("hit").alias("all_hit")).where("n >= 2")
    return terms.groupBy(*by).agg(F.coalesce(F.avg(F.col("all_hit").cast("int")), F.lit(1.0)).alias("consistency"), F.count(F.lit(1)).alias("n_terms"))


def boundary_f1(produced: DataFrame, reference: DataFrame, by: list[str], items: DataFrame | None = None) -> DataFrame:
    """produced and reference (.., text): F1 of equal paragraphs. A repeated paragraph counts in its list's length, once among the matches.
    items: keys that are to have a row in any case, with null f1 where there is no reference."""
    clean = lambda df: df.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''").select(*by, "text")
    made, known = clean(produced), clean(reference)
    matches = made.distinct().join(known.distinct(), [*by, "text"]).groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    size = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    rows = size(known, "n_reference").join(size(made, "n_produced"), by, "left").join(matches, by, "left").fillna(0, ["n_produced", "m"])
    precision = F.when(F.col("n_produced") > 0, F.col("m") / F.col("n_produced")).otherwise(0.0)
    recall = F.col("m") / F.col("n_reference")
    f1 = F.when(precision + recall == 0, 0.0).otherwise(F.round(2 * precision * recall / (precision + recall), 3))
    rows = rows.select(*by, "n_produced", "n_reference", F.col("m").alias("n_matches"), f1.alias("f1"))
    return rows if items is None else items.select(*by).distinct().join(rows, by, "left")


def judge_samples(pairs: DataFrame, by: list[str], order: list[str], most: int = SAMPLES) -> DataFrame:
    """Pairs for a judge: evenly spread over what can be scored, six at most, cut to what the judge sees."""
    rows = pairs.where(~F.coalesce("failed", F.lit(False)) & (F.coalesce("en", F.lit("")) != ""))
    doc = Window.partitionBy(*by)
    rows = rows.withColumn("place", F.row_number().over(doc.orderBy(*order)) - 1).withColumn("step", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(doc) / most)))
    chosen = rows.where((F.col("place") % F.col("step") == 0) & (F.col("place") < most * F.col("step")))
    return chosen.withColumn("sample", (F.col("place") / F.col("step")).cast("int")).withColumn("en", t.preview(F.col("en"), JUDGE_CHARS)).withColumn("zh", t.preview(F.col("zh"), JUDGE_CHARS)).drop("place", "step")


def judge_means(replies: DataFrame, by: list[str]) -> DataFrame:
    """replies (.., body) of a judge to mean scores; what can't be read is left out, nothing readable gives nulls."""
    table = t.repaired_json(t.strip_fences(F.col("body")), "map<string,string>")
    score = lambda name: F.element_at("table", name).try_cast("int")
    rows = replies.withColumn("table", table).withColumn("a", score("accuracy")).withColumn("f", score("fluency"))
    good = F.col("a").isNotNull() & F.col("f").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(good, F.col(c))), 2)
    return rows.groupBy(*by).agg(mean("a").alias("accuracy"), mean("f").alias("fluency"), F.count_if(good).alias("n"))


def split_accuracy(articles: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (doc_id, expected_articles) with the articles found and whether the number is right."""
    found = articles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_articles"))
    return manifest.join(found, "doc_id", "left").fillna(0, ["n_articles"]).withColumn("correct", F.col("n_articles") == F.col("expected_articles"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def usage_cost(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(.., llm_calls, tokens_in, tokens_out, cost_usd) of usage rows (.., input_tokens, output_tokens)."""
    sums = usage.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("llm_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_out"))
    return sums.withColumn("cost_usd", F.round(cost(F.col("tokens_in"), F.col("tokens_out")), 4))


def baseline_text(lines: DataFrame, most: int = BASELINE_CHARS) -> DataFrame:
    """(doc_id, text, truncated): pages joined by line breaks, as far as a single prompt goes."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_seq", "text"))), lambda x: x["text"]), "\n")
    whole = lines.groupBy("doc_id").agg(listed.alias("whole"))
    return whole.select("doc_id", t.preview(F.col("whole"), most).alias("text"), (F.length("whole") > most).alias("truncated"))


def baseline_adherence(whole: DataFrame, glossary: DataFrame) -> DataFrame:
    """A single prompt's output (doc_id, en, zh) as one pair a document."""
    return adherence(term_occurrences(whole.withColumn("failed", F.lit(False)), glossary), ["doc_id"])


def evaluation(pairs: DataFrame, glossary: DataFrame, item: str, by: list[str] | None = None) -> DataFrame:
    """Adherence and consistency of each item, and of the corpus over all items' occurrences (item null), each item with its own terms."""
    found = term_occurrences(pairs, glossary, by)
    each = adherence(found, [item]).join(consistency(found, [item]), item, "left").select(item, "adherence", "n_occurrences", F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    corpus = adherence(found).crossJoin(consistency(found)).select(F.lit(None).cast(pairs.schema[item].dataType).alias(item), "adherence", "n_occurrences", "consistency", "n_terms")
    return each.unionByName(corpus)
