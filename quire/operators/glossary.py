"""The glossary: a relation keyed by domain and lower-cased term, first in wins.

glossary(domain, en_lower, en, zh, category, source, added_date). Every operator returns new relations; a batch's winner depends on its order columns
and not on timing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as t

SCHEMA = "domain string, en_lower string, en string, zh string, category string, source string, added_date string"
#: Limits of candidates and of what a prompt holds.
MAX_CANDIDATES, MAX_CHARS, MAX_WORDS, MAX_CONSTRAINTS, AUDIT_CHUNK, TEXT_CAP = 8, 50, 5, 40, 30, 6000
#: The style that judges a domain's terms, and the domains of an older schema.
JUDGED_BY = {"econ": "economist", "cs": "academy", "pm": "academy"}
OLD_DOMAINS = {"economist": "econ", "academy": "cs"}
#: Terms beyond which a substring join would cost more than an automaton.
MANY_TERMS = 1000


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Seed files {domain, description, terms: [...]} as a glossary; other keys of a term are ignored."""
    term = "struct<en:string,zh:string,category:string,source:string,added_date:string>"
    raw = spark.read.schema(f"domain string, description string, terms array<{term}>").option("multiLine", True).json(path)
    return raw.select("domain", F.posexplode("terms").alias("seq", "x")).select("domain", "seq", "x.*")


def stamped(terms: DataFrame, as_of: str, seeding: bool) -> DataFrame:
    """The stored form of new terms; seeds keep their date, others get today's."""
    date = F.coalesce("added_date", F.lit(as_of)) if seeding else F.lit(as_of)
    return terms.select("domain", F.lower("en").alias("en_lower"), "en", "zh", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("source", F.lit("web_search")).alias("source"), date.alias("added_date"))


def add_terms(glossary: DataFrame, new: DataFrame, order: list[str], as_of: str, seeding: bool = False) -> tuple[DataFrame, DataFrame]:
    """(glossary with the new terms, the terms really added): the first of a batch by `order`, and only where the key is free."""
    first = F.row_number().over(Window.partitionBy("domain", F.lower("en")).orderBy(*order))
    batch = stamped(new.withColumn("rank", first).where("rank = 1"), as_of, seeding)
    added = batch.join(glossary.select("domain", "en_lower"), ["domain", "en_lower"], "left_anti")
    return glossary.unionByName(added.select(*glossary.columns)), added.select(*glossary.columns)


def seed_once(glossary: DataFrame, seeded: DataFrame, seeds: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(glossary, seeded domains): a domain is imported once, so a removed term stays removed."""
    fresh = seeds.join(seeded, "domain", "left_anti")
    grown, _ = add_terms(glossary, fresh, ["seq"], as_of, seeding=True)
    return grown, seeded.union(fresh.select("domain").distinct())


def remove_terms(glossary: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed); keys (domain, en) in any case, unknown ones are ignored."""
    gone = keys.select("domain", F.lower("en").alias("en_lower")).distinct()
    return glossary.join(gone, ["domain", "en_lower"], "left_anti"), glossary.join(gone, ["domain", "en_lower"], "left_semi")


def load(glossary: DataFrame, domain: str) -> DataFrame:
    return glossary.where(F.col("domain") == domain).orderBy("en_lower")


def merged(glossary: DataFrame, ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a term: of the chosen domains (domain, domain_rank) the earliest that has it. `by`: further keys of the ranks, such as an item."""
    keys = [*(by or []), "en_lower"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("domain_rank"))
    return glossary.join(ranks, "domain").withColumn("rank", first).where("rank = 1").drop("rank")


def upgraded(old: DataFrame) -> DataFrame:
    """A table of the older schema (style for domain) in the present one; one of the present schema is unchanged."""
    new = old.withColumnRenamed("style", "domain") if "style" in old.columns else old
    table = F.create_map(*(F.lit(x) for kv in OLD_DOMAINS.items() for x in kv))
    return new.withColumn("domain", F.coalesce(F.element_at(table, F.col("domain")), F.col("domain")))


def known_terms(glossary: DataFrame) -> DataFrame:
    """One row: the terms for a prompt."""
    return glossary.agg(F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_list("en")), ", "), F.lit("")), F.lit("(empty)")).alias("known"))


def filter_candidates(candidates: DataFrame, articles: DataFrame, glossary: DataFrame) -> DataFrame:
    """candidates (doc_id, article_index, cand_seq, raw) to at most eight terms an article: new, short, and in the text (full_text)."""
    key = ["doc_id", "article_index"]
    rows = candidates.withColumn("term", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).withColumn("cand_key", F.lower("term"))
    rows = rows.where(F.col("term").isNotNull() & (F.col("term") != "") & (F.length("term") <= MAX_CHARS) & (F.size(F.split("term", r"(?U)\s+")) <= MAX_WORDS))
    rows = rows.join(glossary.select(F.col("en_lower").alias("cand_key")).distinct(), "cand_key", "left_anti")
    first = F.row_number().over(Window.partitionBy(*key, "cand_key").orderBy("cand_seq"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("cand_seq"))
    rows = rows.withColumn("rank", first).where("rank = 1")  # repeats go before they meet the text
    rows = rows.join(articles.select(*key, F.lower("full_text").alias("low")), key).where(F.contains("low", "cand_key"))
    return rows.drop("low").withColumn("place", place).where(F.col("place") <= MAX_CANDIDATES).select(*key, "cand_seq", "term")


def normal_verdicts(raw: DataFrame) -> DataFrame:
    """raw (doc_id, article_index, term, verdict, minimal) to usable rulings keyed by the lower-cased term."""
    return raw.where(F.col("verdict").isin("keep", "rewrite", "reject")).select("doc_id", "article_index", F.lower(F.trim("term")).alias("cand_key"), "verdict", F.coalesce(F.trim("minimal"), F.lit("")).alias("minimal"))


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame, articles: DataFrame, glossary: DataFrame) -> DataFrame:
    """candidates (doc_id, article_index, cand_seq, term) with outcome accepted or rejected and the accepted form; terms that turn out known
    or repeated are in neither. A candidate without ruling is accepted."""
    key = ["doc_id", "article_index"]
    rows = candidates.withColumn("cand_key", F.lower("term")).join(verdicts, [*key, "cand_key"], "left").join(articles.select(*key, F.lower("full_text").alias("low")), key)
    lost = (F.col("verdict") == "reject") | ((F.col("verdict") == "rewrite") & ((F.col("minimal") == "") | ~F.contains(F.col("low"), F.lower("minimal"))))
    rows = rows.withColumn("lost", F.coalesce(lost, F.lit(False))).withColumn("final", F.when(F.col("verdict") == "rewrite", F.col("minimal")).otherwise(F.col("term")))
    rejected = rows.where("lost").select(*key, "cand_seq", F.lit("rejected").alias("outcome"), "term")
    kept = rows.where(~F.col("lost")).withColumn("en_lower", F.lower("final")).join(glossary.select("en_lower").distinct(), "en_lower", "left_anti")
    first = F.row_number().over(Window.partitionBy(*key, "en_lower").orderBy("cand_seq"))
    accepted = kept.withColumn("rank", first).where("rank = 1").select(*key, "cand_seq", F.lit("accepted").alias("outcome"), F.col("final").alias("term"))
    return accepted.unionByName(rejected)


def resolved_terms(accepted: DataFrame, digests: DataFrame, replies: DataFrame) -> DataFrame:
    """accepted (doc_id, article_index, cand_seq, term) with zh from the replies (.., term, zh) and the source: a search digest, or the model alone.
    Terms without a rendering are left out; the case of a term counts."""
    key = ["doc_id", "article_index", "term"]
    seen = digests.select(*key).distinct().withColumn("found", F.lit(True))
    rows = accepted.join(replies.select(*key, F.trim("zh").alias("zh")), key).where(F.col("zh") != "").join(seen, key, "left")
    return rows.withColumn("source", F.when(F.col("found"), "web_search").otherwise("llm_fallback")).drop("found")


def updated(glossary: DataFrame, terms: DataFrame, first_domains: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """All articles' new terms go to their document's first domain, the first by document, article and place winning: (glossary, added)."""
    new = terms.join(first_domains.select("doc_id", "domain"), "doc_id").select("domain", F.col("term").alias("en"), "zh", F.lit(None).cast("string").alias("category"), "source", "doc_id", "article_index", "cand_seq")
    return add_terms(glossary, new, ["doc_id", "article_index", "cand_seq"], as_of)


def constraints(texts: DataFrame, glossary: DataFrame, most: int = MAX_CONSTRAINTS) -> DataFrame:
    """texts (doc_id, article_index, full_text) to the first `most` terms that occur in them, as plain substrings, by key: one block of lines each.

    A checked, small glossary is broadcast and searched for in one pass; a larger one goes into an automaton, in one pass as well."""
    terms = glossary.select("en_lower", "en", "zh").distinct()
    low = texts.select("doc_id", "article_index", F.lower("full_text").alias("low"))
    if terms.limit(MANY_TERMS + 1).count() <= MANY_TERMS:
        hits = low.join(F.broadcast(terms), F.contains("low", "en_lower")).drop("low")
    else:
        hits = found_by_automaton(low, terms).join(terms, "en_lower")
    place = F.row_number().over(Window.partitionBy("doc_id", "article_index").orderBy("en_lower"))
    top = hits.withColumn("place", place).where(F.col("place") <= most)
    line = F.concat(F.lit("- "), F.col("en"), F.lit(" => "), F.col("zh"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return top.groupBy("doc_id", "article_index").agg(F.count(F.lit(1)).alias("n_terms"), F.array_join(listed, "\n").alias("block"))


def found_by_automaton(low: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, article_index, en_lower) of the terms in each text. The terms of a glossary are a dictionary that people curate; it must fit a task."""
    keys = low.sparkSession.sparkContext.broadcast([r[0] for r in terms.select("en_lower").distinct().toLocalIterator()])

    def find(frames):
        import ahocorasick
        import pandas as pd

        machine = ahocorasick.Automaton()
        for key in keys.value:
            machine.add_word(key, key)
        machine.make_automaton()
        for frame in frames:
            rows = [(d, a, k) for d, a, text in zip(frame.doc_id, frame.article_index, frame.low) for k in {k for _, k in machine.iter(text or "")}]
            yield pd.DataFrame(rows, columns=["doc_id", "article_index", "en_lower"])

    kinds = {f.name: f.dataType.simpleString() for f in low.schema}
    return low.mapInPandas(find, f"doc_id {kinds['doc_id']}, article_index {kinds['article_index']}, en_lower string")


def audit_chunks(glossary: DataFrame) -> DataFrame:
    """Terms to be judged again, all but seeds, in chunks of 30 of a domain, with the judging style."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy("en_lower")) - 1
    table = F.create_map(*(F.lit(x) for kv in JUDGED_BY.items() for x in kv))
    rows = glossary.where(F.col("source") != "seed").withColumn("chunk", F.floor(place / AUDIT_CHUNK).cast("int"))
    return rows.withColumn("style", F.coalesce(F.element_at(table, F.col("domain")), F.lit("academy")))


def audited(glossary: DataFrame, verdicts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): of the terms that are no seeds, those ruled (domain, en_lower, verdict, minimal) reject or rewrite move to the archive."""
    ruled = verdicts.where(F.col("verdict").isin("reject", "rewrite")).select("domain", F.lower(F.trim("en_lower")).alias("en_lower"), "verdict", F.col("minimal").alias("minimal_form")).dropDuplicates(["domain", "en_lower"])
    gone = glossary.where(F.col("source") != "seed").join(ruled, ["domain", "en_lower"])
    archived = gone.withColumn("audited_date", F.lit(as_of))
    return glossary.join(gone.select("domain", "en_lower"), ["domain", "en_lower"], "left_anti"), archived


def prompt_text(full_text: Column) -> Column:
    """What a prompt sees of an article; grounding always uses all of it."""
    return t.preview(full_text, TEXT_CAP)
