"""Queries of the glossary and of terms."""

from pyspark.sql import functions as F

from quire.operators import glossary as g
from quire.operators import metrics as m
from quire.plans.registry import query
from quire.plans.shared import GLOSSARY_SQL, LINES_SQL, MERGED_SQL, PAIRS_SQL, TERM_SCHEMA, TERMS, glossary, lines, ranks, rendered_pairs
from quire.sources import tables

AS_OF = "2024-06-01"
FIELDS = "domain, en_lower, en, zh, category, source, added_date"


@query("glossary_load", f"SELECT {FIELDS} FROM {GLOSSARY_SQL} WHERE domain = 'econ'")
def glossary_load(spark, sf_dir):
    return g.load(glossary(spark), "econ")


@query("glossary_merge", f"SELECT {FIELDS}, domain_rank FROM {MERGED_SQL}")
def glossary_merge(spark, sf_dir):
    return g.merged(glossary(spark), ranks(spark))


NEW_SQL = f"""docs AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS en, unnest(range(len(ws)))::INTEGER AS seq FROM docs),
    firsts AS (SELECT 'cs' AS domain, lower(en) AS en_lower, en FROM words QUALIFY row_number() OVER (PARTITION BY lower(en) ORDER BY doc_id, seq) = 1),
    added AS (SELECT f.domain, f.en_lower, f.en, '新' AS zh, 'uncategorized' AS category, 'web_search' AS source, '{AS_OF}' AS added_date FROM firsts f ANTI JOIN {GLOSSARY_SQL} g USING (domain, en_lower))"""


def new_terms(spark, sf_dir):
    """Every word of every document as a new term."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("seq", "en"))
    nothing = F.lit(None).cast("string")
    return rows.select(F.lit("cs").alias("domain"), "en", F.lit("新").alias("zh"), nothing.alias("category"), nothing.alias("source"), nothing.alias("added_date"), "doc_id", "seq")


@query("glossary_add", f"WITH {NEW_SQL} SELECT {FIELDS} FROM added UNION ALL SELECT {FIELDS} FROM {GLOSSARY_SQL}")
def glossary_add(spark, sf_dir):
    return g.add_terms(glossary(spark), new_terms(spark, sf_dir), ["doc_id", "seq"], AS_OF)[0]


@query("glossary_added", f"WITH {NEW_SQL} SELECT {FIELDS} FROM added")
def glossary_added(spark, sf_dir):
    return g.add_terms(glossary(spark), new_terms(spark, sf_dir), ["doc_id", "seq"], AS_OF)[1]


KEYS = [("econ", "THE"), ("econ", "unknown"), ("cs", "That"), ("pm", "license")]


@query("glossary_remove", f"SELECT {FIELDS}, (domain, en_lower) IN (('econ', 'the'), ('cs', 'that')) AS removed FROM {GLOSSARY_SQL}")
def glossary_remove(spark, sf_dir):
    kept, gone = g.remove_terms(glossary(spark), tables.fixture(spark, KEYS, "domain string, en string"))
    return kept.withColumn("removed", F.lit(False)).unionByName(gone.withColumn("removed", F.lit(True)))


SEEDS = [("econ", 0, "Reseeded", "再", None, "seed", "2023-01-01"), ("pm", 0, "Roadmap", "路线图", "plan", "seed", "2023-01-01"), ("pm", 1, "roadmap", "路线", None, "seed", None), ("pm", 2, "Sprint", "冲刺", None, None, None)]
SEED_SCHEMA = "domain string, seq int, en string, zh string, category string, source string, added_date string"
SEEDED_SQL = f"""fresh AS (SELECT * FROM {tables.sql_values(SEEDS, SEED_SCHEMA)} WHERE domain NOT IN ('econ', 'cs')),
    firsts AS (SELECT domain, lower(en) AS en_lower, en, zh, coalesce(category, 'uncategorized') AS category, coalesce(source, 'web_search') AS source, coalesce(added_date, '{AS_OF}') AS added_date
               FROM fresh QUALIFY row_number() OVER (PARTITION BY domain, lower(en) ORDER BY seq) = 1)"""


@query("glossary_seed_once", f"WITH {SEEDED_SQL} SELECT {FIELDS} FROM {GLOSSARY_SQL} UNION ALL SELECT {FIELDS} FROM firsts ANTI JOIN {GLOSSARY_SQL} g USING (domain, en_lower)")
def glossary_seed_once(spark, sf_dir):
    """econ was seeded before, pm is new."""
    return g.seed_once(glossary(spark), tables.fixture(spark, [("econ",), ("cs",)], "domain string"), tables.fixture(spark, SEEDS, SEED_SCHEMA), AS_OF)[0]


@query("glossary_upgrade", "SELECT doc_id, CASE source WHEN 'src1' THEN 'econ' WHEN 'src2' THEN 'cs' ELSE source END AS domain FROM documents")
def glossary_upgrade(spark, sf_dir):
    """Documents as rows of the older schema, two of their sources as its styles; upgraded twice."""
    style = F.when(F.col("source") == "src1", "economist").when(F.col("source") == "src2", "academy").otherwise(F.col("source"))
    return g.upgraded(g.upgraded(tables.read(spark, sf_dir, "documents").select("doc_id", style.alias("style"))))


@query("known_terms", f"SELECT string_agg(en, ', ' ORDER BY en) AS known FROM {MERGED_SQL}")
def known_terms(spark, sf_dir):
    return g.known_terms(g.merged(glossary(spark), ranks(spark)))


CANDIDATES_SQL = f"""texts AS (SELECT doc_id, 0 AS article_index, text AS full_text FROM documents),
    ws AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents),
    raws AS (SELECT doc_id, 0 AS article_index, unnest(ws) || CASE WHEN unnest(range(len(ws))) % 9 = 8 THEN ' missing words' ELSE ' ' END AS raw, unnest(range(len(ws)))::INTEGER AS cand_seq FROM ws),
    cands AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS term FROM raws),
    firsts AS (SELECT * FROM cands WHERE term <> '' AND length(term) <= 50 AND len(string_split_regex(term, '\\s+')) <= 5 AND lower(term) NOT IN (SELECT en_lower FROM {GLOSSARY_SQL})
               QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY cand_seq) = 1),
    terms AS (SELECT c.doc_id, c.article_index, cand_seq, term FROM firsts c JOIN texts t USING (doc_id) WHERE contains(lower(full_text), lower(term))),
    candidates AS (SELECT * FROM terms QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cand_seq) <= 8)"""


def texts(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("article_index"), F.col("text").alias("full_text"))


def candidates(spark, sf_dir):
    """All words of a document; every ninth is made one that the text doesn't hold."""
    ws = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(ws).alias("cand_seq", "w"))
    raw = F.concat("w", F.when(F.col("cand_seq") % 9 == 8, " missing words").otherwise(" "))
    return g.filter_candidates(rows.select("doc_id", F.lit(0).alias("article_index"), "cand_seq", raw.alias("raw")), texts(spark, sf_dir), glossary(spark))


@query("candidate_filter", f"WITH {CANDIDATES_SQL} SELECT doc_id, article_index, cand_seq, term FROM candidates")
def candidate_filter(spark, sf_dir):
    return candidates(spark, sf_dir)


RULINGS_SQL = f"""{CANDIDATES_SQL},
    rulings AS (SELECT c.*, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN 'reject' WHEN cand_seq % 4 = 1 THEN 'rewrite' ELSE 'keep' END AS verdict,
                       CASE cand_seq % 3 WHEN 0 THEN left(term, 2) WHEN 1 THEN 'no such words' ELSE '' END AS minimal, t.full_text FROM candidates c JOIN texts t USING (doc_id) LEFT JOIN labels l USING (doc_id)),
    finals AS (SELECT *, coalesce(verdict = 'reject' OR (verdict = 'rewrite' AND (minimal = '' OR NOT contains(lower(full_text), lower(minimal)))), false) AS lost, CASE WHEN verdict = 'rewrite' THEN minimal ELSE term END AS final FROM rulings)"""


@query(
    "verdict_apply",
    f"""WITH {RULINGS_SQL} SELECT doc_id, article_index, cand_seq, 'rejected' AS outcome, term FROM finals WHERE lost UNION ALL
        SELECT doc_id, article_index, cand_seq, 'accepted', final FROM (SELECT * FROM finals WHERE NOT lost AND lower(final) NOT IN (SELECT en_lower FROM {GLOSSARY_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(final) ORDER BY cand_seq) = 1)""",
)
def verdict_apply(spark, sf_dir):
    """Labels stand for a judge: bad documents' terms are rejected, some others rewritten, unlabelled ones not ruled on."""
    found = candidates(spark, sf_dir)
    labels = tables.read(spark, sf_dir, "labels").select("doc_id", "quality")
    ruled = found.join(labels, "doc_id").withColumn("verdict", F.when(F.col("quality") == 0, "reject").when(F.col("cand_seq") % 4 == 1, "rewrite").otherwise("keep"))
    minimal = F.when(F.col("cand_seq") % 3 == 0, F.substr("term", F.lit(1), F.lit(2))).when(F.col("cand_seq") % 3 == 1, "no such words").otherwise("")
    return g.apply_verdicts(found, g.normal_verdicts(ruled.withColumn("minimal", minimal)), texts(spark, sf_dir), glossary(spark))


ACCEPTED = [(1, 0, 0, "Swap Line"), (1, 0, 1, "Basis"), (2, 0, 0, "swap line"), (2, 1, 0, "Carry")]
DIGESTS = [(1, 0, "Swap Line", "d"), (2, 1, "Carry", "d")]
RENDERED = [(1, 0, "Swap Line", "互换额度"), (1, 0, "Basis", " "), (2, 0, "swap line", "掉期"), (2, 0, "Swap Line", "x"), (2, 1, "Carry", "套利")]
KEYED = "doc_id int, article_index int, "


def resolved(spark):
    one = lambda rows, rest: tables.fixture(spark, rows, KEYED + rest)
    return g.resolved_terms(one(ACCEPTED, "cand_seq int, term string"), one(DIGESTS, "term string, digest string"), one(RENDERED, "term string, zh string"))


RESEARCH_SQL = f"""accepted AS (SELECT * FROM {tables.sql_values(ACCEPTED, KEYED + "cand_seq int, term string")}), digests AS (SELECT * FROM {tables.sql_values(DIGESTS, KEYED + "term string, digest string")}),
    rendered AS (SELECT * FROM {tables.sql_values(RENDERED, KEYED + "term string, zh string")}),
    resolved AS (SELECT a.*, trim(r.zh) AS zh, CASE WHEN d.term IS NULL THEN 'llm_fallback' ELSE 'web_search' END AS source FROM accepted a JOIN rendered r USING (doc_id, article_index, term) LEFT JOIN digests d USING (doc_id, article_index, term) WHERE trim(r.zh) <> '')"""


@query("term_research", f"WITH {RESEARCH_SQL} SELECT * FROM resolved")
def term_research(spark, sf_dir):
    return resolved(spark)


@query(
    "glossary_update",
    f"""WITH {RESEARCH_SQL}, placed AS (SELECT CASE doc_id WHEN 1 THEN 'econ' ELSE 'cs' END AS domain, lower(term) AS en_lower, term AS en, zh, 'uncategorized' AS category, source, '{AS_OF}' AS added_date, doc_id, article_index, cand_seq FROM resolved),
        firsts AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY domain, en_lower ORDER BY doc_id, article_index, cand_seq) = 1)
        SELECT {FIELDS} FROM firsts ANTI JOIN {GLOSSARY_SQL} g USING (domain, en_lower)""",
)
def glossary_update(spark, sf_dir):
    return g.updated(glossary(spark), resolved(spark), tables.fixture(spark, [(1, "econ"), (2, "cs")], "doc_id int, domain string"), AS_OF)[1]


HITS_SQL = "hits AS (SELECT conv_id AS term, turn + 1 AS rank, role AS title, CASE WHEN turn % 4 = 1 THEN ' ' ELSE text END AS content FROM conversations)"


@query(
    "search_digests",
    f"""WITH {HITS_SQL} SELECT term, string_agg('- ' || coalesce(title, '') || ': ' || left(content, 240), chr(10) ORDER BY rank) AS digest, count(*) AS n_hits FROM hits WHERE rank <= 3 AND trim(coalesce(content, '')) <> '' GROUP BY term""",
)
def search_digests(spark, sf_dir):
    """Conversations as searches and turns as their hits, some without content."""
    content = F.when(F.col("turn") % 4 == 1, " ").otherwise(F.col("text"))
    return tables.search_digests(tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("term"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("title"), content.alias("content")))


@query(
    "glossary_constraints",
    f"""WITH hits AS (SELECT d.doc_id, 0 AS article_index, g.en_lower, g.en, g.zh FROM documents d JOIN {MERGED_SQL} g ON contains(lower(d.text), g.en_lower)),
        top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY en_lower) AS place FROM hits QUALIFY place <= 40)
        SELECT doc_id, article_index, count(*) AS n_terms, string_agg('- ' || en || ' => ' || zh, chr(10) ORDER BY place) AS block FROM top GROUP BY doc_id, article_index""",
)
def glossary_constraints(spark, sf_dir):
    return g.constraints(texts(spark, sf_dir), g.merged(glossary(spark), ranks(spark)))


@query("audit_chunks", f"SELECT {FIELDS}, ((row_number() OVER (PARTITION BY domain ORDER BY en_lower) - 1) // 30)::INTEGER AS chunk, CASE domain WHEN 'econ' THEN 'economist' ELSE 'academy' END AS style FROM {GLOSSARY_SQL} WHERE source <> 'seed'")
def audit_chunks(spark, sf_dir):
    return g.audit_chunks(glossary(spark))


RULED = [("econ", " The ", "reject", ""), ("econ", "license", "reject", ""), ("cs", "public license", "rewrite", "license"), ("pm", "version", "keep", "")]


@query("glossary_audit", f"SELECT {FIELDS}, CASE (domain, en_lower) WHEN ('econ', 'the') THEN 'reject' WHEN ('cs', 'public license') THEN 'rewrite' END AS verdict FROM {GLOSSARY_SQL}")
def glossary_audit(spark, sf_dir):
    kept, gone = g.audited(glossary(spark), tables.fixture(spark, RULED, "domain string, en string, verdict string, minimal string").withColumnRenamed("en", "en_lower"), AS_OF)
    return kept.withColumn("verdict", F.lit(None).cast("string")).unionByName(gone.drop("minimal_form", "audited_date"))


#: Of the relation pairs.
HITS_OF_PAIRS = rf"""variants AS (SELECT en_lower AS term, zh, list_filter(list_transform([zh, string_split(zh, '（')[1], replace(replace(zh, '《', ''), '》', '')], lambda v: trim(v)), lambda v: length(v) >= 2) AS vs FROM {MERGED_SQL}),
    occurrences AS (SELECT p.doc_id, p.seg_seq, v.term, v.zh, len(list_filter(v.vs, lambda x: contains(p.zh, x))) > 0 AS hit FROM pairs p JOIN variants v
                    ON NOT p.failed AND p.en <> '' AND contains(lower(p.en), v.term) AND regexp_matches(lower(p.en), '(^|[^a-z0-9])' || regexp_escape(v.term) || '($|[^a-z0-9])'))"""
OCCURRENCES_SQL = f"{LINES_SQL}, {PAIRS_SQL}, {HITS_OF_PAIRS}"


def occurrences(spark, sf_dir):
    return m.term_occurrences(rendered_pairs(spark, sf_dir), g.merged(glossary(spark), ranks(spark)))


@query("term_occurrences", f"WITH {OCCURRENCES_SQL} SELECT doc_id, seg_seq, term, zh, hit FROM occurrences")
def term_occurrences(spark, sf_dir):
    return occurrences(spark, sf_dir)


@query("adherence_by_document", f"WITH {OCCURRENCES_SQL} SELECT doc_id, avg(hit::INTEGER) AS adherence, count(*) AS n_occurrences FROM occurrences GROUP BY doc_id")
def adherence_by_document(spark, sf_dir):
    return m.adherence(occurrences(spark, sf_dir), ["doc_id"])


@query("consistency", f"WITH {OCCURRENCES_SQL}, terms AS (SELECT term, bool_and(hit) AS a FROM occurrences GROUP BY term HAVING count(*) >= 2) SELECT coalesce(avg(a::INTEGER), 1.0)::DOUBLE AS consistency, count(*) AS n_terms FROM terms")
def consistency(spark, sf_dir):
    return m.consistency(occurrences(spark, sf_dir))


METRICS_SQL = f"""{OCCURRENCES_SQL}, every AS (SELECT d.lang, o.* FROM occurrences o JOIN documents d USING (doc_id)),
    terms AS (SELECT lang, term, bool_and(hit) AS a, count(*) AS n FROM every GROUP BY lang, term), corpus AS (SELECT term, bool_and(hit) AS a FROM every GROUP BY term HAVING count(*) >= 2)
    SELECT lang, avg(hit::INTEGER) AS adherence, count(*) AS n_occurrences, coalesce((SELECT avg(a::INTEGER) FROM terms t WHERE t.lang = every.lang AND n >= 2), 1.0)::DOUBLE AS consistency, (SELECT count(*) FROM terms t WHERE t.lang = every.lang AND n >= 2) AS n_terms FROM every GROUP BY lang
    UNION ALL SELECT NULL, (SELECT avg(hit::INTEGER) FROM every), (SELECT count(*) FROM every), avg(a::INTEGER), count(*) FROM corpus"""


@query("term_metrics", f"WITH {METRICS_SQL}")
def term_metrics(spark, sf_dir):
    """Each language is an item of the evaluation; the row without one is the corpus."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return m.evaluation(rendered_pairs(spark, sf_dir).join(docs, "doc_id"), g.merged(glossary(spark), ranks(spark)), "lang")


BASELINE_SQL = "w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page, line_seq) AS whole FROM lines GROUP BY doc_id)"


@query(
    "baseline_adherence",
    f"""WITH {LINES_SQL}, {BASELINE_SQL}, pairs AS (SELECT doc_id, 0 AS seg_seq, left(whole, 12000) AS en, replace(lower(left(whole, 12000)), 'license', '许可证') AS zh, false AS failed FROM w), {HITS_OF_PAIRS}
        SELECT doc_id, avg(hit::INTEGER) AS adherence, count(*) AS n_occurrences FROM occurrences GROUP BY doc_id""",
)
def baseline_adherence(spark, sf_dir):
    """A single prompt sees the start of a document; its rendering is one pair."""
    whole = m.baseline_text(lines(spark, sf_dir)).select("doc_id", F.col("text").alias("en"), F.replace(F.lower("text"), F.lit("license"), F.lit("许可证")).alias("zh"))
    return m.baseline_adherence(whole, g.merged(glossary(spark), ranks(spark)))


@query("baseline_text", f"WITH {LINES_SQL}, {BASELINE_SQL} SELECT doc_id, left(whole, 12000) AS text, length(whole) > 12000 AS truncated FROM w")
def baseline_text(spark, sf_dir):
    return m.baseline_text(lines(spark, sf_dir))


assert len({(d, k) for d, k, *_ in TERMS}) == len(TERMS)
