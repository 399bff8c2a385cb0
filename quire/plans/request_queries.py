"""Queries of what models are asked."""

from pyspark.sql import functions as F

from quire.operators import glossary as g
from quire.operators import metrics as m
from quire.operators import reflow, regions, requests, segments
from quire.plans.layout_queries import PREVIEW_SQL, marked
from quire.plans.output_queries import TURNS_SQL, turns
from quire.plans.registry import query
from quire.plans.shared import LINES_SQL, MERGED_SQL, glossary, lines, ranks
from quire.plans.term_queries import BASELINE_SQL, CANDIDATES_SQL, candidates, texts


def told(kind: str) -> str:
    return "'" + requests.TASKS[kind].replace("'", "''") + "' || chr(10) || chr(10)"


@query(
    "heading_requests",
    f"WITH {PREVIEW_SQL} SELECT 'confirm_headings' AS kind, doc_id::VARCHAR AS key, {told('confirm_headings')} || string_agg('[' || para_seq || '] ' || heading || ' / ' || preview, chr(10) ORDER BY para_seq) AS payload FROM previews WHERE font_heading GROUP BY doc_id",
)
def heading_requests(spark, sf_dir):
    return requests.headings(segments.heading_candidates(marked(spark, sf_dir)))


@query(
    "term_requests",
    f"""SELECT 'extract_terms' AS kind, doc_id || '/0' AS key, {told('extract_terms')} || 'Known: ' || (SELECT string_agg(en, ', ' ORDER BY en) FROM {MERGED_SQL}) || chr(10) || chr(10) || left(text, 6000) AS payload FROM documents""",
)
def term_requests(spark, sf_dir):
    """The prompt sees the first 6000 characters, which is the rule; what comes back is looked for in all of the text."""
    return requests.terms(texts(spark, sf_dir), g.known_terms(g.merged(glossary(spark), ranks(spark))))


@query(
    "verdict_requests",
    f"WITH {CANDIDATES_SQL} SELECT 'judge_terms' AS kind, doc_id || '/' || article_index AS key, {told('judge_terms')} || 'Style: academy' || chr(10) || string_agg('- ' || term, chr(10) ORDER BY cand_seq) AS payload FROM candidates GROUP BY doc_id, article_index",
)
def verdict_requests(spark, sf_dir):
    return requests.verdicts(candidates(spark, sf_dir), g.JUDGED_BY["cs"])


@query(
    "resolution_requests",
    f"""WITH {CANDIDATES_SQL} SELECT 'resolve_terms' AS kind, doc_id || '/' || article_index AS key, {told('resolve_terms')} || string_agg('- ' || term || ': ' || CASE WHEN cand_seq % 2 = 0 THEN 'seen ' || cand_seq ELSE '(nothing found)' END, chr(10) ORDER BY cand_seq) AS payload
        FROM candidates GROUP BY doc_id, article_index""",
)
def resolution_requests(spark, sf_dir):
    """Candidates as accepted terms, a search having found every second of them."""
    found = candidates(spark, sf_dir)
    return requests.resolutions(found, found.where("cand_seq % 2 = 0").withColumn("digest", F.concat(F.lit("seen "), F.col("cand_seq").cast("string"))))


@query(
    "formula_requests",
    f"""WITH {LINES_SQL}, single AS (SELECT * FROM lines WHERE doc_id % 4 <> 0),
        f AS (SELECT *, coalesce(lag(line_seq % 7 = 3) OVER (PARTITION BY doc_id, page ORDER BY line_seq), false) AS run FROM single)
        SELECT 'transcribe_formula' AS kind, count(*) AS n_calls FROM f WHERE line_seq % 7 = 3 AND NOT run HAVING count(*) > 0""",
)
def formula_requests(spark, sf_dir):
    """Every seventh line as a formula, in documents of one column."""
    rows = lines(spark, sf_dir).where("doc_id % 4 <> 0").withColumn("math_only", F.col("line_seq") % 7 == 3)
    asked = requests.formulas(reflow.crops(reflow.reflow_columns(regions.mask_special_regions(rows))))
    return asked.groupBy("kind").agg(F.count(F.lit(1)).alias("n_calls"))


@query(
    "judge_requests",
    f"""WITH {TURNS_SQL}, n AS (SELECT conv_id, turn, en, zh, row_number() OVER w - 1 AS place, greatest(1, floor(count(*) OVER (PARTITION BY conv_id) / 6)::BIGINT) AS step FROM pairs WHERE NOT failed AND coalesce(en, '') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT 'judge_pairs' AS kind, conv_id || '/' || (place // step) AS key, {told('judge_pairs')} || 'EN: ' || left(en, 1500) || chr(10) || 'ZH: ' || left(zh, 1500) AS payload FROM n WHERE place % step = 0 AND place < 6 * step""",
)
def judge_requests(spark, sf_dir):
    return requests.judgements(m.judge_samples(turns(spark, sf_dir), ["conv_id"], ["turn"]), ["conv_id"])


@query("baseline_requests", f"WITH {LINES_SQL}, {BASELINE_SQL} SELECT 'baseline' AS kind, doc_id::VARCHAR AS key, {told('baseline')} || left(whole, 12000) AS payload FROM w")
def baseline_requests(spark, sf_dir):
    return requests.baselines(m.baseline_text(lines(spark, sf_dir)))
