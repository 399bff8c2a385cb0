"""Queries of regions, reflow and segmentation."""

from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import reflow, regions, segments
from quire.operators.folds import settle
from quire.operators.noise import drop_embedded_translation, strip_noise
from quire.plans.registry import query
from quire.plans.shared import HAN, LINES_SQL, PARAGRAPHS_SQL, count_sql, lines, paragraphs
from quire.plans.text_queries import CHINESE_SQL, STRIPPED_SQL
from quire.sources import tables

BANDS_SQL = f"""WITH RECURSIVE {LINES_SQL},
    numbered AS (SELECT doc_id, page, line_seq, y0, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_seq) AS k FROM lines),
    walk AS (SELECT doc_id, page, line_seq, k, y0 AS first, 0 AS band, 0 AS place FROM numbered WHERE k = 1
             UNION ALL SELECT n.doc_id, n.page, n.line_seq, n.k, CASE WHEN abs(n.y0 - w.first) > 4 THEN n.y0 ELSE w.first END,
                              CASE WHEN abs(n.y0 - w.first) > 4 THEN w.band + 1 ELSE w.band END, CASE WHEN abs(n.y0 - w.first) > 4 THEN 0 ELSE w.place + 1 END
             FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.page = w.page AND n.k = w.k + 1)"""


@query("row_bands", f"{BANDS_SQL} SELECT doc_id, line_seq, band, place FROM walk")
def row_bands(spark, sf_dir):
    return regions.row_bands(lines(spark, sf_dir)).select("doc_id", "line_seq", "band", "place")


LAID = (
    [(1, k, 0, 108.0, 100.0 + 12 * k, 504.0, 110.0 + 12 * k, f"Prose line {k}.", 10.0, False) for k in range(3)]
    + [(1, 3, 0, 220.0, 140.0, 300.0, 150.0, "E = mc", 10.0, True), (1, 4, 0, 310.0, 141.0, 330.0, 149.0, "p q", 9.0, True), (1, 5, 0, 480.0, 141.0, 504.0, 151.0, "(1)", 10.0, False)]
    + [(1, 6, 0, 108.0, 170.0, 504.0, 180.0, "Table 1. A caption.", 10.0, False)]
    + [(1, 7 + 4 * r + c, 0, x, 200.0 + 12 * r + (12 if r > 1 else 0), x + 40, 210.0 + 12 * r, f"cell {r} {c}", 9.0, False) for r in range(4) for c, x in enumerate((125.0, 264.0, 351.0, 431.0))]
    + [(1, 23, 0, 264.0, 224.0, 300.0, 234.0, "wrapped", 9.0, False), (1, 24, 0, 108.0, 300.0, 504.0, 310.0, "Prose again.", 10.0, False)]
    + [(2, 2 * r + c, 0, 12.0 + 415 * c, 100.0 + 12 * r, 400.0 + 415 * c, 110.0 + 12 * r, f"two columns {r} {c}", 10.0, False) for r in range(6) for c in range(2)]
)
LAID_SCHEMA = "doc_id int, line_seq int, page int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, math_only boolean"
#: In the fixture lines of a row are within two points, and rows are ten points or more apart.
LAID_BANDS = f"""laid AS (SELECT * FROM {tables.sql_values(LAID, LAID_SCHEMA)}),
    ordered AS (SELECT *, lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS before FROM laid),
    banded AS (SELECT *, sum(CASE WHEN y0 - before > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS band FROM ordered),
    strong AS (SELECT doc_id, page, band, lag(band) OVER (PARTITION BY doc_id, page ORDER BY band) AS before FROM banded GROUP BY doc_id, page, band HAVING count(*) >= 3),
    islands AS (SELECT *, sum(CASE WHEN band - before <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY band) AS island FROM strong),
    spans AS (SELECT doc_id, page, min(band) AS lo, max(band) AS hi FROM islands GROUP BY doc_id, page, island HAVING count(*) >= 3)"""


@query("table_regions", f"WITH {LAID_BANDS} SELECT doc_id, page, lo::INTEGER AS lo, hi::INTEGER AS hi FROM spans")
def table_regions(spark, sf_dir):
    return regions.table_spans(regions.row_bands(tables.fixture(spark, LAID, LAID_SCHEMA)))


@query(
    "masked_lines",
    rf"""WITH {LAID_BANDS},
        kinds AS (SELECT b.doc_id, b.page, b.band, CASE WHEN bool_or(s.lo IS NOT NULL) THEN 'table' WHEN count(*) FILTER (NOT regexp_matches(text, '^\(\p{{Nd}}{{1,3}}\)$')) > 0
                         AND count(*) FILTER (NOT regexp_matches(text, '^\(\p{{Nd}}{{1,3}}\)$') AND NOT math_only) = 0 THEN 'formula' ELSE 'text' END AS kind
                  FROM banded b LEFT JOIN spans s ON b.doc_id = s.doc_id AND b.page = s.page AND b.band BETWEEN s.lo AND s.hi GROUP BY b.doc_id, b.page, b.band),
        runs AS (SELECT *, band - row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY band) AS run FROM kinds),
        whole AS (SELECT b.*, r.kind, r.run FROM banded b JOIN runs r USING (doc_id, page, band))
        SELECT doc_id, x0, y0, x1, y1, text, font_size, NULL::VARCHAR AS special FROM whole WHERE kind = 'text'
        UNION ALL SELECT doc_id, min(x0), min(y0), max(x1), max(y1), string_agg(text, ' ' ORDER BY band, y0, x0), max(font_size), 'formula' FROM whole WHERE kind = 'formula' GROUP BY doc_id, page, run
        UNION ALL SELECT doc_id, arg_min(x0, (band, y0, x0)), arg_min(y0, (band, y0, x0)), max(x1), max(y1), '[table omitted]', arg_min(font_size, (band, y0, x0)), 'table' FROM whole WHERE kind = 'table' GROUP BY doc_id, page, run""",
)
def masked_lines(spark, sf_dir):
    return regions.mask_special_regions(tables.fixture(spark, LAID, LAID_SCHEMA)).select("doc_id", "x0", "y0", "x1", "y1", "text", "font_size", "special")


#: With the adapter's two places of x0, columns are those places.
COLUMNS_SQL = f"{LINES_SQL}, cols AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY x0) - 1)::INTEGER AS col FROM lines)"


@query("column_clusters", f"WITH {COLUMNS_SQL} SELECT doc_id, line_seq, col, (row_number() OVER (PARTITION BY doc_id, page, col ORDER BY y0, x0, line_seq) - 1)::INTEGER AS pos FROM cols")
def column_clusters(spark, sf_dir):
    return reflow.columns(lines(spark, sf_dir)).select("doc_id", "line_seq", "col", "pos")


@query(
    "gap_thresholds",
    f"""WITH {COLUMNS_SQL}, g AS (SELECT *, lead(y0) OVER w - y0 AS gap, abs(lead(font_size) OVER w - font_size) <= 1 AS alike, first(font_size) OVER w AS first_size FROM cols WINDOW w AS (PARTITION BY doc_id, page, col ORDER BY y0, x0, line_seq))
        SELECT doc_id, page, col, round_even(font_size, 0)::INTEGER AS size, median(gap) AS gap FROM g WHERE gap > 0 AND alike GROUP BY ALL
        UNION ALL SELECT doc_id, page, col, NULL, coalesce(median(gap) FILTER (gap > 0), any_value(first_size) * 1.4::DOUBLE) FROM g GROUP BY doc_id, page, col""",
)
def gap_thresholds(spark, sf_dir):
    return reflow.gap_thresholds(reflow.columns(lines(spark, sf_dir)))


@query(
    "short_line_cutoffs",
    f"""WITH {COLUMNS_SQL}, e AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, col) AS right_edge FROM cols)
        SELECT doc_id, page, col, right_edge, 3 * list_sort(list(right_edge - x1))[count(*)::INTEGER // 2 + 1] + 2 * median(font_size) AS cutoff FROM e GROUP BY doc_id, page, col, right_edge HAVING count(*) >= 3""",
)
def short_line_cutoffs(spark, sf_dir):
    return reflow.short_line_cutoffs(reflow.columns(lines(spark, sf_dir)))


TERMINAL = t.TERMINAL


def glued_sql(before: str, text: str) -> str:
    """What stands between two pieces of a paragraph; a hyphen at the end of the first is left out by whole_sql."""
    return f"CASE WHEN {before} LIKE '%-' OR regexp_matches({before}, '[{t.CJK}]$') OR regexp_matches({text}, '^[{t.CJK}]') THEN '' ELSE ' ' END"


def whole_sql(goes_on: str, next_on: str, order: str) -> str:
    """Pieces joined by the rule: goes_on says of a piece that it continues the one before, next_on that the next one continues it."""
    return f"string_agg(CASE WHEN {goes_on} THEN {glued_sql('before', 'text')} ELSE '' END || CASE WHEN {next_on} AND text LIKE '%-' THEN left(text, -1) ELSE text END, '' ORDER BY {order})"


def reflow_sql(source: str) -> str:
    """Lines to paragraphs. The adapter's type sizes are more than a point apart, so the size of a paragraph's first line is that of the line before, and nothing has to be carried."""
    column = "PARTITION BY doc_id, page, col ORDER BY y0, x0, line_seq"
    return rf"""
    r_cols AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY x0) - 1)::INTEGER AS col FROM {source}),
    r_gaps AS (SELECT *, lead(y0) OVER w - y0 AS gap, abs(lead(font_size) OVER w - font_size) <= 1 AS alike, first(font_size) OVER w AS first_size FROM r_cols WINDOW w AS ({column})),
    r_own AS (SELECT doc_id, page, col, round_even(font_size, 0) AS size, median(gap) AS own_gap FROM r_gaps WHERE gap > 0 AND alike GROUP BY ALL),
    r_usual AS (SELECT doc_id, page, col, coalesce(median(gap) FILTER (gap > 0), any_value(first_size) * 1.4::DOUBLE) AS usual_gap FROM r_gaps GROUP BY doc_id, page, col),
    r_edge AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, col) AS right_edge FROM r_cols),
    r_cut AS (SELECT doc_id, page, col, 3 * list_sort(list(right_edge - x1))[count(*)::INTEGER // 2 + 1] + 2 * median(font_size) AS cutoff FROM r_edge GROUP BY doc_id, page, col HAVING count(*) >= 3),
    r_seen AS (SELECT *, y0 - lag(y0) OVER w AS step, lag(font_size) OVER w AS size_before, lag(x1) OVER w AS x1_before, lag(text) OVER w AS before, row_number() OVER w AS pos FROM r_edge WINDOW w AS ({column})),
    r_broken AS (SELECT s.*, coalesce(step > 1.5::DOUBLE * coalesce(own_gap, usual_gap) OR abs(font_size - size_before) > 1 OR (cutoff IS NOT NULL AND step > 0.5::DOUBLE * size_before AND right_edge - x1_before > cutoff), true) AS breaks
                 FROM r_seen s JOIN r_usual USING (doc_id, page, col) LEFT JOIN r_cut USING (doc_id, page, col)
                 LEFT JOIN r_own o ON s.doc_id = o.doc_id AND s.page = o.page AND s.col = o.col AND round_even(s.font_size, 0) = o.size),
    r_numbered AS (SELECT *, sum(breaks::INTEGER) OVER w AS para, NOT coalesce(lead(breaks) OVER w, true) AS next_on FROM r_broken WINDOW w AS (PARTITION BY doc_id ORDER BY page, col, pos)),
    r_open AS (SELECT doc_id, (para - 1)::INTEGER AS para_seq, min(page) AS page, min(font_size) AS font_size, {whole_sql('NOT breaks', 'next_on', 'page, col, pos')} AS text FROM r_numbered GROUP BY doc_id, para),
    r_body AS (SELECT doc_id, median(font_size) AS body FROM (SELECT doc_id, font_size, unnest(range(length(text))) FROM r_open) GROUP BY doc_id),
    r_back AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY para_seq) AS before FROM r_open),
    r_fonts AS (SELECT p.*, font_size >= body + 1.5 AND length(text) < 120 AS font_heading FROM r_back p JOIN r_body USING (doc_id)),
    r_marked AS (SELECT * EXCLUDE (before), font_heading OR (length(text) < 60 AND len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) + {count_sql('text', HAN)} >= 2 AND NOT regexp_matches(text, '[{TERMINAL}]$')
                 AND (regexp_matches(text, '^\p{{Lu}}') OR regexp_matches(text, '^[{HAN}]')) AND NOT regexp_matches(text, '[{t.BLOCKED}]') AND (before IS NULL OR regexp_matches(before, '[{TERMINAL}]$'))) AS is_heading FROM r_fonts),
    r_ahead AS (SELECT *, lead(text) OVER w AS nt, lead(font_size) OVER w AS nf, lead(is_heading) OVER w AS nh FROM r_marked WINDOW w AS (PARTITION BY doc_id ORDER BY para_seq)),
    r_calls AS (SELECT *, coalesce(is_heading AND NOT regexp_matches(text, '[{TERMINAL}]$') AND regexp_matches(text, '[{t.CLAUSE}]') AND NOT nh
                AND (regexp_matches(nt, '^\p{{Ll}}') OR (regexp_matches(nt, '^[{HAN}]') AND regexp_matches(text, '[{HAN}]$'))), false) AS joins FROM r_ahead),
    r_taken AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY para_seq), false) AS taken FROM r_calls),
    r_called AS (SELECT doc_id, para_seq, page, CASE WHEN joins THEN CASE WHEN text LIKE '%-' THEN left(text, -1) ELSE text END || {glued_sql('text', 'nt')} || nt ELSE text END AS text, CASE WHEN joins THEN nf ELSE font_size END AS font_size,
                        NOT joins AND is_heading AS is_heading, NOT joins AND font_heading AS font_heading FROM r_taken WHERE NOT taken),
    r_prior AS (SELECT *, lag(text) OVER w AS before, lag(font_size) OVER w AS size_before, lag(is_heading) OVER w AS heading_before FROM r_called WINDOW w AS (PARTITION BY doc_id ORDER BY para_seq)),
    r_goes AS (SELECT *, coalesce(NOT heading_before AND NOT is_heading AND abs(font_size - size_before) <= 1 AND NOT regexp_matches(before, '[{TERMINAL}]$')
                AND (regexp_matches(text, '^\p{{Ll}}') OR (regexp_matches(text, '^[{HAN}]') AND regexp_matches(before, '[{HAN}]$'))), false) AS goes_on FROM r_prior),
    r_runs AS (SELECT *, sum((NOT goes_on)::INTEGER) OVER w AS run, coalesce(lead(goes_on) OVER w, false) AS next_on FROM r_goes WINDOW w AS (PARTITION BY doc_id ORDER BY para_seq)),
    reflowed AS (SELECT doc_id, min(para_seq) AS para_seq, arg_min(page, para_seq) AS page, arg_min(font_size, para_seq) AS font_size, NULL::VARCHAR AS special, {whole_sql('goes_on', 'next_on', 'para_seq')} AS text,
                        arg_min(is_heading, para_seq) AS is_heading, arg_min(font_heading, para_seq) AS font_heading FROM r_runs GROUP BY doc_id, run)"""


@query("reflow_paragraphs", f"WITH {LINES_SQL}, {reflow_sql('lines')} SELECT * FROM reflowed")
def reflow_paragraphs(spark, sf_dir):
    """The whole way from lines to paragraphs."""
    return reflow.reflow(lines(spark, sf_dir).withColumn("special", F.lit(None).cast("string"))).drop("clip")


#: The adapter puts at most two fragments on a row and no formula, so there is no region to mask.
CLEANED_SQL = f"""english AS (SELECT doc_id, sum({count_sql('text', 'A-Za-z')}) > sum({count_sql('text', HAN)}) AS english FROM stripped GROUP BY doc_id),
    kept AS (SELECT s.* FROM stripped s JOIN english USING (doc_id) WHERE NOT (english AND {CHINESE_SQL}))"""


@query("cleaned_paragraphs", f"WITH {LINES_SQL}, {STRIPPED_SQL}, {CLEANED_SQL}, {reflow_sql('kept')} SELECT * FROM reflowed")
def cleaned_paragraphs(spark, sf_dir):
    """Noise, embedded translation, regions and reflow in turn."""
    rows = lines(spark, sf_dir)
    kept = settle(drop_embedded_translation(strip_noise(rows, tables.page_sizes(rows))))
    return reflow.reflow(regions.mask_special_regions(kept)).drop("clip")


HEADINGS_SQL = rf"""{PARAGRAPHS_SQL},
    body AS (SELECT doc_id, median(font_size) AS body FROM (SELECT doc_id, font_size, unnest(range(length(text))) FROM paragraphs) GROUP BY doc_id),
    prev AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY para_seq) AS before FROM paragraphs),
    marked AS (SELECT p.*, p.font_size >= b.body + 1.5 AND length(text) < 120 AS font_heading,
                      (p.font_size >= b.body + 1.5 AND length(text) < 120) OR (length(text) < 60 AND len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) + {count_sql('text', HAN)} >= 2
                       AND NOT regexp_matches(text, '[{TERMINAL}]$') AND (regexp_matches(text, '^\p{{Lu}}') OR regexp_matches(text, '^[{HAN}]')) AND NOT regexp_matches(text, '[{t.BLOCKED}]')
                       AND (before IS NULL OR regexp_matches(before, '[{TERMINAL}]$'))) AS is_heading
               FROM prev p JOIN body b USING (doc_id))"""


@query("heading_marks", f"WITH {HEADINGS_SQL} SELECT doc_id, para_seq, text, font_heading, is_heading FROM marked")
def heading_marks(spark, sf_dir):
    return reflow.mark_headings(paragraphs(spark, sf_dir)).select("doc_id", "para_seq", "text", "font_heading", "is_heading")


CALLS = [
    (1, 0, "Some, they say, would rather", 18.0, True, True), (1, 1, "wait for a better day.", 12.0, False, False), (1, 2, "Apples, pears", 30.0, True, True), (1, 3, "Both are sold here.", 12.0, False, False),
    (2, 0, "增长，仍在", 18.0, True, True), (2, 1, "继续", 12.0, False, False), (2, 2, "A plain heading", 18.0, True, True), (2, 3, "small start", 12.0, False, False), (3, 0, "End, heading", 18.0, True, True),
]
CALLS_SCHEMA = "doc_id int, para_seq int, text string, font_size double, is_heading boolean, font_heading boolean"


@query(
    "callout_merge",
    rf"""WITH n AS (SELECT *, lead(text) OVER w AS nt, lead(font_size) OVER w AS nf, lead(is_heading) OVER w AS nh FROM {tables.sql_values(CALLS, CALLS_SCHEMA)} WINDOW w AS (PARTITION BY doc_id ORDER BY para_seq)),
        j AS (SELECT *, coalesce(is_heading AND NOT regexp_matches(text, '[{TERMINAL}]$') AND regexp_matches(text, '[{t.CLAUSE}]') AND NOT nh
                    AND (regexp_matches(nt, '^\p{{Ll}}') OR (regexp_matches(nt, '^[{HAN}]') AND regexp_matches(text, '[{HAN}]$'))), false) AS joins FROM n),
        k AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY para_seq), false) AS taken FROM j)
        SELECT doc_id, para_seq, CASE WHEN joins THEN CASE WHEN text LIKE '%-' THEN left(text, -1) || nt WHEN regexp_matches(text, '[{t.CJK}]$') OR regexp_matches(nt, '^[{t.CJK}]') THEN text || nt ELSE text || ' ' || nt END ELSE text END AS text,
               CASE WHEN joins THEN nf ELSE font_size END AS font_size, NOT joins AND is_heading AS is_heading, NOT joins AND font_heading AS font_heading FROM k WHERE NOT taken""",
)
def callout_merge(spark, sf_dir):
    return reflow.demote_split_callouts(tables.fixture(spark, CALLS, CALLS_SCHEMA)).select("doc_id", "para_seq", "text", "font_size", "is_heading", "font_heading")


@query(
    "continuation_merge",
    rf"""WITH {LINES_SQL}, b AS (SELECT doc_id, line_seq, text, lag(text) OVER (PARTITION BY doc_id ORDER BY line_seq) AS before FROM lines),
        c AS (SELECT *, coalesce(NOT regexp_matches(before, '[{TERMINAL}]$') AND (regexp_matches(text, '^\p{{Ll}}') OR (regexp_matches(text, '^[{HAN}]') AND regexp_matches(before, '[{HAN}]$'))), false) AS goes_on FROM b),
        i AS (SELECT *, sum((NOT goes_on)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_seq) AS island, coalesce(lead(goes_on) OVER (PARTITION BY doc_id ORDER BY line_seq), false) AS next_on FROM c)
        SELECT doc_id, min(line_seq)::INTEGER AS para_seq, string_agg(CASE WHEN goes_on AND before NOT LIKE '%-' THEN ' ' ELSE '' END || CASE WHEN next_on AND text LIKE '%-' THEN left(text, -1) ELSE text END, '' ORDER BY line_seq) AS text
        FROM i GROUP BY doc_id, island""",
)
def continuation_merge(spark, sf_dir):
    """Lines as paragraphs of one type size."""
    rows = lines(spark, sf_dir).select("doc_id", F.col("line_seq").alias("para_seq"), "page", F.lit(12.0).alias("font_size"), F.lit(None).cast("string").alias("special"), "text")
    flags = rows.withColumn("is_heading", F.lit(False)).withColumn("font_heading", F.lit(False))
    return reflow.merge_continuations(flags).select("doc_id", "para_seq", "text")


@query(
    "formula_crops",
    f"""WITH {LINES_SQL}, rows AS (SELECT *, line_seq % CASE WHEN doc_id % 4 = 0 THEN 10 ELSE 20 END AS slot FROM lines),
        bands AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY slot) AS band, bool_and(line_seq % 7 = 3) AS formula, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rows GROUP BY doc_id, page, slot),
        runs AS (SELECT *, band - row_number() OVER (PARTITION BY doc_id, page, formula ORDER BY band) AS run FROM bands)
        SELECT doc_id, page, min(x0) - 4 AS x0, min(y0) - 4 AS y0, max(x1) + 4 AS x1, max(y1) + 4 AS y1, 200 / 72.0::DOUBLE AS zoom FROM runs WHERE formula GROUP BY doc_id, page, run""",
)
def formula_crops(spark, sf_dir):
    """Every seventh line as a formula; its clip through reflow to the crop."""
    rows = lines(spark, sf_dir).withColumn("math_only", F.col("line_seq") % 7 == 3)
    return reflow.crops(reflow.reflow_columns(regions.mask_special_regions(rows))).drop("para_seq")


FORMULAS = [(1, 0, "Prose.", None), (1, 1, "E = mc", "formula"), (1, 2, "a + b", "formula"), (1, 3, "[table omitted]", "table"), (2, 0, "x", "formula"), (2, 1, "y", "formula")]
FORMULA_SCHEMA = "doc_id int, para_seq int, text string, special string"
LATEX = [(1, 1, "```latex\n$E = mc^2$\n```"), (1, 2, "  "), (2, 1, "y")]


@query(
    "formula_plan",
    rf"""WITH n AS (SELECT *, special = 'formula' AND row_number() OVER (PARTITION BY doc_id, special ORDER BY para_seq) <= CASE doc_id WHEN 1 THEN 30 ELSE 1 END AS a FROM {tables.sql_values(FORMULAS, FORMULA_SCHEMA)}),
        r AS (SELECT doc_id, para_seq, regexp_replace(regexp_replace(body, '^\s*```(latex)?|```\s*$', '', 'g'), '^[$\s]+|[$\s]+$', '', 'g') AS latex FROM {tables.sql_values(LATEX, 'doc_id int, para_seq int, body string')})
        SELECT doc_id, para_seq, coalesce(a, false) AS asked, CASE WHEN special = 'formula' THEN CASE WHEN a AND coalesce(latex, '') <> '' THEN '$$' || chr(10) || latex || chr(10) || '$$' ELSE '```' || chr(10) || '[formula] ' || text || chr(10) || '```' END ELSE text END AS text
        FROM n LEFT JOIN r USING (doc_id, para_seq)""",
)
def formula_plan(spark, sf_dir):
    """Two documents, of the second only the first formula is asked for."""
    rows, replies = tables.fixture(spark, FORMULAS, FORMULA_SCHEMA), tables.fixture(spark, LATEX, "doc_id int, para_seq int, body string")
    one, two = rows.where("doc_id = 1"), rows.where("doc_id = 2")
    return reflow.formula_plan(one, replies).unionByName(reflow.formula_plan(two, replies, most=1)).select("doc_id", "para_seq", "text", "asked")


def marked(spark, sf_dir):
    return reflow.mark_headings(paragraphs(spark, sf_dir))


PREVIEW_SQL = f"""{HEADINGS_SQL}, previews AS (SELECT doc_id, para_seq, text AS heading, left(concat_ws(' ', lead(text, 1) OVER w, lead(text, 2) OVER w), 200) AS preview, font_heading FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY para_seq))"""


@query("heading_previews", f"WITH {PREVIEW_SQL} SELECT doc_id, para_seq, heading, preview FROM previews WHERE font_heading")
def heading_previews(spark, sf_dir):
    return segments.heading_candidates(marked(spark, sf_dir))


@query(
    "segment_notes",
    f"WITH {HEADINGS_SQL}, d AS (SELECT doc_id, bool_or(font_heading) AS any_heading FROM marked GROUP BY doc_id) SELECT doc_id, CASE WHEN any_heading THEN 'no reply confirmed a heading; all candidates kept' ELSE 'no headings; the whole document is one article' END AS note, 'error' AS severity FROM d WHERE NOT any_heading OR doc_id % 3 = 0",
)
def segment_notes(spark, sf_dir):
    """The replies of every third page name no heading; those of the others name one, some of them at the third try, which is one too late for none here."""
    rows = marked(spark, sf_dir)
    found = segments.heading_candidates(rows)
    first = found.groupBy("doc_id").agg(F.min("para_seq").alias("p"))
    ids = F.array(F.when(F.col("doc_id") % 3 == 0, -2).otherwise(F.col("p")))
    late = first.select("doc_id", F.lit(2).alias("attempt"), F.array("p").alias("ids"))
    return segments.notes(rows, found, first.select("doc_id", F.lit(1).alias("attempt"), ids.alias("ids")).unionByName(late))


@query(
    "confirmed_headings",
    f"WITH {PREVIEW_SQL} SELECT doc_id, para_seq, doc_id % 3 = 0 AS fallback FROM previews WHERE font_heading AND (doc_id % 3 = 0 OR para_seq = (SELECT min(p.para_seq) FROM previews p WHERE p.font_heading AND p.doc_id = previews.doc_id))",
)
def confirmed_headings(spark, sf_dir):
    """A stand-in confirms the first heading of two of three pages, at the second try; the third page's replies name none."""
    found = segments.heading_candidates(marked(spark, sf_dir))
    first = found.groupBy("doc_id").agg(F.min("para_seq").alias("p"))
    replies = first.select("doc_id", F.lit(0).alias("attempt"), F.array(F.lit(-1)).alias("ids")).unionByName(first.select("doc_id", F.lit(1).alias("attempt"), F.array(F.when(F.col("doc_id") % 3 == 0, -2).otherwise(F.col("p"))).alias("ids")))
    return segments.confirmed_starts(found, replies)


SLICES_SQL = rf"""{HEADINGS_SQL},
    sliced AS (SELECT *, sum(font_heading::INTEGER) OVER (PARTITION BY doc_id ORDER BY para_seq) AS slice FROM marked),
    counted AS (SELECT *, max(slice) OVER (PARTITION BY doc_id) AS n_starts, sum(length(text)) OVER (PARTITION BY doc_id, slice) AS chars, row_number() OVER (PARTITION BY doc_id, slice ORDER BY para_seq) - 1 AS place FROM sliced),
    kept AS (SELECT * FROM counted WHERE slice > 0 OR n_starts = 0 OR chars > 400),
    heads AS (SELECT doc_id, slice, n_starts, max(text) FILTER (place = 0 AND slice > 0) AS heading, max(text) FILTER (place = 1 AND slice > 0) AS following FROM kept GROUP BY ALL),
    subs AS (SELECT *, CASE WHEN slice > 0 AND following IS NOT NULL AND length(following) <= 160 AND NOT regexp_matches(following, '[.。！？]$')
                            AND NOT (regexp_matches(heading, '[{HAN}]') AND NOT regexp_matches(following, '[{HAN}]')) THEN following ELSE '' END AS subtitle FROM heads),
    articles AS (SELECT doc_id, slice, (row_number() OVER (PARTITION BY doc_id ORDER BY slice) - 1)::INTEGER AS article_index, subtitle, CASE WHEN n_starts = 0 THEN 'whole' WHEN slice = 0 THEN 'leading' ELSE 'titled' END AS kind,
                        CASE WHEN n_starts = 0 THEN doc_id::VARCHAR WHEN slice = 0 THEN doc_id::VARCHAR || ' (untitled leading section)' ELSE heading END AS title, CASE WHEN slice = 0 THEN 0 WHEN subtitle <> '' THEN 2 ELSE 1 END AS skip FROM subs),
    bodies AS (SELECT a.doc_id, a.article_index, (row_number() OVER (PARTITION BY a.doc_id, a.article_index ORDER BY k.place) - 1)::INTEGER AS seg_seq, k.text, k.is_heading FROM articles a JOIN kept k USING (doc_id, slice) WHERE k.place >= a.skip)"""


@query("article_slices", f"WITH {SLICES_SQL} SELECT a.doc_id, a.article_index, title, subtitle, kind, (SELECT count(*) FROM bodies b WHERE b.doc_id = a.doc_id AND b.article_index = a.article_index)::INTEGER AS n_body FROM articles a")
def article_slices(spark, sf_dir):
    return segments.article_slices(marked(spark, sf_dir)).select("doc_id", "article_index", "title", "subtitle", "kind", F.size("body").alias("n_body"))


@query("article_bodies", f"WITH {SLICES_SQL} SELECT doc_id, article_index, seg_seq, text, is_heading FROM bodies")
def article_bodies(spark, sf_dir):
    return segments.exploded(segments.article_slices(marked(spark, sf_dir)))


@query("article_routes", f"WITH {SLICES_SQL}, w AS (SELECT a.doc_id, a.article_index, concat_ws(' ', any_value(a.title), any_value(a.subtitle), coalesce(string_agg(b.text, ' '), '')) AS text FROM articles a LEFT JOIN bodies b ON a.doc_id = b.doc_id AND a.article_index = b.article_index GROUP BY ALL) SELECT doc_id, article_index, CASE WHEN {count_sql('text', 'A-Za-z')} > {count_sql('text', HAN)} THEN 'translate' ELSE 'convert' END AS route FROM w")
def article_routes(spark, sf_dir):
    english, chinese = segments.split_by_language(segments.article_slices(marked(spark, sf_dir)))
    one = lambda df, name: df.select("doc_id", "article_index", F.lit(name).alias("route"))
    return one(english, "translate").unionByName(one(chinese, "convert"))
