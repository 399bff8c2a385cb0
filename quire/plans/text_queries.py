"""Queries of the scalar rules and of noise."""

from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import noise
from quire.plans.registry import query
from quire.plans.shared import HAN, LINES_SQL, count_sql, lines
from quire.sources import tables

TEXTS = [
    (0, "Bending the curve"), (1, "价格 rose by 3%"), (2, "「。」，、"), (3, ""), (4, "(3)"), (5, "i i i"), (6, "x ∈ S and y ≤ 4 hold"), (7, "Two words"), (8, "QKᵀ ∑ value"),
    (9, "price index α rises"), (10, "市场"), (11, "A sentence that is long enough to be prose."), (12, "Ωmega ∂ ∇ flows over many words here"),
]
TEXT_SCHEMA = "id int, text string"
TEXTS_SQL = tables.sql_values(TEXTS, TEXT_SCHEMA)


def prose_sql(text: str) -> str:
    words, math = f"len(regexp_extract_all({text}, '[A-Za-z]{{2,}}'))", count_sql(text, t.MATH)
    return (
        f"CASE WHEN regexp_matches({text}, '[{HAN}]') THEN false WHEN {words} < 2 THEN true WHEN {math} >= 2 AND length({text}) < 250 THEN true "
        f"WHEN {math} >= 1 AND {words} <= 4 AND length({text}) < 120 THEN true ELSE false END"
    )


CHINESE_SQL = f"(regexp_matches(text, '[{HAN}]') OR (length(text) > 0 AND {count_sql('text', t.CJK)} > 0.5 * length(text)))"


@query("doc_lines", f"WITH {LINES_SQL} SELECT doc_id, line_seq, page, x0, y0, x1, y1, text, font_size FROM lines")
def doc_lines(spark, sf_dir):
    return lines(spark, sf_dir).drop("math_only")


@query("text_layer_gate", f"WITH {LINES_SQL} SELECT doc_id, sum(length(text))::BIGINT AS n_chars, sum(length(text)) >= 200 AS usable FROM lines GROUP BY doc_id")
def text_layer_gate(spark, sf_dir):
    return noise.text_layer(lines(spark, sf_dir))


@query("script_counts", f"WITH {LINES_SQL} SELECT doc_id, sum({count_sql('text', 'A-Za-z')})::BIGINT AS latin, sum({count_sql('text', HAN)})::BIGINT AS han FROM lines GROUP BY doc_id")
def script_counts(spark, sf_dir):
    return noise.scripts(lines(spark, sf_dir))


@query(
    "chinese_lines",
    f"SELECT id, CASE WHEN length(text) = 0 THEN 0.0 ELSE {count_sql('text', t.CJK)} / length(text) END::DOUBLE AS ratio, {CHINESE_SQL} AS chinese, {count_sql('text', 'A-Za-z')}::INTEGER AS latin, {count_sql('text', HAN)}::INTEGER AS han FROM {TEXTS_SQL}",
)
def chinese_lines(spark, sf_dir):
    c = F.col("text")
    return tables.fixture(spark, TEXTS, TEXT_SCHEMA).select("id", t.cjk_ratio(c).cast("double").alias("ratio"), t.is_chinese(c).alias("chinese"), t.latin_count(c).alias("latin"), t.han_count(c).alias("han"))


@query(
    "non_prose_lines",
    f"WITH {LINES_SQL}, every AS (SELECT doc_id, line_seq, text FROM lines UNION ALL SELECT -1, id, text FROM {TEXTS_SQL}) SELECT doc_id, line_seq, {prose_sql('text')} AS non_prose FROM every",
)
def non_prose_lines(spark, sf_dir):
    more = tables.fixture(spark, TEXTS, TEXT_SCHEMA).select(F.lit(-1).cast("long").alias("doc_id"), F.col("id").alias("line_seq"), "text")
    rows = lines(spark, sf_dir).select("doc_id", "line_seq", "text").unionByName(more)
    return rows.select("doc_id", "line_seq", t.is_non_prose(F.col("text")).alias("non_prose"))


#: Traditional and simplified characters, and letters that some documents have in their place.
SCRIPT = {"這": "这", "經": "经", "濟": "济"}
ROUTE_SQL = f"""routed AS (SELECT doc_id, source AS title, translate(text, CASE doc_id % 5 WHEN 0 THEN '' ELSE 'aeiounrst' END, CASE doc_id % 5 WHEN 1 THEN '這經濟這經濟這經濟' WHEN 2 THEN '这经济这经济这经济' WHEN 3 THEN '這这经济經文文文文' WHEN 4 THEN '文文文文文文文文文' ELSE '' END) AS text FROM documents),
        whole AS (SELECT doc_id, concat_ws(' ', title, '', text) AS text FROM routed),
        counted AS (SELECT doc_id, {count_sql('text', 'A-Za-z')}::BIGINT AS latin, {count_sql('text', HAN)}::BIGINT AS han, regexp_matches(left(text, 4000), '[这经济]') AS a, regexp_matches(left(text, 4000), '[這經濟]') AS b FROM whole)"""


@query("language_route", f"WITH {ROUTE_SQL} SELECT doc_id, latin, han, latin > han AS has_english, CASE WHEN han = 0 THEN 'none' WHEN a AND b THEN 'mixed' WHEN b THEN 'traditional' ELSE 'simplified' END AS script_state FROM counted")
def language_route(spark, sf_dir):
    """Documents as articles, four of five with Han characters of one script or both in place of some letters."""
    forms = {1: "這經濟這經濟這經濟", 2: "这经济这经济这经济", 3: "這这经济經文文文文", 4: "文文文文文文文文文"}
    text = F.col("text")
    for k, to in forms.items():
        text = F.when(F.col("doc_id") % 5 == k, F.translate("text", "aeiounrst", to)).otherwise(text)
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lit("").alias("subtitle"), F.array(text).alias("paragraphs"))
    return noise.route(rows, SCRIPT).drop("title", "subtitle", "paragraphs")


@query(
    "running_headers",
    f"""WITH {LINES_SQL}, l AS (SELECT d.source, l.doc_id, l.line_seq, l.text, l.font_size, l.y0 FROM lines l JOIN documents d USING (doc_id)),
        m AS (SELECT *, min(doc_id) OVER w AS a, max(doc_id) OVER w AS b, row_number() OVER (PARTITION BY source, text ORDER BY font_size DESC, doc_id, y0, line_seq) AS k FROM l WINDOW w AS (PARTITION BY source, text))
        SELECT source, doc_id AS page, line_seq FROM m WHERE length(text) <= 60 AND a <> b AND k > 1""",
)
def running_headers(spark, sf_dir):
    """A source is the publication and a document a page of it."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = lines(spark, sf_dir).drop("page").join(docs, "doc_id").withColumnRenamed("doc_id", "page").withColumnRenamed("source", "doc_id")
    return noise.copies(rows).select(F.col("doc_id").alias("source"), "page", "line_seq")


BODY_SQL = """sizes AS (SELECT doc_id, font_size, sum(length(text)) AS n FROM lines GROUP BY doc_id, font_size),
        upto AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY font_size) AS c, sum(n) OVER (PARTITION BY doc_id) AS a FROM sizes),
        body AS (SELECT doc_id, min(font_size) AS body_size FROM upto WHERE c > floor(a / 2) GROUP BY doc_id)"""


@query("body_sizes", f"WITH {LINES_SQL}, {BODY_SQL} SELECT doc_id, body_size FROM body")
def body_sizes(spark, sf_dir):
    return noise.body_sizes(lines(spark, sf_dir))


FURNITURE = [(0, "12", 800.0, 810.0), (1, "12", 100.0, 110.0), (2, "12345", 800.0, 812.0), (3, "2024-05-01", 40.0, 60.0), (4, "2024-05-01", 400.0, 420.0), (5, "2024/5/1", 20.0, 40.0), (6, "May 2024", 20.0, 40.0), (7, "٣٤", 830.0, 840.0)]
FURNITURE_SCHEMA = "id int, text string, y0 double, y1 double"


@query(
    "page_furniture",
    rf"""SELECT id, regexp_matches(text, '^\p{{Nd}}+$') AND length(text) <= 4 AND y0 > 0.85::DOUBLE * 842.0 AS page_number,
         regexp_matches(text, '^\p{{Nd}}{{4}}[./-]\p{{Nd}}{{1,2}}[./-]\p{{Nd}}{{1,2}}$') AND y1 < 0.15::DOUBLE * 842.0 AS header_date FROM {tables.sql_values(FURNITURE, FURNITURE_SCHEMA)}""",
)
def page_furniture(spark, sf_dir):
    h = F.lit(842.0)
    return tables.fixture(spark, FURNITURE, FURNITURE_SCHEMA).select("id", t.is_page_number(F.col("text"), F.col("y0"), h).alias("page_number"), t.is_header_date(F.col("text"), F.col("y1"), h).alias("header_date"))


LABELLED = [(1, 0, 0, 100.0, "Status"), (1, 1, 0, 102.0, "Open"), (1, 2, 0, 120.0, "A body line"), (1, 3, 1, 100.0, "Same height, other page"), (2, 0, 0, 100.0, "Pinned"), (2, 1, 0, 200.0, "Pin")]
LABELLED_SCHEMA = "doc_id int, line_seq int, page int, y0 double, text string"
LABELS_SQL = "(" + ", ".join(f"'{x}'" for x in noise.UI_LABELS) + ")"


@query("ui_rows", f"SELECT doc_id, line_seq FROM (SELECT *, max((text IN {LABELS_SQL})::INTEGER) OVER (PARTITION BY doc_id, page, floor(y0 / 4)) AS ui FROM {tables.sql_values(LABELLED, LABELLED_SCHEMA)}) WHERE ui = 0")
def ui_rows(spark, sf_dir):
    return noise.without_ui_rows(tables.fixture(spark, LABELLED, LABELLED_SCHEMA)).select("doc_id", "line_seq")


STRIPPED_SQL = rf"""{BODY_SQL},
        script AS (SELECT doc_id, sum({count_sql('text', HAN)}) > sum({count_sql('text', 'A-Za-z')}) AS han_majority FROM lines GROUP BY doc_id),
        noisy AS (SELECT *, min(page) OVER w AS a, max(page) OVER w AS b, row_number() OVER (PARTITION BY doc_id, text ORDER BY font_size DESC, page, y0, line_seq) AS k,
                     max((text IN {LABELS_SQL})::INTEGER) OVER (PARTITION BY doc_id, page, floor(y0 / 4)) AS ui FROM lines WINDOW w AS (PARTITION BY doc_id, text)),
        stripped AS (SELECT n.* EXCLUDE (a, b, k, ui) FROM noisy n JOIN body USING (doc_id) JOIN script USING (doc_id)
        WHERE NOT (regexp_matches(text, '^\p{{Nd}}+$') AND length(text) <= 4 AND y0 > 0.85::DOUBLE * 842.0) AND NOT (regexp_matches(text, '^\p{{Nd}}{{4}}[./-]\p{{Nd}}{{1,2}}[./-]\p{{Nd}}{{1,2}}$') AND y1 < 0.15::DOUBLE * 842.0)
          AND NOT (length(text) <= 60 AND a <> b AND k > 1) AND ui = 0 AND font_size >= 0.75::DOUBLE * body_size
          AND NOT (han_majority AND length(text) < 30 AND NOT regexp_matches(text, '[{HAN}]')))"""


@query("strip_noise", f"WITH {LINES_SQL}, {STRIPPED_SQL} SELECT doc_id, line_seq, page, font_size, text FROM stripped")
def strip_noise(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return noise.strip_noise(rows, tables.page_sizes(rows)).select("doc_id", "line_seq", "page", "font_size", "text")


MIXED = [(1, 0, "A majority of Latin letters stands here"), (1, 1, "嵌入的译文"), (1, 2, "More of the text"), (2, 0, "以中文为主的文件内容"), (2, 1, "Brand"), (3, 0, "ab中文"), (3, 1, "。，、")]
MIXED_SCHEMA = "doc_id int, line_seq int, text string"
MIXED_SQL = tables.sql_values(MIXED, MIXED_SCHEMA)


@query(
    "embedded_translation",
    f"""SELECT doc_id, line_seq, text FROM (SELECT *, sum({count_sql('text', 'A-Za-z')}) OVER (PARTITION BY doc_id) > sum({count_sql('text', HAN)}) OVER (PARTITION BY doc_id) AS english FROM {MIXED_SQL})
        WHERE NOT (english AND {CHINESE_SQL})""",
)
def embedded_translation(spark, sf_dir):
    return noise.drop_embedded_translation(tables.fixture(spark, MIXED, MIXED_SCHEMA))


@query("english_paragraphs", f"SELECT doc_id, line_seq AS article_index, text, NULL::BIGINT AS n_dropped FROM {MIXED_SQL} WHERE NOT {CHINESE_SQL} UNION ALL SELECT doc_id, line_seq, NULL, count(*) FROM {MIXED_SQL} WHERE {CHINESE_SQL} GROUP BY doc_id, line_seq")
def english_paragraphs(spark, sf_dir):
    kept, lost = noise.english_paragraphs(tables.fixture(spark, MIXED, MIXED_SCHEMA).withColumnRenamed("line_seq", "article_index"))
    return kept.withColumn("n_dropped", F.lit(None).cast("long")).unionByName(lost.select("doc_id", "article_index", F.lit(None).cast("string").alias("text"), "n_dropped"))


MONEY = [(0, "It cost $86bn and $5"), (1, "```\n$5 stays\n```"), (2, "inline $d_k$ stays"), (3, "$$\nx\n$$"), (4, "the edge $2^n$"), (5, "价$x$格"), (6, "a $x$ b"), (7, r"\$5 and $y$z"), (8, "$a$$b$"), (9, "两$x$个$y$公式"), (10, "no math")]
MONEY_SQL = tables.sql_values(MONEY, TEXT_SCHEMA)

@query("currency_escape", rf"SELECT id, CASE WHEN starts_with(text, '```') THEN text ELSE regexp_replace(text, '\$(\p{{Nd}})', '\\$\1', 'g') END AS escaped FROM {MONEY_SQL}")
def currency_escape(spark, sf_dir):
    return tables.fixture(spark, MONEY, TEXT_SCHEMA).select("id", t.escape_currency(F.col("text")).alias("escaped"))


#: Lines in which some letters are made signs of every kind, so that spans, escapes, double signs and line breaks occur.
DOLLARS = ("aeiou", "$ $\\\n")
MATH_SQL = rf"""WITH {LINES_SQL}, every AS (SELECT doc_id, line_seq, translate(left(text, 60), 'aeiou', '$ $\' || chr(10)) AS text FROM lines UNION ALL SELECT -1, id, text FROM {MONEY_SQL}),
    chars AS (SELECT doc_id, line_seq, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS p FROM every),
    near AS (SELECT *, lag(c) OVER w AS c0, lead(c) OVER w AS c1, min(CASE WHEN c = '$' THEN p END) OVER (PARTITION BY doc_id, line_seq ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close,
                    min(CASE WHEN c = chr(10) THEN p END) OVER (PARTITION BY doc_id, line_seq ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS newline FROM chars WINDOW w AS (PARTITION BY doc_id, line_seq ORDER BY p)),
    spans AS (SELECT s.doc_id, s.line_seq, s.p, s.close, row_number() OVER (PARTITION BY s.doc_id, s.line_seq ORDER BY s.p) AS k FROM near s JOIN near e ON s.doc_id = e.doc_id AND s.line_seq = e.line_seq AND s.close = e.p
              WHERE s.c = '$' AND coalesce(s.c0, '') NOT IN ('$', '\') AND s.close > s.p + 1 AND coalesce(s.newline > s.close, true) AND coalesce(e.c1, '') <> '$'),
    walk AS (SELECT doc_id, line_seq, k, p, close, true AS taken, close AS upto FROM spans WHERE k = 1
             UNION ALL SELECT s.doc_id, s.line_seq, s.k, s.p, s.close, s.p > w.upto, CASE WHEN s.p > w.upto THEN s.close ELSE w.upto END FROM walk w JOIN spans s ON s.doc_id = w.doc_id AND s.line_seq = w.line_seq AND s.k = w.k + 1),
    pads AS (SELECT doc_id, line_seq, p, true AS opens FROM walk WHERE taken UNION ALL SELECT doc_id, line_seq, close, false FROM walk WHERE taken),
    padded AS (SELECT n.doc_id, n.line_seq, string_agg(CASE WHEN opens AND regexp_matches(c0, '[^\s]') THEN ' ' ELSE '' END || c || CASE WHEN NOT opens AND regexp_matches(c1, '[^\s]') THEN ' ' ELSE '' END, '' ORDER BY n.p) AS padded
               FROM near n LEFT JOIN pads USING (doc_id, line_seq, p) GROUP BY n.doc_id, n.line_seq)"""


@query("math_padding", f"{MATH_SQL.replace('WITH', 'WITH RECURSIVE', 1)} SELECT doc_id, line_seq, padded FROM padded")
def math_padding(spark, sf_dir):
    made = lines(spark, sf_dir).select("doc_id", "line_seq", F.translate(F.substr("text", F.lit(1), F.lit(60)), *DOLLARS).alias("text"))
    rows = made.unionByName(tables.fixture(spark, MONEY, TEXT_SCHEMA).select(F.lit(-1).cast("long").alias("doc_id"), F.col("id").alias("line_seq"), "text"))
    return rows.select("doc_id", "line_seq", t.pad_inline_math(F.col("text")).alias("padded"))


@query(
    "file_slugs",
    r"""WITH s AS (SELECT page_id, url, trim(regexp_replace(url, '[^A-Za-z0-9\x{4E00}-\x{9FFF}]+', '-', 'g'), '-') AS j FROM pages)
        SELECT page_id, CASE WHEN regexp_replace(left(j, 60), '-+$', '') = '' THEN 'untitled' ELSE regexp_replace(left(j, 60), '-+$', '') END AS slug FROM s""",
)
def file_slugs(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", t.slug(F.coalesce("url", F.lit(""))).alias("slug"))


FILES = [(0, "01-title.md"), (1, "标题（一）.md"), (2, "../up.md"), (3, "a b.md"), (4, "x.txt"), (5, "Ünï-1.md")]


@query(
    "safe_file_names",
    rf"""WITH {LINES_SQL}, names AS (SELECT doc_id, line_seq, CASE WHEN line_seq % 2 = 0 THEN replace(text, ' ', '-') ELSE text END || '.md' AS name FROM lines UNION ALL SELECT -1, id, text FROM {tables.sql_values(FILES, TEXT_SCHEMA)})
        SELECT doc_id, line_seq, regexp_full_match(name, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}（）()-]+\.md') AS safe FROM names""",
)
def safe_file_names(spark, sf_dir):
    """Lines as names of files, those with an even number with hyphens for spaces."""
    name = F.concat(F.when(F.col("line_seq") % 2 == 0, F.replace("text", F.lit(" "), F.lit("-"))).otherwise(F.col("text")), F.lit(".md"))
    rows = lines(spark, sf_dir).select("doc_id", "line_seq", name.alias("name")).unionByName(tables.fixture(spark, FILES, TEXT_SCHEMA).select(F.lit(-1).cast("long").alias("doc_id"), F.col("id").alias("line_seq"), F.col("text").alias("name")))
    return rows.select("doc_id", "line_seq", t.safe_file_name(F.col("name")).alias("safe"))


@query(
    "json_repair",
    r"""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE regexp_replace(text, '["\\]', chr(39), 'g') END AS first FROM conversations""",
)
def json_repair(spark, sf_dir):
    """Turns as replies: whole, in a fence, without the last brace, without quote and brace, and no JSON at all."""
    start, k = F.concat(F.lit('{"1": "'), F.regexp_replace("text", r'["\\]', "'")), F.col("turn") % 5
    made = F.when(k == 0, F.concat(start, F.lit('", "2": "x"}'))).when(k == 1, F.concat(F.lit("```json\n"), start, F.lit('"}\n```'))).when(k == 2, F.concat(start, F.lit('"'))).when(k == 3, start).otherwise("no json")
    table = t.repaired_json(t.strip_fences(made), "map<string,string>")
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(table, "1").alias("first"))


#: Fonts of a line's words, by the number of the document and of the word.
FONTS = ["CMMI10", "CMR10", "Times", "CMSY8", "msbm7", "EulerMath", "Arial"]


@query(
    "math_only_lines",
    f"""WITH {LINES_SQL}, words AS (SELECT doc_id, line_seq, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS k FROM lines),
        spans AS (SELECT *, {FONTS}[((doc_id + CASE WHEN line_seq % 3 = 0 THEN k ELSE 0 END) % {len(FONTS)})::INTEGER + 1] AS font FROM words)
        SELECT doc_id, line_seq, bool_or(regexp_matches(font, '(?i)^CM(MI|SY|EX)')) AND 100 * sum(CASE WHEN regexp_matches(font, '(?i)^(CM|MSAM|MSBM|Euler)|Math') THEN length(w) ELSE 0 END) >= 85 * sum(length(w)) AS math_only FROM spans GROUP BY doc_id, line_seq""",
)
def math_only_lines(spark, sf_dir):
    """A line's words as spans, of one font or, in every third line, of several."""
    font = lambda k: F.get(F.array(*map(F.lit, FONTS)), ((F.col("doc_id") + F.when(F.col("line_seq") % 3 == 0, k).otherwise(0)) % len(FONTS)).cast("int"))
    spans = F.transform(F.split("text", " "), lambda w, k: F.struct(font(k).alias("font"), w.alias("text")))
    return lines(spark, sf_dir).select("doc_id", "line_seq", t.is_math_only(spans).alias("math_only"))
