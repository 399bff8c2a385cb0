"""Queries of translation, rendering, evaluation and the job table."""

from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import jobs, render, segments, translate
from quire.operators import metrics as m
from quire.operators.folds import settle
from quire.plans.layout_queries import SLICES_SQL, marked
from quire.plans.registry import query
from quire.plans.shared import LINES_SQL, lines
from quire.sources import boundary, tables

BATCHES_SQL = f"""WITH RECURSIVE {LINES_SQL}, n AS (SELECT doc_id, line_seq, length(text) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY line_seq) AS k FROM lines),
    walk AS (SELECT doc_id, line_seq, k, len AS chars, 1 AS items, 0 AS batch FROM n WHERE k = 1
             UNION ALL SELECT n.doc_id, n.line_seq, n.k, CASE WHEN w.items >= 8 OR w.chars + n.len > 2400 THEN n.len ELSE w.chars + n.len END, CASE WHEN w.items >= 8 OR w.chars + n.len > 2400 THEN 1 ELSE w.items + 1 END,
                              w.batch + CASE WHEN w.items >= 8 OR w.chars + n.len > 2400 THEN 1 ELSE 0 END FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1)"""


@query("translation_batches", f"{BATCHES_SQL} SELECT doc_id, line_seq, batch FROM walk")
def translation_batches(spark, sf_dir):
    return translate.batches(lines(spark, sf_dir), ["doc_id"], "line_seq").drop("text")


SEGMENTS_SQL = f"""{SLICES_SQL},
    segs AS (SELECT doc_id, article_index, 0 AS seg_seq, 'title' AS role, title AS text, false AS is_heading FROM articles UNION ALL SELECT doc_id, article_index, 1, 'subtitle', subtitle, false FROM articles WHERE subtitle <> ''
             UNION ALL SELECT b.doc_id, b.article_index, b.seg_seq + CASE WHEN a.subtitle <> '' THEN 2 ELSE 1 END, 'body', b.text, b.is_heading FROM bodies b JOIN articles a USING (doc_id, article_index)),
    flagged AS (SELECT *, role = 'body' AND NOT is_heading AND (len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) < 2) AS verbatim FROM segs)"""


def segmented(spark, sf_dir):
    return settle(translate.verbatim(translate.segments(segments.article_slices(marked(spark, sf_dir)))))


@query("translation_segments", f"WITH {SEGMENTS_SQL} SELECT doc_id, article_index, seg_seq, role, text, is_heading, verbatim FROM flagged")
def translation_segments(spark, sf_dir):
    """Web pages hold no Han and no mathematics, so that words alone decide what is prose."""
    return segmented(spark, sf_dir)


def stand_in_replies(batched):
    """Pages whose number is divisible by 7 never get a usable reply, those divisible by 5 only the second; a reply is the text with capital vowels."""
    item = F.struct(F.col("seg_seq"), F.concat(F.lit('"'), (F.col("seg_seq") + 1).cast("string"), F.lit('": "'), F.translate(F.regexp_replace("text", r'["\\\\]', "'"), "aeiou", "AEIOU"), F.lit('"')).alias("x"))
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]), ", "))
    whole = batched.groupBy("doc_id", "article_index", "batch").agg(body.alias("open"))
    first = F.when((F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 5 == 0), F.lit("{}")).otherwise(F.concat("open", F.lit("}")))
    second = F.when(F.col("doc_id") % 7 == 0, F.lit("no json")).otherwise(F.col("open"))  # its last brace is missing
    rows = whole.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select("doc_id", "article_index", "batch", "attempt", F.when(F.col("attempt") == 1, first).otherwise(second).alias("body"), F.lit(100).cast("long").alias("tokens_in"), F.lit(50).cast("long").alias("tokens_out"))


def paired(spark, sf_dir):
    rows = segmented(spark, sf_dir)
    batched = settle(translate.batches(rows.where(~F.col("verbatim"))))
    return translate.pairs(rows, translate.parsed_replies(batched, stand_in_replies(batched)))


PAIRED_SQL = f"{SEGMENTS_SQL}, paired AS (SELECT doc_id, article_index, seg_seq, role, text AS en, CASE WHEN verbatim THEN text WHEN doc_id % 7 = 0 THEN '{t.FAILED_MARK}' ELSE translate(regexp_replace(text, '[\"\\\\]', '''', 'g'), 'aeiou', 'AEIOU') END AS zh, NOT verbatim AND doc_id % 7 = 0 AS failed, is_heading FROM flagged)"


@query("pair_assembly", f"WITH {PAIRED_SQL} SELECT * FROM paired")
def pair_assembly(spark, sf_dir):
    return paired(spark, sf_dir)


@query("translated_titles", f"WITH {PAIRED_SQL} SELECT doc_id, article_index, max(zh) FILTER (role = 'title') AS zh_title, coalesce(max(zh) FILTER (role = 'subtitle'), '') AS zh_subtitle FROM paired GROUP BY doc_id, article_index")
def translated_titles(spark, sf_dir):
    return translate.titles(paired(spark, sf_dir))


@query("failed_batches", f"WITH {PAIRED_SQL} SELECT doc_id, article_index, count(*) AS n_segments FROM paired WHERE failed GROUP BY doc_id, article_index")
def failed_batches(spark, sf_dir):
    batched = settle(translate.batches(segmented(spark, sf_dir).where(~F.col("verbatim"))))
    lost = translate.failed_batches(batched, translate.parsed_replies(batched, stand_in_replies(batched)))
    return lost.groupBy("doc_id", "article_index").agg(F.sum("n_segments").alias("n_segments"))


@query("translation_requests", f"WITH {SEGMENTS_SQL} SELECT doc_id, article_index, count(*) AS n_returned FROM flagged WHERE NOT verbatim GROUP BY doc_id, article_index")
def translation_requests(spark, sf_dir):
    """Requests through the boundary with the stand-in that echoes, and the share of segments that come back."""
    batched = settle(translate.batches(segmented(spark, sf_dir).where(~F.col("verbatim"))))
    asked = translate.prompts(batched)
    key = F.concat_ws("/", "doc_id", "article_index", "batch")
    replies = boundary.answer(asked.select(F.lit("translate").alias("kind"), key.alias("key"), "payload"))
    parts = F.split("key", "/")
    rows = replies.select(parts[0].cast("long").alias("doc_id"), parts[1].cast("int").alias("article_index"), parts[2].cast("int").alias("batch"), "attempt", "body")
    return translate.parsed_replies(batched, rows).groupBy("doc_id", "article_index").agg(F.count(F.lit(1)).alias("n_returned"))


CHARS = {"這": "这", "經": "经", "濟": "济"}
STATES = ["traditional", "simplified", "mixed", "none"]


@query(
    "script_conversion",
    f"""WITH made AS (SELECT doc_id, {STATES}[(doc_id % 4)::INTEGER + 1] AS script_state, translate(text, 'aeioub', '這經濟「」『') AS text FROM documents)
        SELECT doc_id, CASE WHEN script_state IN ('traditional', 'mixed') THEN translate(text, '這經濟「」『』', '这经济“”‘’') ELSE text END AS zh, false AS failed FROM made""",
)
def script_conversion(spark, sf_dir):
    """Documents with characters of the table and quotation marks in place of letters, a script state to each by its number."""
    state = F.get(F.array(*map(F.lit, STATES)), (F.col("doc_id") % 4).cast("int"))
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", state.alias("script_state"), F.translate("text", "aeioub", "這經濟「」『").alias("text"))
    return translate.converted(rows, CHARS).select("doc_id", "zh", "failed")


AS_OF = "2024-01-31 00:00:00"


def rendered(spark, sf_dir):
    articles = segments.article_slices(marked(spark, sf_dir)).drop("body")
    rows = settle(paired(spark, sf_dir))
    pair = F.struct("seg_seq", "en", "zh", "failed", "is_heading")
    listed = rows.groupBy("doc_id", "article_index").agg(F.sort_array(F.filter(F.collect_list(F.when(F.col("role") == "body", pair)), lambda p: p.isNotNull())).alias("pairs"))
    whole = articles.join(listed, ["doc_id", "article_index"]).join(translate.titles(rows), ["doc_id", "article_index"])
    return whole.select("*", F.lit("bilingual").alias("mode"), F.concat(F.lit("page-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_name"), F.lit("economist").alias("base_style"), F.array(F.lit("econ"), F.lit("cs")).alias("domains"))


MONEY = r"regexp_replace({}, '\$(\p{{Nd}})', '\\$\1', 'g')"
TITLE_SQL = f"CASE WHEN t.zh_title <> '' AND t.zh_title <> '{t.FAILED_MARK}' THEN t.zh_title || ' | ' || a.title ELSE a.title END"
MARKDOWN_SQL = rf"""{PAIRED_SQL},
    tt AS (SELECT doc_id, article_index, max(zh) FILTER (role = 'title') AS zh_title, coalesce(max(zh) FILTER (role = 'subtitle'), '') AS zh_subtitle FROM paired GROUP BY doc_id, article_index),
    md_blocks AS (SELECT doc_id, article_index, seg_seq, CASE WHEN is_heading THEN CASE WHEN failed OR trim(zh) = trim(en) THEN '## ' || {MONEY.format('en')} ELSE '## ' || {MONEY.format('zh')} || ' | ' || {MONEY.format('en')} END
                      WHEN failed THEN {MONEY.format('en')} || chr(10) || chr(10) || '{t.FAILED_MARK}' || chr(10) || chr(10) || {MONEY.format('en')} WHEN trim(zh) = trim(en) THEN {MONEY.format('en')}
                      ELSE {MONEY.format('en')} || chr(10) || chr(10) || {MONEY.format('zh')} END AS block FROM paired WHERE role = 'body'),
    joined AS (SELECT doc_id, article_index, string_agg(block, chr(10) || chr(10) ORDER BY seg_seq) AS body FROM md_blocks GROUP BY doc_id, article_index)"""


@query(
    "markdown_render",
    rf"""WITH {MARKDOWN_SQL} SELECT a.doc_id, a.article_index, concat_ws(chr(10) || chr(10), '# ' || {MONEY.format(TITLE_SQL)},
            '> Source: `page-' || a.doc_id || '.pdf` · Style: economist × econ+cs · Generated on 2024-01-31 · Machine translation — verify before quoting.',
            CASE WHEN a.subtitle <> '' THEN '**' || {MONEY.format('a.subtitle')} || '**' END, CASE WHEN a.subtitle <> '' AND t.zh_subtitle <> '' AND t.zh_subtitle <> '{t.FAILED_MARK}' THEN '**' || {MONEY.format('t.zh_subtitle')} || '**' END, j.body) || chr(10) AS md
        FROM articles a JOIN tt t USING (doc_id, article_index) LEFT JOIN joined j USING (doc_id, article_index)""",
)
def markdown_render(spark, sf_dir):
    return render.markdown(rendered(spark, sf_dir), "2024-01-31").select("doc_id", "article_index", "md")


@query(
    "markdown_chinese",
    rf"""WITH {MARKDOWN_SQL}, zh_blocks AS (SELECT doc_id, article_index, string_agg(CASE WHEN is_heading THEN '## ' ELSE '' END || {MONEY.format('zh')}, chr(10) || chr(10) ORDER BY seg_seq) AS body FROM paired WHERE role = 'body' GROUP BY doc_id, article_index)
        SELECT a.doc_id, a.article_index, concat_ws(chr(10) || chr(10), '# ' || {MONEY.format("coalesce(nullif(t.zh_title, ''), a.title)")},
            '> Source: `page-' || a.doc_id || '.pdf` · Style: economist × econ+cs · Generated on 2024-01-31 · Converted to Simplified Chinese.',
            CASE WHEN t.zh_subtitle <> '' THEN '**' || {MONEY.format('t.zh_subtitle')} || '**' END, z.body) || chr(10) AS md
        FROM articles a JOIN tt t USING (doc_id, article_index) LEFT JOIN zh_blocks z USING (doc_id, article_index)""",
)
def markdown_chinese(spark, sf_dir):
    return render.markdown(rendered(spark, sf_dir).withColumn("mode", F.lit("chinese_only")), "2024-01-31").select("doc_id", "article_index", "md")


@query("article_results", f"WITH {PAIRED_SQL} SELECT a.doc_id, a.article_index, a.title, (SELECT count(*) FROM paired p WHERE p.doc_id = a.doc_id AND p.article_index = a.article_index AND p.role = 'body')::INTEGER AS n_paragraphs, (SELECT count(*) FROM paired p WHERE p.doc_id = a.doc_id AND p.article_index = a.article_index AND p.role = 'body' AND p.failed)::INTEGER AS n_failed, 'bilingual' AS mode FROM articles a")
def article_results(spark, sf_dir):
    return render.results(rendered(spark, sf_dir)).drop("output_path")


@query("run_logs", f"WITH {PAIRED_SQL} SELECT a.title, (SELECT count(*) FROM paired p WHERE p.doc_id = a.doc_id AND p.article_index = a.article_index AND p.role = 'body')::INTEGER AS n_paragraphs, (SELECT count(*) FROM paired p WHERE p.doc_id = a.doc_id AND p.article_index = a.article_index AND p.role = 'body' AND p.failed)::INTEGER AS n_failed, 'bilingual' AS mode FROM articles a")
def run_logs(spark, sf_dir):
    """Each article's summary as one JSON document, read back."""
    back = F.from_json("value", "title string, n_paragraphs int, n_failed int, mode string")
    return tables.run_log(render.results(rendered(spark, sf_dir))).select(back.alias("r")).select("r.*")


@query("split_accuracy", f"WITH {SLICES_SQL}, n AS (SELECT doc_id, count(*) AS n_articles FROM articles GROUP BY doc_id) SELECT page_id AS doc_id, 1 AS expected_articles, coalesce(n_articles, 0) AS n_articles, coalesce(n_articles, 0) = 1 AS correct FROM pages LEFT JOIN n ON doc_id = page_id")
def split_accuracy(spark, sf_dir):
    manifest = tables.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("expected_articles"))
    return m.split_accuracy(segments.article_slices(marked(spark, sf_dir)), manifest)


@query(
    "boundary_f1",
    f"""WITH {LINES_SQL}, made AS (SELECT d.lang, l.text FROM lines l JOIN documents d USING (doc_id)), known AS (SELECT 'en' AS lang, trim(b.text) AS text FROM benchmark b WHERE trim(b.text) <> ''
          UNION ALL SELECT lang, text FROM made WHERE length(text) % 9 = 0),
        c AS (SELECT lang, count(*) AS n_reference FROM known GROUP BY lang), p AS (SELECT lang, count(*) AS n_produced FROM made GROUP BY lang), x AS (SELECT lang, count(*) AS n_matches FROM (SELECT DISTINCT * FROM made INTERSECT SELECT DISTINCT * FROM known) GROUP BY lang)
        SELECT lang, coalesce(n_produced, 0) AS n_produced, n_reference, coalesce(n_matches, 0) AS n_matches,
               CASE WHEN coalesce(n_matches, 0) = 0 THEN 0.0 ELSE round(2 * (n_matches / n_produced) * (n_matches / n_reference) / (n_matches / n_produced + n_matches / n_reference), 3) END::DOUBLE AS f1 FROM c LEFT JOIN p USING (lang) LEFT JOIN x USING (lang)""",
)
def boundary_f1(spark, sf_dir):
    """Lines against benchmark passages, which are English, and every line whose length nine divides."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "lang")
    made = lines(spark, sf_dir).join(docs, "doc_id").select("lang", "text")
    known = tables.read(spark, sf_dir, "benchmark").select(F.lit("en").alias("lang"), "text").unionByName(made.where(F.length("text") % 9 == 0))
    return m.boundary_f1(made, known, ["lang"])


TURNS_SQL = "turns AS (SELECT conv_id, turn, text AS en, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS zh, role FROM conversations), pairs AS (SELECT conv_id, turn, en, zh, zh IS NULL AS failed FROM turns WHERE role = 'user')"


def turns(spark, sf_dir):
    """A user's turn and what follows it."""
    from pyspark.sql import Window

    rows = tables.read(spark, sf_dir, "conversations").withColumn("zh", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("en"), "zh", F.col("zh").isNull().alias("failed"))


@query(
    "judge_samples",
    f"""WITH {TURNS_SQL}, n AS (SELECT conv_id, turn, en, zh, row_number() OVER w - 1 AS place, greatest(1, floor(count(*) OVER (PARTITION BY conv_id) / 6)::BIGINT) AS step FROM pairs WHERE NOT failed AND coalesce(en, '') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, left(en, 1500) AS en, left(zh, 1500) AS zh, (place // step)::INTEGER AS sample FROM n WHERE place % step = 0 AND place < 6 * step""",
)
def judge_samples(spark, sf_dir):
    return m.judge_samples(turns(spark, sf_dir), ["conv_id"], ["turn"]).drop("failed")


@query(
    "judge_means",
    """WITH s AS (SELECT doc_id % 20 AS item, CASE WHEN doc_id % 7 IN (0, 1) THEN NULL ELSE quality + 3 END AS a, toxic + 2 AS f FROM labels)
       SELECT item, round(avg(a), 2) AS accuracy, round(avg(CASE WHEN a IS NOT NULL THEN f END), 2) AS fluency, count(a) AS n FROM s GROUP BY item""",
)
def judge_means(spark, sf_dir):
    """Labels as a judge's replies: some are no JSON, some lack a score, some a brace, some are fenced."""
    k = F.col("doc_id") % 7
    accuracy = F.concat(F.lit('{"accuracy": '), (F.col("quality") + 3).cast("string"))
    whole = F.concat(accuracy, F.lit(', "fluency": '), (F.col("toxic") + 2).cast("string"))
    body = F.when(k == 0, "none").when(k == 1, F.concat(accuracy, F.lit("}"))).when(k == 2, whole).when(k == 3, F.concat(F.lit("```json\n"), whole, F.lit("}\n```"))).otherwise(F.concat(whole, F.lit("}")))
    return m.judge_means(tables.read(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("item"), body.alias("body")), ["item"])


EVENTS_SQL = """jobs AS (SELECT event_id::VARCHAR AS id, ts AS created_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'done' END AS status, value / 1000 AS cost_usd, user_id FROM events)"""


def job_table(spark, sf_dir):
    """Events as jobs."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "running").otherwise("done")
    nothing = F.lit(None)
    return tables.read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("value") / 1000).alias("cost_usd"), "user_id", nothing.cast("string").alias("error"), nothing.cast("timestamp_ntz").alias("finished_at")
    )


@query("token_cost", "SELECT event_type AS node, count(*) AS llm_calls, sum(user_id * 1000)::BIGINT AS tokens_in, sum(event_id * 10)::BIGINT AS tokens_out, round(sum(user_id * 1000) / 1e6 * 0.27::DOUBLE + sum(event_id * 10) / 1e6 * 1.1::DOUBLE, 4) AS cost_usd FROM events GROUP BY event_type")
def token_cost(spark, sf_dir):
    usage = tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("node"), (F.col("user_id") * 1000).alias("input_tokens"), (F.col("event_id") * 10).alias("output_tokens"))
    return m.usage_cost(usage, ["node"])


@query("month_spend", f"WITH {EVENTS_SQL} SELECT round(sum(cost_usd), 6) AS spend, sum(cost_usd) >= 5.0 AS exhausted FROM jobs WHERE date_trunc('month', created_at) = TIMESTAMP '2024-01-01'")
def month_spend(spark, sf_dir):
    return jobs.month_spend(job_table(spark, sf_dir), AS_OF).withColumn("spend", F.round("spend", 6))


@query("job_history", f"WITH {EVENTS_SQL} SELECT id, created_at, status FROM jobs ORDER BY created_at DESC, id LIMIT 50")
def job_history(spark, sf_dir):
    return jobs.recent(job_table(spark, sf_dir), 500).select("id", "created_at", "status")


STYLES, DOMAINS, CHOSEN = ["economist", "academy"], ["econ", "cs", "pm"], [["econ"], [], ["cs", "x", "y"], ["cs", "econ", "cs"], None]


@query(
    "upload_checks",
    f"""WITH u AS (SELECT event_id AS id, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'a.txt' WHEN 2 THEN 'A.PDF' ELSE event_type || '.pdf' END AS file_name, (event_id % 53) * 524288 AS n_bytes, CASE event_id % 13 WHEN 0 THEN 'plain' WHEN 1 THEN 'academy' ELSE 'economist' END AS base_style,
                        list_distinct(coalesce(CASE event_id % 5 WHEN 0 THEN ['econ'] WHEN 1 THEN [] WHEN 2 THEN ['cs', 'x', 'y'] WHEN 3 THEN ['cs', 'econ', 'cs'] END, [])) AS domains FROM events),
        e AS (SELECT *, CASE WHEN file_name IS NULL THEN 'missing file field ' || chr(39) || 'pdf' || chr(39) WHEN lower(file_name) NOT LIKE '%.pdf' THEN 'only .pdf files are accepted' WHEN n_bytes > 26214400 THEN 'file exceeds the 25 MB limit' WHEN base_style = 'plain' THEN 'unknown base style ' || chr(39) || 'plain' || chr(39)
                             WHEN list_contains(domains, 'x') THEN 'unknown domain(s): x, y' END AS error FROM u)
        SELECT id, error, list_sort(CASE WHEN error IS NULL AND len(domains) = 0 THEN [CASE base_style WHEN 'economist' THEN 'econ' ELSE 'cs' END] ELSE domains END) AS domains FROM e""",
)
def upload_checks(spark, sf_dir):
    """Events as uploads with every fault."""
    n = F.col("event_id")
    name = F.when(n % 11 == 1, "a.txt").when(n % 11 == 2, "A.PDF").when(n % 11 > 2, F.concat("event_type", F.lit(".pdf")))
    chosen = F.get(F.array(*(F.array(*map(F.lit, c)).cast("array<string>") if c is not None else F.lit(None).cast("array<string>") for c in CHOSEN)), (n % 5).cast("int"))
    rows = tables.read(spark, sf_dir, "events").select(n.alias("id"), name.alias("file_name"), ((n % 53) * 524288).alias("n_bytes"), F.when(n % 13 == 0, "plain").when(n % 13 == 1, "academy").otherwise("economist").alias("base_style"), chosen.alias("domains"))
    return jobs.checked_uploads(rows, STYLES, DOMAINS, {"economist": "econ", "academy": "cs"}).select("id", "error", F.sort_array("domains").alias("domains"))


STALE_SQL = "status IN ('queued', 'running') AND created_at < TIMESTAMP '2024-01-31' - INTERVAL 45 MINUTE"


@query("stale_sweep", f"WITH {EVENTS_SQL} SELECT id, CASE WHEN {STALE_SQL} THEN 'failed' ELSE status END AS status, CASE WHEN {STALE_SQL} THEN 'marked stale after 45 min (worker lost or restarted)' END AS error, CASE WHEN {STALE_SQL} THEN TIMESTAMP '2024-01-31' END AS finished_at FROM jobs")
def stale_sweep(spark, sf_dir):
    return jobs.swept(job_table(spark, sf_dir), AS_OF).select("id", "status", "error", "finished_at")


@query("retention", f"WITH {EVENTS_SQL} SELECT id, status FROM jobs WHERE NOT (status IN ('done', 'failed') AND created_at < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)")
def retention(spark, sf_dir):
    return jobs.retained(job_table(spark, sf_dir), AS_OF).select("id", "status")


@query("orphan_dirs", f"WITH {EVENTS_SQL} SELECT DISTINCT (user_id * 97)::VARCHAR AS name FROM jobs WHERE (user_id * 97)::VARCHAR NOT IN (SELECT id FROM jobs)")
def orphan_dirs(spark, sf_dir):
    rows = job_table(spark, sf_dir)
    return jobs.orphan_dirs(rows.select((F.col("user_id") * 97).cast("string").alias("name")).distinct(), rows)


@query("clear_history", f"WITH {EVENTS_SQL} SELECT id, status, NULL::BIGINT AS n_cleared FROM jobs WHERE status NOT IN ('done', 'failed') UNION ALL SELECT NULL, NULL, count(*) FROM jobs WHERE status IN ('done', 'failed')")
def clear_history(spark, sf_dir):
    kept, n = jobs.cleared(job_table(spark, sf_dir))
    nothing = F.lit(None).cast("string")
    return kept.select("id", "status", F.lit(None).cast("long").alias("n_cleared")).unionByName(n.select(nothing.alias("id"), nothing.alias("status"), "n_cleared"))


@query("page_cap", f"WITH {LINES_SQL} SELECT doc_id, count(DISTINCT page) AS n_pages FROM lines GROUP BY doc_id HAVING count(DISTINCT page) > 2")
def page_cap(spark, sf_dir):
    return jobs.too_long(tables.page_sizes(lines(spark, sf_dir)), 2)


RESULTS_SQL = """results AS (SELECT user_id::VARCHAR AS job_id, 'out/' || (100000000 + event_id) || '.md' AS output_path, event_type AS title, (event_id % 9)::INTEGER AS n_paragraphs, (event_id % 3)::INTEGER AS n_failed FROM events WHERE event_type <> 'click'),
    spent AS (SELECT user_id::VARCHAR AS job_id, count(*) AS llm_calls, sum(event_id % 1000)::BIGINT AS tokens_in, sum(event_id % 300)::BIGINT AS tokens_out FROM events WHERE event_type = 'click' GROUP BY user_id)"""


def results_of(spark, sf_dir):
    """Events as articles of a user's job."""
    path = F.concat(F.lit("out/"), (F.col("event_id") + 100000000).cast("string"), F.lit(".md"))
    return tables.read(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("user_id").cast("string").alias("job_id"), path.alias("output_path"), F.col("event_type").alias("title"), (F.col("event_id") % 9).cast("int").alias("n_paragraphs"), (F.col("event_id") % 3).cast("int").alias("n_failed"), F.lit("bilingual").alias("mode"))


@query(
    "result_summary",
    f"""WITH {RESULTS_SQL}, r AS (SELECT job_id, string_agg(output_path[5:], ',' ORDER BY output_path) AS files, sum(n_failed)::BIGINT AS n_failed FROM results GROUP BY job_id)
        SELECT job_id, files, n_failed, llm_calls, tokens_in, tokens_out, round(tokens_in / 1e6 * 0.27::DOUBLE + tokens_out / 1e6 * 1.1::DOUBLE, 8) AS cost_usd FROM r LEFT JOIN spent USING (job_id)""",
)
def result_summary(spark, sf_dir):
    clicks = tables.read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 300).alias("output_tokens"))
    found = jobs.result_summary(results_of(spark, sf_dir), clicks)
    files = F.array_join(F.transform("articles", lambda a: a["filename"]), ",")
    return found.select("job_id", files.alias("files"), "n_failed", "llm_calls", "tokens_in", "tokens_out", F.round("cost_usd", 8).alias("cost_usd"))


@query(
    "run_summary",
    f"""WITH {RESULTS_SQL} SELECT 0 AS part, output_path AS key, title || ': ' || n_paragraphs || ' paragraphs, ' || n_failed || ' failed' AS line FROM results
        UNION ALL SELECT 1, 'p' || page_id, 'review: p' || page_id || ' => ' || url FROM pages WHERE page_id % 2 = 0""",
)
def run_summary(spark, sf_dir):
    """Events as articles and pages as new terms, every second of them by the model alone."""
    added = tables.read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("en"), F.col("url").alias("zh"), F.when(F.col("page_id") % 2 == 0, "llm_fallback").otherwise("web_search").alias("source"))
    return jobs.run_summary(results_of(spark, sf_dir), added)


SNAPSHOT_SQL = """snaps AS (SELECT user_id::VARCHAR AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
    stages AS (SELECT job_id, seq, CASE WHEN seq >= 12 THEN 'finished 3 article(s)' WHEN seq >= 6 THEN 'translating: ' || ((seq - 6) // 2)::INTEGER || '/3 article(s) done' WHEN seq >= 5 THEN 'segmented 3 article(s), translating'
                      WHEN seq >= 4 THEN 'cleaning layout & transcribing formulas' WHEN seq >= 2 THEN 'parsing PDF layout' ELSE 'starting' END AS stage FROM snaps)"""


def snapshots(spark, sf_dir):
    """A user's events, in order, as snapshots of a job that goes through all stages."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = tables.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), seq.alias("seq"))
    done = F.when(F.col("seq") >= 6, F.least(F.floor((F.col("seq") - 6) / 2), F.lit(3))).cast("int")
    return rows.select("job_id", "seq", (F.col("seq") >= 2).alias("has_lines"), (F.col("seq") >= 4).alias("has_paragraphs"), F.when(F.col("seq") >= 5, 3).otherwise(0).alias("n_articles"), done.alias("n_results"))


@query("stage_changes", f"WITH {SNAPSHOT_SQL} SELECT job_id, seq, stage FROM (SELECT *, coalesce(lag(stage) OVER (PARTITION BY job_id ORDER BY seq), 'starting') AS before FROM stages) WHERE stage <> before")
def stage_changes(spark, sf_dir):
    return jobs.stage_changes(snapshots(spark, sf_dir))
