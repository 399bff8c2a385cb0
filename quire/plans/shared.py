"""What the queries share: fixtures as rows and as SQL, and the adapters' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.sources import tables

UNICODE_SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def count_sql(text: str, chars: str) -> str:
    return f"len(regexp_extract_all({text}, '[{chars}]'))"


#: The adapter of documents as common table expressions.
LINES_SQL = rf"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_seq FROM documents),
cleaned AS (SELECT doc_id, line_seq, trim(regexp_replace(raw, '{UNICODE_SPACE}+', ' ', 'g')) AS text FROM raw),
placed AS (SELECT doc_id, line_seq::INTEGER AS line_seq, text, CASE WHEN doc_id % 4 = 0 AND line_seq % 20 >= 10 THEN 310.0::DOUBLE ELSE 10.0::DOUBLE END AS x0,
                  (40 + 14 * CASE WHEN doc_id % 4 = 0 THEN line_seq % 10 ELSE line_seq % 20 END + CASE WHEN line_seq % 6 = 5 THEN 2 ELSE 0 END)::DOUBLE AS y0,
                  CASE WHEN length(text) < 40 AND line_seq % 5 = 0 THEN 20.0::DOUBLE WHEN line_seq % 11 = 10 THEN 7.0::DOUBLE ELSE 12.0::DOUBLE END AS font_size
           FROM cleaned WHERE text <> ''),
lines AS (SELECT doc_id, line_seq, (line_seq // 20)::INTEGER AS page, x0, y0, x0 + least(length(text), 80) * 3.0::DOUBLE AS x1, y0 + font_size AS y1, text, font_size FROM placed)"""

#: The adapter of web pages.
PARAGRAPHS_SQL = rf"""
found AS (SELECT page_id AS doc_id, regexp_extract_all(html, '(?s)<h1(?:\s[^>]*)?>.*?</h1>|<p(?:\s[^>]*)?>.*?</p>') AS blocks FROM pages),
blocks AS (SELECT doc_id, unnest(blocks) AS raw, unnest(range(len(blocks)))::INTEGER AS para_seq FROM found),
paragraphs AS (SELECT * FROM (SELECT doc_id, para_seq, CASE WHEN starts_with(raw, '<h1') THEN 20.0::DOUBLE ELSE 12.0::DOUBLE END AS font_size,
                      trim(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)^<(h1|p)(?:\s[^>]*)?>|</(h1|p)>$', '', 'g'), '<[^>]*>', ' ', 'g'), '{UNICODE_SPACE}+', ' ', 'g')) AS text
               FROM blocks) WHERE text <> '')"""

TERMS = [
    ("econ", "license", "License", "许可证（牌照）", "law", "seed", "2024-01-01"),
    ("econ", "that", "that", "那个", "word", "web_search", "2024-01-02"),
    ("econ", "the", "the", "the", "word", "llm_fallback", "2024-01-03"),
    ("econ", "general public", "General Public", "《通用公共》", "law", "web_search", "2024-01-04"),
    ("cs", "that", "That", "该", "word", "web_search", "2024-01-05"),
    ("cs", "with", "with", "和", "word", "seed", "2024-01-06"),
    ("cs", "public license", "Public License", "公共许可证", "law", "web_search", "2024-01-07"),
    ("pm", "version", "Version", "版本", "word", "web_search", "2024-01-08"),
]
TERM_SCHEMA = "domain string, en_lower string, en string, zh string, category string, source string, added_date string"
GLOSSARY_SQL = tables.sql_values(TERMS, TERM_SCHEMA)
DOMAIN_ORDER = [("econ", 0), ("cs", 1)]
MERGED_SQL = f"(SELECT g.*, r.domain_rank FROM {GLOSSARY_SQL} g JOIN {tables.sql_values(DOMAIN_ORDER, 'domain string, domain_rank int')} r USING (domain) QUALIFY row_number() OVER (PARTITION BY en_lower ORDER BY domain_rank) = 1)"


def glossary(spark: SparkSession) -> DataFrame:
    return tables.fixture(spark, TERMS, TERM_SCHEMA)


def ranks(spark: SparkSession) -> DataFrame:
    return tables.fixture(spark, DOMAIN_ORDER, "domain string, domain_rank int")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.document_lines(tables.read(spark, sf_dir, "documents"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.html_paragraphs(tables.read(spark, sf_dir, "pages"))


def rendered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a stand-in rendering: one term is always kept, one in every second line."""
    low = F.lower("text")
    zh = F.replace(F.replace(low, F.lit("license"), F.lit("许可证")), F.lit("that"), F.when(F.col("line_seq") % 2 == 0, "那个").otherwise("that"))
    return lines(spark, sf_dir).select("doc_id", F.col("line_seq").alias("seg_seq"), F.col("text").alias("en"), zh.alias("zh"), (F.col("line_seq") % 13 == 12).alias("failed"))


PAIRS_SQL = """pairs AS (SELECT doc_id, line_seq AS seg_seq, text AS en,
                  replace(replace(lower(text), 'license', '许可证'), 'that', CASE WHEN line_seq % 2 = 0 THEN '那个' ELSE 'that' END) AS zh, line_seq % 13 = 12 AS failed FROM lines)"""
HAN = t.HAN
