"""Tables in and out: laid-out lines, glossary files, dimensions, Markdown files, run logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as t

LINES = "doc_id long, line_seq int, page int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, math_only boolean"
PAGES = "doc_id long, page int, width double, height double"
#: Fixed values of the adapters: lines of a page, their distance, type sizes, and a page's size.
PAGE_LINES, STEP, BODY, HEADING, TINY, WIDTH, HEIGHT = 20, 14.0, 12.0, 20.0, 7.0, 595.0, 842.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_lines(documents: DataFrame) -> DataFrame:
    """Plain documents as laid-out lines: a line of text is a line, twenty are a page; type sizes and columns follow from the numbers alone."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_seq", "raw")).withColumn("text", t.clean_space(F.col("raw"))).where("text <> ''")
    place = F.col("line_seq") % PAGE_LINES
    x0 = F.when((F.col("doc_id") % 4 == 0) & (place >= PAGE_LINES // 2), 310.0).otherwise(10.0)
    y0 = 40.0 + STEP * F.when(F.col("doc_id") % 4 == 0, F.col("line_seq") % (PAGE_LINES // 2)).otherwise(place) + F.when(F.col("line_seq") % 6 == 5, 2.0).otherwise(0.0)
    size = F.when((F.length("text") < 40) & (F.col("line_seq") % 5 == 0), HEADING).when(F.col("line_seq") % 11 == 10, TINY).otherwise(BODY)
    return rows.select(
        "doc_id", "line_seq", F.floor(F.col("line_seq") / PAGE_LINES).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.least(F.length("text"), F.lit(80)) * 3.0).alias("x1"), (y0 + size).alias("y1"), "text", size.alias("font_size"), F.lit(False).alias("math_only"),
    )


def page_sizes(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def html_paragraphs(pages: DataFrame) -> DataFrame:
    """Web pages as paragraphs: headings of the first level in large type, other paragraphs in body type, in order."""
    block = r"(?s)<(h1|p)(?:\s[^>]*)?>(.*?)</\1>"
    found = F.regexp_extract_all("html", F.lit(r"(?s)<h1(?:\s[^>]*)?>.*?</h1>|<p(?:\s[^>]*)?>.*?</p>"), F.lit(0))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("para_seq", "raw"))
    rows = rows.withColumn("tag", F.regexp_extract("raw", block, 1)).withColumn("text", t.clean_space(F.regexp_replace(F.regexp_extract("raw", block, 2), "<[^>]*>", " ")))
    size = F.when(F.col("tag") == "h1", HEADING).otherwise(BODY)
    return rows.where("text <> ''").select("doc_id", "para_seq", F.lit(0).alias("page"), size.alias("font_size"), F.lit(None).cast("string").alias("special"), "text")


def styles_and_domains(style_files: list[str], domain_files: list[str]) -> tuple[list[str], list[str]]:
    """The two dimensions that a listing of files defines."""
    styles = sorted(f.removesuffix("_style.md") for f in style_files if f.endswith("_style.md"))
    domains = sorted(f.removeprefix("glossary_").removesuffix(".json") for f in domain_files if f.startswith("glossary_") and f.endswith(".json") and not f.endswith("_rejected.json"))
    return styles, domains


def manifest(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    items = spark.read.schema("pdf string, base_style string, domains array<string>, expected_articles int").option("multiLine", True).json(path)
    return items.where(F.contains("pdf", F.lit(only))) if only else items


def there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def reference_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """One paragraph a line, trimmed, none empty. A missing file has none, so that its metric is null."""
    if not there(spark, path):
        return spark.createDataFrame([], "text string")
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def search_digests(hits: DataFrame, most: int = 3, chars: int = 240) -> DataFrame:
    """hits (term, rank, title, content) to one digest a term: the first three with content, cut; a term without any is left out."""
    place = F.row_number().over(Window.partitionBy("term").orderBy("rank"))
    rows = hits.where(F.col("rank") <= most).where(F.coalesce(F.trim("content"), F.lit("")) != "").withColumn("place", place)
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), t.preview(F.col("content"), chars))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("term").agg(F.array_join(listed, "\n").alias("digest"), F.count(F.lit(1)).alias("n_hits"))


def write_markdown(rendered: DataFrame, path: str) -> None:
    """rendered (output_path, md) as one text file each, path/output_path, replacing what is there. Tasks write; the driver only gives each file its name."""
    rows = rendered.select("output_path", F.regexp_replace("md", "\n$", "").alias("value"))  # the writer ends it with a line break
    made = f"{path}/.made"
    rows.repartition("output_path").write.mode("overwrite").partitionBy("output_path").text(made)
    context = rendered.sparkSession.sparkContext
    of = context._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(context._jsc.hadoopConfiguration())
    for folder in files.listStatus(of(made)):
        if folder.isDirectory():
            name = context._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getPath().getName().split("=", 1)[1])
            parts = files.globStatus(of(folder.getPath(), "part-*"))
            files.delete(of(f"{path}/{name}"), False)
            files.rename(parts[0].getPath(), of(f"{path}/{name}"))
    files.delete(of(made), True)


def run_log(summary: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("value"))


def write_json(summary: DataFrame, path: str) -> None:
    run_log(summary).write.mode("overwrite").text(path)


def append_archive(rejected: DataFrame, path: str) -> None:
    rejected.write.mode("append").parquet(path)


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], schema: str) -> str:
    """The same rows as a DuckDB table expression."""
    names, kinds = zip(*(c.strip().split(" ", 1) for c in schema.split(", ")))
    kind = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "timestamp_ntz": "TIMESTAMP", "array<int>": "INTEGER[]"}

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (list, tuple)):
            return f"[{', '.join(map(one, v))}]"
        return "'" + str(v).replace("'", "''") + "'" if not isinstance(v, (int, float)) else repr(v)

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"(SELECT {', '.join(f'c{i}::{kind[k]} AS {n}' for i, (n, k) in enumerate(zip(names, kinds)))} FROM (VALUES {body}) v({', '.join(f'c{i}' for i in range(len(names)))}))"


def read_json_file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
