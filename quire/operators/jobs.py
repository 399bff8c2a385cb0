"""The job table: history, spend, sweeps and results. `as_of` stands for the clock, so that a query gives the same result on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.metrics import cost

#: Limits of the service.
MOST_JOBS, UPLOAD_MB, PAGES, BUDGET_USD, KEEP_DAYS, STALE_MINUTES = 50, 25, 100, 5.0, 7, 45
TERMINAL = ["done", "failed"]


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def recent(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "id").limit(min(limit, MOST_JOBS))


def month_spend(jobs: DataFrame, as_of: str) -> DataFrame:
    """One row: what the jobs of the calendar month cost, and whether the budget is used up."""
    same = F.date_trunc("month", "created_at") == F.date_trunc("month", moment(as_of))
    spent = jobs.where(same).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend"))
    return spent.withColumn("exhausted", F.col("spend") >= BUDGET_USD)


def upload_error(styles: list[str], domains: list[str]) -> Column:
    """The first thing wrong with an upload (file_name, n_bytes, base_style, domains), or null."""
    unknown = F.filter("domains", lambda d: ~d.isin(domains))
    return (
        F.when(F.col("file_name").isNull(), "missing file field 'pdf'")
        .when(~F.lower("file_name").endswith(".pdf"), "only .pdf files are accepted")
        .when(F.col("n_bytes") > UPLOAD_MB * 1024 * 1024, f"file exceeds the {UPLOAD_MB} MB limit")
        .when(~F.col("base_style").isin(styles), F.concat(F.lit("unknown base style '"), "base_style", F.lit("'")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown domain(s): "), F.array_join(unknown, ", ")))
    )


def checked_uploads(uploads: DataFrame, styles: list[str], domains: list[str], defaults: dict[str, str]) -> DataFrame:
    """uploads with error, and with the domains without repeats, or the style's default where there are none."""
    table = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    rows = uploads.withColumn("domains", F.array_distinct(F.coalesce("domains", F.array().cast("array<string>")))).withColumn("error", upload_error(styles, domains))
    return rows.withColumn("domains", F.when(F.col("error").isNull() & (F.size("domains") == 0), F.array(F.element_at(table, F.col("base_style")))).otherwise(F.col("domains")))


def swept(jobs: DataFrame, as_of: str) -> DataFrame:
    """Jobs that wait or run for too long have failed."""
    stale = F.col("status").isin("queued", "running") & (F.col("created_at") < moment(as_of) - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES"))
    message = f"marked stale after {STALE_MINUTES} min (worker lost or restarted)"
    return jobs.select(
        *(c for c in jobs.columns if c not in ("status", "error", "finished_at")),
        F.when(stale, "failed").otherwise(F.col("status")).alias("status"),
        F.when(stale, message).otherwise(F.col("error")).alias("error"),
        F.when(stale, moment(as_of)).otherwise(F.col("finished_at")).alias("finished_at"),
    )


def expired(as_of: str) -> Column:
    return F.col("status").isin(TERMINAL) & (F.col("created_at") < moment(as_of) - F.expr(f"INTERVAL {KEEP_DAYS} DAYS"))


def retained(jobs: DataFrame, as_of: str) -> DataFrame:
    return jobs.where(~expired(as_of))


def orphan_dirs(dirs: DataFrame, jobs: DataFrame) -> DataFrame:
    return dirs.join(jobs.select(F.col("id").alias("name")), "name", "left_anti")


def cleared(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs that stay, one row with the number that go)."""
    return jobs.where(~F.col("status").isin(TERMINAL)), jobs.agg(F.count_if(F.col("status").isin(TERMINAL)).alias("n_cleared"))


def too_long(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """(doc_id, n_pages) of documents over the page limit."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") > most)


def result_summary(results: DataFrame, usage: DataFrame) -> DataFrame:
    """One row a job: articles in the order of their paths, calls, tokens and cost."""
    name = F.element_at(F.split("output_path", "/"), -1)
    article = F.struct("output_path", "title", "n_paragraphs", "n_failed", "mode", name.alias("filename"))
    listed = results.groupBy("job_id").agg(F.sort_array(F.collect_list(article)).alias("articles"), F.sum("n_failed").cast("long").alias("n_failed"))
    spent = usage.groupBy("job_id").agg(F.count(F.lit(1)).alias("llm_calls"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"))
    return listed.join(spent, "job_id", "left").withColumn("cost_usd", cost(F.col("tokens_in"), F.col("tokens_out")))


def run_summary(results: DataFrame, added: DataFrame) -> DataFrame:
    """Lines for a person: articles by path, then terms that only the model vouches for."""
    a = results.select(F.lit(0).alias("part"), F.col("output_path").alias("key"), F.concat("title", F.lit(": "), F.col("n_paragraphs").cast("string"), F.lit(" paragraphs, "), F.col("n_failed").cast("string"), F.lit(" failed")).alias("line"))
    b = added.where(F.col("source") == "llm_fallback").select(F.lit(1).alias("part"), F.col("en").alias("key"), F.concat(F.lit("review: "), "en", F.lit(" => "), "zh").alias("line"))
    return a.unionByName(b)


def stage() -> Column:
    """A snapshot's stage in words."""
    n, k = F.col("n_articles"), F.col("n_results")
    s = lambda c: c.cast("string")
    return (
        F.when((n > 0) & k.isNotNull() & (k >= n), F.concat(F.lit("finished "), s(k), F.lit(" article(s)")))
        .when((n > 0) & k.isNotNull(), F.concat(F.lit("translating: "), s(k), F.lit("/"), s(n), F.lit(" article(s) done")))
        .when(n > 0, F.concat(F.lit("segmented "), s(n), F.lit(" article(s), translating")))
        .when(F.col("has_paragraphs"), "cleaning layout & transcribing formulas")
        .when(F.col("has_lines"), "parsing PDF layout")
        .otherwise("starting")
    )


def stage_changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots at which a job's stage changes; a job starts at "starting"."""
    rows = snapshots.withColumn("stage", stage())
    before = F.coalesce(F.lag("stage").over(Window.partitionBy("job_id").orderBy("seq")), F.lit("starting"))
    return rows.withColumn("before", before).where("stage <> before").select("job_id", "seq", "stage")
