"""What the service shows of its store (J1, J3, J4, K10, K13, D1-D6, D8, T-7-T-9): joins and columns, times as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from .store import TERMINAL, export_names, latest

STATUSES = ("pending", "crawling", "enriching", "scoring", "assembling", "complete", "partial")
MOST_EXPORTED = 500


def iso(at: Column) -> Column:
    """A time as the service writes it."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def page_views(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages with their newest job; pages without a job have no view."""
    j = latest(jobs, "page_url", "created_at", "id").select(*(F.col(c).alias(f"job_{c}") for c in jobs.columns))
    return pages.join(j, F.col("url") == F.col("job_page_url")).drop("job_page_url")


def job_views(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs with their pages."""
    p = pages.select(*(F.col(c).alias(f"page_{c}") for c in pages.columns if c != "url"), F.col("url").alias("_u"))
    return jobs.join(p, F.col("page_url") == F.col("_u")).drop("_u")


def job_answer(views: DataFrame) -> DataFrame:
    """(id, json, cache_control) of job views (id, page_id, page_url, status, error, created_at, updated_at)."""
    said = F.when(F.length("error") > 0, T.public_error(F.col("error")))
    body = F.struct(F.col("id"), F.col("page_id").alias("pageId"), F.col("page_url").alias("pageUrl"), "status", said.alias("error"), iso(F.col("created_at")).alias("createdAt"), iso(F.col("updated_at")).alias("updatedAt"))
    return views.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"), job_cache(F.col("status")).alias("cache_control"))


def page_cache(status: Column) -> Column:
    """D6, for pages: results are kept long, failures a minute, the rest not at all."""
    return F.when(status.isin("complete", "partial"), "public, s-maxage=86400, stale-while-revalidate=604800").when(status == "failed", "public, s-maxage=60").otherwise("no-store")


def job_cache(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), "public, s-maxage=60").otherwise("no-store")


def exported(requests: DataFrame, pages: DataFrame, most: int = MOST_EXPORTED) -> DataFrame:
    """(user_id, file, content): each user's newest results, under names that differ."""
    p = pages.where(F.col("result") != "").select(F.col("url").alias("_u"), "result")
    rows = requests.join(p, F.col("page_url") == F.col("_u")).drop("_u")
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "page_url")
    rows = rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most)
    rows = rows.withColumn("_name", urls.filename(urls.parsed(F.col("page_url"))))
    return export_names(rows, "_name", "_at", per="user_id").select("user_id", "file", F.col("result").alias("content"))


def running(status: Column) -> Column:
    """D1."""
    return F.coalesce(~status.isin(*TERMINAL), F.lit(False))


def refreshed(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows (page_url, site_name, genre, status, last_checked_at, ..) with what was read anew of (url, site_name, genre, status,
    updated_at); a job that has ended counts as a check."""
    f = fresh.select(F.col("url").alias("_u"), *(F.col(c).alias(f"_{c}") for c in ("site_name", "genre", "status", "updated_at")))
    out = rows.join(f, F.col("page_url") == F.col("_u"), "left")
    out = out.withColumns({"site_name": F.coalesce("_site_name", "site_name"), "genre": F.coalesce("_genre", "genre"), "last_checked_at": F.when(F.col("_status").isin(*TERMINAL), F.col("_updated_at")).otherwise(F.col("last_checked_at"))})
    return out.withColumn("status", F.coalesce("_status", "status")).drop("_u", "_site_name", "_genre", "_status", "_updated_at")


def monitor_label(status: Column, last_checked_at: Column, monitored: Column) -> Column:
    """D3."""
    return F.when(running(status), "Refreshing…").when(last_checked_at.isNotNull(), "Refreshed").when(monitored, "Awaiting refresh")


def route(page_id: Column, result: Column, active_job: Column) -> Column:
    """Where a page's address leads: its result, its job, or nowhere (null)."""
    return F.when(F.length(T.trim(result)) > 0, F.concat(F.lit("/p/"), page_id)).when(active_job.isNotNull(), F.concat(F.lit("/jobs/"), active_job))


def badge(n_faults: Column) -> Column:
    """D8."""
    return F.when(n_faults == 0, "Spec valid").otherwise(F.concat(n_faults.cast("string"), F.lit(" issue"), F.when(n_faults > 1, "s").otherwise("")))


def step_state(status: Column, step: Column) -> Column:
    """T-9: how a step of the progress view stands."""
    order = F.array(*map(F.lit, STATUSES))
    at, of = F.array_position(order, status), F.greatest(F.array_position(order, step), F.lit(1))
    return F.when(status == "failed", F.when(step == "crawling", "error").otherwise("waiting")).when(at > of, "done").when(at == of, "active").otherwise("waiting")


def next_visible(visible: Column, status: Column) -> Column:
    """T-8: the status to be shown next: one step further towards the real one; failures and the first step at once."""
    order = F.array(*(F.lit(s) for s in STATUSES if s != "partial"))
    goal = F.array_position(order, F.when(status == "partial", "complete").otherwise(status))
    here = F.array_position(order, visible)
    step = F.get(order, here.cast("int"))
    return (
        F.when(status == "failed", "failed").when((visible == "pending") & (status != "pending"), status)
        .when((goal == 0) | (here == 0) | (goal <= here), visible).otherwise(F.when((step == "complete") & (status == "partial"), "partial").otherwise(step))
    )


def faulty_moves(history: DataFrame) -> DataFrame:
    """T-7: (job_id, at, before, status) of changes (job_id, at, status) that the states of a job do not allow: states only move
    on, and end in complete, partial or failed."""
    order = F.array(*(F.lit(s) for s in STATUSES[:5]))
    w = Window.partitionBy("job_id").orderBy("at")
    h = history.withColumn("before", F.lag("status").over(w))
    here, there = F.array_position(order, F.col("before")), F.array_position(order, F.col("status"))
    known = (there > 0) | F.col("status").isin(*TERMINAL)
    fine = F.when(F.col("before").isNull(), F.col("status") == "pending").when(F.col("before").isin(*TERMINAL), False).otherwise(known & ((there == 0) | (there >= here)))
    return h.where(~F.coalesce(fine, F.lit(False))).select("job_id", "at", "before", "status")
