"""Change detection (A8, T-5) by signatures of sitemaps and home pages, and the sweep that applies it (T-6, K3, A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_html
from . import store


def sitemap_hash(rows: DataFrame, most: int = 500) -> DataFrame:
    """(site, sitemap_hash) of (site, pos, url): the first ``most`` in document order, sorted, repeats kept."""
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("_rn") <= most)
    return first.groupBy("site").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("url")), "\n"), 256).alias("sitemap_hash"))


def home_hash(html: Column) -> Column:
    return F.sha2(normalize_html(html), 256)


def signature(sitemap: Column, home: Column) -> Column:
    both = F.concat(F.coalesce(sitemap, F.lit("")), F.lit("|"), F.coalesce(home, F.lit("")))
    return F.when(sitemap.isNotNull() | home.isNotNull(), F.sha2(both, 256))


def changed(stored: Column, now: Column) -> Column:
    """The first check only seeds; no signature is no change."""
    return F.coalesce(stored != now, F.lit(False))


def recorded(pages: DataFrame, checks: DataFrame, as_of: Column) -> DataFrame:
    """K3: pages after checks (url, now): the time of each, and its signature where there is one. A check of a page that
    isn't there raises an error."""
    c = checks.select(F.col("url").alias("_c"), F.col("now").alias("_now"))
    out = pages.join(c, F.col("url") == F.col("_c"), "full")
    url = F.when(F.col("url").isNull(), F.raise_error(F.concat(F.lit("no row matched for "), F.col("_c")))).otherwise(F.col("url")).cast("string")
    hit = F.col("_c").isNotNull()
    values = {"url": url, "last_checked_at": F.when(hit, as_of).otherwise(F.col("last_checked_at")), "content_signature": F.coalesce("_now", "content_signature")}
    return out.select(*((values[k] if k in values else F.col(k)).alias(k) for k in pages.columns))


def tick(pages: DataFrame, jobs: DataFrame, now: DataFrame, as_of: Column, batch: int = 200) -> dict[str, DataFrame]:
    """T-6: one sweep: ``jobs`` without stuck ones, ``pages`` after the sweep of stale ones and the checks, ``checks`` (url, host,
    wait_ms, changed, error, attached, delay_s) of the pages checked longest ago, and ``summary`` (A10).

    ``pages`` is (url, host, monitored, last_requested_at, last_checked_at, content_signature, ..), ``now`` (url, now, error):
    what the sites look like. A changed page whose job still runs is attached to it, the others are crawled again, each a
    little later than the one before.
    """
    swept_jobs = store.sweep_stuck(jobs, as_of)
    swept = store.sweep_stale(pages, as_of)
    due = store.monitor_batch(swept, batch)
    n = now.select(F.col("url").alias("_n"), F.col("now"), F.col("error"))
    due = due.join(n, F.col("url") == F.col("_n"), "left").drop("_n")
    fine = F.col("error").isNull()
    due = due.withColumn("changed", fine & changed(F.col("content_signature"), F.col("now")))
    live = store.active_job(swept_jobs.drop("swept"), as_of).select(F.col("page_url").alias("_j"), F.col("id").alias("attached"))
    due = due.join(live, (F.col("url") == F.col("_j")) & F.col("changed"), "left").drop("_j")
    order = Window.partitionBy("changed").orderBy(F.col("last_checked_at").asc_nulls_first(), "url")
    due = due.withColumn("delay_s", F.when(F.col("changed"), store.stagger(F.row_number().over(order))))
    checks = due.select("url", "host", "wait_ms", "now", "changed", "error", "attached", F.when(F.col("attached").isNull(), F.col("delay_s")).cast("long").alias("delay_s"))
    good = checks.where("error is null")
    # One row a kind of event, counted together: each input is read once and combined before it meets the others.
    url, none, one = F.col("url"), F.lit(None).cast("string"), lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    no = lambda *names: [F.lit(False).alias(n) for n in names]
    events = checks.select(one(F.col("error").isNull(), "checked"), one(F.col("changed"), "changed"), one(F.col("error").isNotNull(), "failed"), *no("stuck", "stale"), F.when(F.col("changed"), url).alias("recrawl"))
    events = events.unionByName(swept_jobs.where("swept").select(*no("checked", "changed", "failed"), F.lit(True).alias("stuck"), F.lit(False).alias("stale"), none.alias("recrawl")))
    events = events.unionByName(pages.where(store.stale(as_of)).select(*no("checked", "changed", "failed", "stuck"), F.lit(True).alias("stale"), none.alias("recrawl")))
    counts = [F.count_if(k).alias(name) for k, name in (("checked", "checked"), ("changed", "changed"), ("failed", "errors"), ("stuck", "stuck_failed"), ("stale", "swept"))]
    return {
        "jobs": swept_jobs.drop("swept"), "pages": recorded(swept, good.select("url", "now"), as_of), "checks": checks,
        "summary": events.agg(*counts, F.array_sort(F.collect_list("recrawl")).alias("recrawls")),
    }
