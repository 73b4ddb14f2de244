"""The relational layer (K1-K8, K11, J2, J8, W1, W2, W5, W6, W10, W11, A9, A12, D4, T-12, F14, F15): snapshots in, snapshots out.

Times are parameters, never the clock, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import trim

TERMINAL = ("complete", "partial", "failed")
STUCK_MINUTES, STALE_DAYS, TTL_HOURS = 15, 5, 24


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """K1, K2, K7: new values win where they are given; ``keep`` columns (ids) stay as they were."""
    n = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in new.columns if c != key))
    both = old.join(n, F.col(key) == F.col("_key"), "full")

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_key").alias(c)
        if c not in new.columns:
            return F.col(c)
        return (F.coalesce(c, f"_{c}") if c in keep else F.coalesce(f"_{c}", c)).alias(c)

    return both.select(*(value(c) for c in old.columns))


def create_jobs(pages: DataFrame, jobs: DataFrame, new: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """K1: (pages, jobs) after jobs (id, url, source) are created: a page is monitored and keeps its id, or gets one from its
    URL; a job is pending. URLs that are refused raise an error."""
    u = urls.parsed(F.col("url"))
    why = urls.rejection(u)
    checked = new.withColumn("url", F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("Unsafe URL: "), why))).otherwise(F.col("url")).cast("string"))
    fresh = checked.select("url").distinct().select("url", page_id(F.col("url")).alias("id"), F.lit(True).alias("monitored"))
    after = upsert(pages, fresh, "url", keep=("id",))
    added = checked.select(F.col("id"), F.col("url").alias("page_url"), F.lit("pending").alias("status"), "source", as_of.alias("created_at"), as_of.alias("updated_at"))
    return after, jobs.unionByName(added, allowMissingColumns=True)


def page_id(url: Column) -> Column:
    """A page's id in the form of a UUID, made from its URL, so that reruns agree."""
    h = F.sha2(url, 256)
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))


def update_jobs(pages: DataFrame, jobs: DataFrame, updates: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """K2: (pages, jobs) after updates (id, status, genre, site_name, error, result, crawled_pages), null for what is not given.
    A result that isn't blank goes to the job's page, with the name and genre given or else the job's; a page without a new
    list of crawled pages keeps its own. One update a job."""
    fields = ("status", "genre", "site_name", "error")
    named = updates.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in (*fields, "result", "crawled_pages")))
    both = jobs.join(named, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    after = both.select(*(
        F.coalesce(f"_{c}", c).alias(c) if c in fields else F.when(hit, as_of).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in jobs.columns
    ))
    good = both.where(hit & (F.length(trim(F.col("_result"))) > 0))
    fresh = good.select(
        F.col("page_url").alias("url"), page_id(F.col("page_url")).alias("id"), F.col("_result").alias("result"), F.coalesce("_site_name", "site_name").alias("site_name"), F.coalesce("_genre", "genre").alias("genre"),
        F.col("_crawled_pages").alias("crawled_pages"), as_of.alias("last_checked_at"), as_of.alias("updated_at"), F.col("id").alias("_job"),
    )
    last = Window.partitionBy("url").orderBy(F.desc("_job"))
    fresh = fresh.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_job")
    return upsert(pages, fresh, "url", keep=("id",)), after


def delete(df: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """K8."""
    return df.join(gone.select(*key).distinct(), list(key), "left_anti")


def member(df: DataFrame, other: DataFrame, *key: str) -> DataFrame:
    """J8."""
    return df.join(other.select(*key).distinct(), list(key), "left_semi")


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; the planner prunes to one row a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def newest_status(jobs: DataFrame) -> DataFrame:
    """W2 by map-side combining: (page_url, status)."""
    return jobs.groupBy("page_url").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"))


def sweep_stuck(jobs: DataFrame, as_of: Column) -> DataFrame:
    """K4: unfinished jobs that were not touched for a while fail; ``swept`` marks them."""
    hit = ~F.col("status").isin(*TERMINAL) & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES"))
    out = jobs.withColumn("swept", F.coalesce(hit, F.lit(False)))
    return out.withColumn("status", F.when(F.col("swept"), "failed").otherwise(F.col("status")))


def stale(as_of: Column) -> Column:
    """Whether a monitored page was not asked for in a while."""
    return F.coalesce(F.col("monitored") & (F.col("last_requested_at") < as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS")), F.lit(False))


def sweep_stale(pages: DataFrame, as_of: Column) -> DataFrame:
    """K5."""
    return pages.withColumn("monitored", F.col("monitored") & ~stale(as_of))


def touch(pages: DataFrame, requested: DataFrame, as_of: Column) -> DataFrame:
    """K6."""
    r = requested.select(F.col("url").alias("_u")).distinct()
    out = pages.join(r, F.col("url") == F.col("_u"), "left")
    hit = F.col("_u").isNotNull()
    out = out.withColumn("monitored", F.col("monitored") | hit)
    return out.withColumn("last_requested_at", F.when(hit, as_of).otherwise(F.col("last_requested_at"))).drop("_u")


def active_job(jobs: DataFrame, as_of: Column) -> DataFrame:
    """T-12: the newest unfinished job of each page that is not stuck."""
    live = ~F.col("status").isin(*TERMINAL) & (F.col("updated_at") >= as_of - F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES"))
    return latest(jobs.where(live), "page_url", "created_at", "id")


def page_of(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A clamped page of rows and ``has_more``."""
    offset, limit = max(0, offset), min(max(1, limit), 50)
    got = rows.orderBy(*order).offset(offset).limit(limit + 1)
    w = Window.orderBy(*order)
    got = got.withColumn("_rn", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return got.where(F.col("_rn") <= limit).drop("_rn")


def history(requests: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with their pages and newest statuses."""
    p = pages.withColumnRenamed("url", "_u")
    s = newest_status(jobs).withColumnRenamed("page_url", "_j")
    return requests.join(p, F.col("page_url") == F.col("_u"), "left").join(s, F.col("page_url") == F.col("_j"), "left").drop("_u", "_j")


def export_names(rows: DataFrame, name: str, *order: str, per: str | None = None) -> DataFrame:
    """Adds ``file``: the name, then the first of name-2, name-3, .. that no row before has taken, in order; for each
    value of ``per``.

    A name can only meet names with the same stem less its numbers, so these are folded together, and only those of them
    where a name repeats: the others keep theirs, wherever they stand.
    """
    stem, ext = F.regexp_extract(F.col(name), r"^(.*?)(\.txt)?\z", 1), F.regexp_extract(F.col(name), r"^(.*?)(\.txt)?\z", 2)
    part = [per] if per else []
    family = F.struct(F.regexp_replace(stem, r"(-\d+)+\z", "").alias("s"), ext.alias("e"))
    out = rows.withColumns({"_family": family, "_k": F.row_number().over(Window.partitionBy(*part, name).orderBy(*order))})
    clash = out.withColumn("_most", F.max("_k").over(Window.partitionBy(*part, "_family")))
    plain = clash.where("_most = 1").withColumn("file", F.col(name))
    small = clash.where("_most > 1").drop("_k", "_most").withColumn("file", F.col(name))
    # Dealt by family and sorted by Spark; the fold holds the names of one family.
    one = small.repartition(*part, "_family").sortWithinPartitions(*part, "_family", *order)
    named = one.mapInArrow(_distinct_names(name, [*part, "_family"]), one.schema)
    return plain.select(*rows.columns, "file").unionByName(named.select(*rows.columns, "file"))


def _distinct_names(name: str, family: list[str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used, at = None, set(), {}
        for frame in frames:
            out = []
            for *key, n in zip(*(frame.column(c).to_pylist() for c in (*family, name)), strict=True):
                if key != here:
                    here, used, at = key, set(), {}
                got = n
                if n in used:
                    stem, ext = (n[:-4], ".txt") if n.endswith(".txt") else (n, "")
                    k = at.get(n, 2)
                    while f"{stem}-{k}{ext}" in used:
                        k += 1
                    at[n], got = k + 1, f"{stem}-{k}{ext}"
                used.add(got)
                out.append(got)
            columns = [pa.array(out, pa.string()) if f.name == "file" else c for f, c in zip(frame.schema, frame.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, frame.schema.names)

    return run


def terminal_status(crawled: Column, failed: Column, entries: Column) -> Column:
    """F14."""
    tried = crawled + failed
    return F.when((crawled == 0) | (entries == 0), "failed").when((tried >= 5) & (2 * crawled < tried), "partial").otherwise("complete")


def is_stale(at: Column, as_of: Column) -> Column:
    """D4."""
    return F.coalesce(at <= as_of - F.expr(f"INTERVAL {TTL_HOURS} HOURS"), F.lit(True))


def monitor_batch(pages: DataFrame, batch: int = 200, gap_ms: int = 400) -> DataFrame:
    """The pages checked longest ago with each one's wait behind others of its host."""
    due = pages.where("monitored").orderBy(F.col("last_checked_at").asc_nulls_first(), "url").limit(batch)
    w = Window.partitionBy("host").orderBy(F.col("last_checked_at").asc_nulls_first(), "url")
    return due.withColumn("wait_ms", ((F.row_number().over(w) - 1) * gap_ms).cast("long"))


def stagger(order: Column, step: int = 5, most: int = 300) -> Column:
    """Seconds before the n-th recrawl (n from 1)."""
    return F.least((order - 1) * step, F.lit(most))
