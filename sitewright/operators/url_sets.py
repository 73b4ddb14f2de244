"""Ordered URL sets of many sites (F1, F3-F6). Rows are (site, pos, url, u): ``u`` is the parsed struct, ``pos`` the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def _segs() -> Column:
    return F.filter(F.split("u.path", "/"), lambda s: s != "")


def first_wins(df: DataFrame, *key: str) -> DataFrame:
    """The first row by pos of each key."""
    w = Window.partitionBy(*key).orderBy("pos")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def seeds(df: DataFrame, base: Column) -> DataFrame:
    """distinct structural pages of the site itself."""
    return first_wins(df.where(urls.same_domain(F.col("u"), base) & ~urls.skipped(F.col("u"))), "site", "url")


def drop_fanout(df: DataFrame, threshold: int = 20) -> DataFrame:
    """drops whole templated groups: first segments under which many URLs have many different second segments."""
    deep = df.where(F.size(_segs()) >= 2).select("site", F.element_at(_segs(), 1).alias("seg"), F.element_at(_segs(), 2).alias("sub"))
    # Counts are combined before the shuffle, distinct ones on two columns, so a huge group is no single task's work.
    wide = deep.groupBy("site", "seg", "sub").agg(F.count("*").alias("n")).groupBy("site", "seg").agg(F.sum("n").alias("n"), F.count("*").alias("subs"))
    wide = wide.where((F.col("n") >= threshold) & (F.col("subs") >= max(8, threshold // 2))).select(F.col("site").alias("_site"), "seg")
    hit = (F.col("site") == F.col("_site")) & (F.size(_segs()) >= 2) & (F.try_element_at(_segs(), F.lit(1)) == F.col("seg"))
    return df.join(wide, hit, "left_anti")


def cap_prefix(df: DataFrame, k: int = 5, depth: int = 2) -> DataFrame:
    """at most k URLs, the shallowest first, under each path prefix; unparsable ones stay."""
    bucket = F.when(F.size(_segs()) == 0, "root").otherwise(F.array_join(F.slice(_segs(), 1, depth), "/"))
    w = Window.partitionBy("site", "_bucket").orderBy(urls.depth(F.col("u")), "pos")
    ranked = first_wins(df, "site", "url").withColumn("_bucket", F.coalesce(bucket, F.concat(F.lit("?"), F.col("url")))).withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") <= k).drop("_rn", "_bucket")


def cap_total(df: DataFrame, n: int = 200) -> DataFrame:
    """the n shallowest URLs of a site."""
    w = Window.partitionBy("site").orderBy(urls.depth(F.col("u")), "pos")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def locale_prefilter(df: DataFrame, primary: Column) -> DataFrame:
    """URLs of the primary language or of none, unless that would leave nothing of a site."""
    keep = F.coalesce(urls.locale(F.col("u")) == primary, F.lit(True))
    flagged = df.withColumn("_keep", keep)
    some = flagged.where("_keep").select(F.col("site").alias("_site")).distinct()
    out = flagged.join(some, F.col("site") == F.col("_site"), "left")
    return out.where(F.col("_keep") | F.col("_site").isNull()).drop("_keep", "_site")
