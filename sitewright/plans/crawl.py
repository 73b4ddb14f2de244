"""A crawl of many sites from tables of responses (§3.2, stages 2 to 8): rules, seeds, home pages, reduced queues, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import discovery as D
from ..operators import url_sets as S
from ..sources import html, robots
from .site_index import index_of
from .staging import materialize

FANOUT, PER_PREFIX, PREFIX_DEPTH, MOST_RANKED = 20, 5, 2, 200


def crawl(sites: DataFrame, fetches: DataFrame, sitemaps: DataFrame, rendered: DataFrame, picks: DataFrame | None = None, budget: int = D.MOST_PAGES) -> dict[str, DataFrame]:
    """``pages`` (site, pos, url, u, html, md_url), the home page first; ``rules``; ``discovered`` (site, pos, url); ``asked``, all
    that was asked, and ``failed`` (site, error) of sites without a home page.

    ``sites`` is (site, base), ``fetches`` as in ``discovery``, ``sitemaps`` (site, pos, url) what sitemaps list, ``rendered`` (url, html),
    ``picks`` (site, indices) the ranking of a model.
    """
    starts = materialize(sites.withColumn("_u", urls.parsed(F.col("base"))).select("site", F.col("_u.normal").alias("base"), urls.origin(F.col("_u")).alias("origin"), F.col("_u").alias("base_u")), "starts")
    gate = materialize(D.gated(fetches), "gated")
    rules = materialize(D.site_rules(starts, fetches), "rules")
    deny = rules.select(F.col("site").alias("_r"), F.col("rules.disallowed").alias("_deny"))
    listed = sitemaps.withColumn("u", urls.normalized(F.col("url"))).where(F.col("u.normal").isNotNull())
    listed = listed.select("site", "pos", F.col("u.normal").alias("url"), "u")
    listed = listed.join(starts.select("site", "base", "base_u"), "site").join(deny, F.col("site") == F.col("_r"), "left")
    fine = urls.same_domain(F.col("u"), F.col("base_u")) & ~urls.skipped(F.col("u")) & robots.allowed(F.col("u"), F.coalesce("_deny", F.array().cast("array<string>"))) & (F.col("url") != F.col("base"))
    seeds = materialize(S.first_wins(listed.where(fine), "site", "url").select("site", "pos", "url", "u"), "seeds")
    plain = starts.join(gate.withColumnRenamed("url", "_g"), F.col("base") == F.col("_g"), "left").select("site", F.col("base").alias("url"), F.coalesce("ok", F.lit(False)).alias("ok"), "html", "error")
    homes = materialize(D.homepages(plain, rendered), "homes")
    home = homes.where("html is not null").select("site", F.lit(0).cast("long").alias("pos"), "url", urls.parsed(F.col("url")).alias("u"), F.col("url").alias("base"), "html", "mode")
    nav = D.internal(D.links(home)).join(home.select(F.col("site").alias("_h"), F.col("url").alias("_home")), F.col("site") == F.col("_h"))
    nav = nav.where(F.col("url") != F.col("_home")).select("site", F.col("at").cast("long").alias("pos"), "url", "u")
    queue = materialize(D.merged(seeds, nav, rules).join(home.select("site"), "site", "left_semi"), "queue")
    lang = home.select(F.col("site").alias("_l"), F.coalesce(urls.base_language(html.raw(F.col("html"))["lang"]), F.lit("en")).alias("primary_lang"))
    short = S.cap_total(S.cap_prefix(S.drop_fanout(queue, FANOUT), PER_PREFIX, PREFIX_DEPTH), MOST_RANKED)
    short = S.locale_prefilter(short.join(lang, F.col("site") == F.col("_l")).drop("_l"), F.col("primary_lang")).select("site", "pos", "url", "u")
    if picks is not None:
        short = D.picked(short, picks)
    bases = home.select("site", F.col("url").alias("base"))
    seen = queue.select("site", "url").unionByName(home.select("site", "url"))
    asked = materialize(D.frontier(materialize(short, "queue"), seen, gate, rules, bases, budget), "asked")
    good = asked.where("ok").select("site", (F.col("pos") + 1).cast("long").alias("pos"), "url", "u", "html").unionByName(home.select("site", F.lit(-1).cast("long").alias("pos"), "url", "u", "html"))
    order = queue.select("site", (F.col("pos") + 1).alias("pos"), "url").unionByName(asked.where("depth = 2").select("site", (F.col("pos") + 1_000_000_000).alias("pos"), "url"))
    discovered = order.unionByName(home.select("site", F.lit(-1).cast("long").alias("pos"), "url"))
    return {
        "pages": materialize(D.markdown_urls(good, fetches), "crawled"), "rules": rules, "discovered": discovered, "asked": asked,
        "failed": homes.where("error is not null").select("site", "error"), "bases": bases,
    }


def crawled_index(sites: DataFrame, fetches: DataFrame, sitemaps: DataFrame, rendered: DataFrame, enrichment: DataFrame | None = None, picks: DataFrame | None = None, names: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """The indexes of sites from their responses: a crawl, and ``index_of`` what it found."""
    c = crawl(sites, fetches, sitemaps, rendered, picks)
    return index_of(c["pages"], enrichment, c["discovered"], c["rules"], names, answers, c["bases"])
