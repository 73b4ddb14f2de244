"""Discovery of a site's pages from tables of responses.

Nothing is fetched here: ``fetches`` is (url, status, content_type, content_length, body, failure, location), one row a URL;
``failure`` is null where a response came, ``body`` is binary. Sets of URLs are (site, pos, url, u); ``pos`` is their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..plans.staging import materialize
from ..sources import html, robots
from .url_sets import first_wins

# Fixed values.
MOST_BYTES, MOST_REDIRECTS = 5 << 20, 5
MOST_PAGES, MOST_DEPTH = 25, 2
RANK_SKIP_BELOW, MOST_EXTERNALS = 10, 8


def bounded_text(body: Column, most: int = MOST_BYTES) -> Column:
    """A body as text, null if it has more bytes; what isn't UTF-8 becomes replacement characters."""
    return F.when(F.octet_length(body) <= most, F.make_valid_utf8(body.cast("string")))


def gated(fetches: DataFrame) -> DataFrame:
    """(url, ok, status, html, error): what of a response is taken as a page, and else why not."""
    kind = F.coalesce("content_type", F.lit(""))
    text = bounded_text(F.col("body"))
    error = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("0"))))
        .when(~(kind.contains("text/html") | kind.contains("application/xhtml")), "Not HTML")
        .when(F.col("content_length") > MOST_BYTES, "Response too large")
        .when(F.col("_text").isNull(), "Response too large")
        .when(T.is_bot_challenge(F.col("_text")), "Bot challenge page")
    )
    out = fetches.withColumn("_text", text).withColumn("error", error)
    return out.select("url", F.col("error").isNull().alias("ok"), "status", F.when(F.col("error").isNull(), F.col("_text")).alias("html"), "error")


def site_rules(sites: DataFrame, fetches: DataFrame) -> DataFrame:
    """(site, rules) of (site, origin): the rules of its robots.txt, empty ones where there is none to be read."""
    got = fetches.where(F.col("failure").isNull() & F.col("status").between(200, 299)).select(F.col("url").alias("_u"), bounded_text(F.col("body")).alias("_text"))
    at = sites.join(got, F.concat("origin", F.lit("/robots.txt")) == F.col("_u"), "left")
    return at.select("site", robots.parsed(F.col("_text")).alias("rules"))


def redirected(starts: DataFrame, fetches: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """(url, final, hops, error) of (url): redirects followed one join a hop. A redirect to itself or to nothing that can
    be parsed ends a chain; an address that may not be asked, or one hop too many, is an error."""
    # Each redirect is parsed once: where it leads, and why that may not be asked. They are as many as the chains, so each hop
    # is dealt by its URL: a table that is small on disk would be held by every task of all hops at once.
    hops = fetches.where(F.col("status").between(300, 399) & F.col("location").isNotNull()).select(F.col("url").alias("_from"), urls.parsed(F.col("location"), F.col("url")).alias("_u"))
    hops = hops.select("_from", urls.written(F.col("_u")).alias("_to"), urls.rejection(F.col("_u")).alias("_refused"))
    hops = materialize(hops.where(F.col("_to").isNotNull() & (F.col("_to") != F.col("_from"))), "redirects")
    at = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("error"))
    for _ in range(most + 1):
        to = at.join(hops.hint("merge"), (F.col("final") == F.col("_from")) & ~F.col("done"), "left")
        moves = F.col("_to").isNotNull() & F.col("_refused").isNull()
        at = to.select(
            "url", F.when(moves, F.col("_to")).otherwise(F.col("final")).alias("final"), (F.col("hops") + moves.cast("int")).alias("hops"), (F.col("done") | ~moves).alias("done"), F.coalesce("error", "_refused").alias("error"),
        )
    over = F.concat(F.lit(f"Too many redirects (>{most}): "), F.col("url"))
    return at.select("url", F.when(F.col("done"), F.col("final")).alias("final"), "hops", F.when(~F.col("done"), over).otherwise(F.col("error")).alias("error"))


def markdown_urls(pages: DataFrame, fetches: DataFrame, asked_by: Sequence[str] = ()) -> DataFrame:
    """Adds md_url to (.., u): the page's Markdown sibling, if there is a response that is Markdown. Pages may share a
    sibling: each keeps one row, and has what was answered to itself if responses name the page by the columns ``asked_by``."""
    kind = F.coalesce("content_type", F.lit(""))
    marked = bounded_text(F.substr("body", F.lit(1), F.lit(4096))).rlike(r"(?m)^#{1,6} |\[.+\]\(.+\)")
    plain = kind.contains("text/plain") & F.coalesce(marked, F.lit(False))
    good = F.col("failure").isNull() & F.col("status").between(200, 299) & (kind.contains("text/markdown") | kind.contains("text/x-markdown") | plain)
    have = fetches.where(good).select(F.col("url").alias("_md"), *(F.col(c).alias(f"_by_{c}") for c in asked_by)).distinct()
    same = urls.markdown_sibling(F.col("u")) == F.col("_md")
    for c in asked_by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return pages.join(have, same, "left").withColumnRenamed("_md", "md_url").drop(*(f"_by_{c}" for c in asked_by))


def homepages(plain: DataFrame, rendered: DataFrame) -> DataFrame:
    """(site, url, html, mode, error) of (site, url, ok, html, error) and rendered (url, html): the plain page, or the
    rendered one where there is none or it is but a shell. Error is set where neither is there."""
    r = rendered.select(F.col("url").alias("_u"), F.col("html").alias("_rendered"))
    shell = T.is_spa_shell(F.col("html"), html.raw(F.col("html"))["excerpt"])
    both = plain.withColumn("_needs", ~F.col("ok") | F.coalesce(shell, F.lit(True))).join(r, F.col("url") == F.col("_u"), "left")
    page = F.when(F.col("_needs"), F.coalesce("_rendered", "html")).otherwise(F.col("html"))
    why = F.when(page.isNull(), F.concat(F.lit("Failed to fetch homepage: "), F.coalesce("error", F.lit("browser render failed"))))
    return both.select("site", "url", page.alias("html"), F.when(F.col("_needs"), "browser").otherwise("http").alias("mode"), why.alias("error"))


# ---- links -----------------------------------------------------------------------------------------------------


def links(pages: DataFrame) -> DataFrame:
    """(site, page_pos, at, url, u, text, own): the links of (site, pos, base, html), each taken at the site's base URL."""
    a = pages.select("site", F.col("pos").alias("page_pos"), "base", F.posexplode(html.raw(F.col("html"))["anchors"]).alias("at", "a"))
    a = a.where(~F.col("a.href").rlike("^(mailto:|tel:)"))
    a = a.withColumns({"u": urls.normalized(F.col("a.href"), F.col("base")), "_b": urls.parsed(F.col("base"))}).where(F.col("u.normal").isNotNull())
    return a.select("site", "page_pos", "at", F.col("a.href").alias("href"), F.col("u.normal").alias("url"), "u", F.col("a.text").alias("text"), urls.same_domain(F.col("u"), F.col("_b")).alias("own"))


def internal(found: DataFrame) -> DataFrame:
    """Each page's links to structural pages of its site, in order, the first of each."""
    own = found.where(F.col("own") & ~urls.skipped(F.col("u")))
    w = Window.partitionBy("site", "page_pos", "url").orderBy("at")
    return own.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def external(found: DataFrame) -> DataFrame:
    """(site, pos, url, anchor): links to other sites, the first anchor of each."""
    other = found.where(~F.col("own") & ~F.col("href").startswith("#"))
    return first_wins(other.select("site", F.col("at").alias("pos"), "url", F.col("text").alias("anchor")), "site", "url")


def merged(queue: DataFrame, more: DataFrame, rules: DataFrame) -> DataFrame:
    """what ``more`` adds to a queue, behind it: (site, pos, url, u) that the rules allow and the queue has not."""
    ends = queue.groupBy(F.col("site").alias("_s")).agg(F.max("pos").alias("_end"))
    r = rules.select(F.col("site").alias("_r"), F.col("rules.disallowed").alias("_deny"))
    new = more.join(r, F.col("site") == F.col("_r"), "left").where(robots.allowed(F.col("u"), F.coalesce("_deny", F.array().cast("array<string>"))))
    new = new.join(ends, F.col("site") == F.col("_s"), "left").withColumn("pos", F.col("pos") + F.coalesce(F.col("_end") + 1, F.lit(0)))
    return first_wins(queue.select("site", "pos", "url", "u").unionByName(new.select("site", "pos", "url", "u")), "site", "url")


def picked(queue: DataFrame, picks: DataFrame, skip_below: int = RANK_SKIP_BELOW, most: int | None = None, without: bool = True) -> DataFrame:
    """a queue in the order of picks (site, indices), 1-based. Short queues pass unranked; indices out of range and
    repeats count for nothing. Sites whose picks are null pass if ``without``, and have nothing else."""
    order = Window.partitionBy("site").orderBy("pos")
    q = queue.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy("site")))
    ix = picks.select(F.col("site").alias("_s"), F.posexplode("indices").alias("_at", "_i"), F.lit(True).alias("_ranked"))
    ix = ix.groupBy("_s", "_i").agg(F.min("_at").alias("_at"))
    ranked = picks.where(F.col("indices").isNotNull()).select(F.col("site").alias("_site")).distinct()
    q = q.join(ix, (F.col("site") == F.col("_s")) & (F.col("_n") == F.col("_i")), "left").join(ranked, F.col("site") == F.col("_site"), "left")
    short = F.col("_all") <= skip_below
    kept = short | F.col("_at").isNotNull() | (F.col("_site").isNull() & F.lit(without))
    w = Window.partitionBy("site").orderBy(F.when(short, None).otherwise(F.col("_at")).asc_nulls_last(), "_n")
    out = q.where(kept).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    if most is not None:
        out = out.where(short | (F.col("pos") < most))
    return out.select(*queue.columns)


# ---- the crawl -------------------------------------------------------------------------------------------------


def _budgeted(queue: DataFrame, pages: DataFrame, used: DataFrame, budget: int) -> DataFrame:
    """What of a queue is asked, in order, before the budget of good pages is spent; ``used`` is (site, n)."""
    got = pages.select(F.col("url").alias("_p"), "ok", "html", "error")
    rows = queue.join(got, F.col("url") == F.col("_p"), "left").join(used.select(F.col("site").alias("_s"), "n"), F.col("site") == F.col("_s"), "left")
    rows = rows.withColumn("ok", F.coalesce("ok", F.lit(False)))
    before = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("site").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce("n", F.lit(0)) + F.coalesce(before, F.lit(0)))
    return rows.where(F.col("_before") < budget).drop("_p", "_s", "n", "_before")


def frontier(queue: DataFrame, seen: DataFrame, pages: DataFrame, rules: DataFrame, bases: DataFrame, budget: int = MOST_PAGES) -> DataFrame:
    """F8: (site, pos, url, u, depth, ok, html, error) of the pages that a crawl asks behind the home page.

    The queue (site, pos, url, u) has depth 1; links of its good pages that are not in ``seen`` (site, url) have depth 2 and stand
    behind it in the order of their pages. The budget counts good pages, the home page among them. Two rounds, two joins
    with ``pages`` (url, ok, html, error); order is the queue's, where the crawler's own depends on timing.
    """
    one = bases.select("site", F.lit(1).alias("n"))
    first = materialize(_budgeted(queue.select("site", "pos", "url", "u"), pages, one, budget).withColumn("depth", F.lit(1)), "frontier")
    good = first.where("ok").join(bases.select(F.col("site").alias("_s"), "base"), F.col("site") == F.col("_s")).drop("_s")
    found = internal(links(good))
    order = F.row_number().over(Window.partitionBy("site").orderBy("page_pos", "at"))
    ends = queue.groupBy(F.col("site").alias("_e")).agg(F.max("pos").alias("_end"))
    new = found.join(seen.select("site", "url").unionByName(queue.select("site", "url")).distinct(), ["site", "url"], "left_anti")
    deny = rules.select(F.col("site").alias("_r"), F.col("rules.disallowed").alias("_deny"))
    new = new.join(deny, F.col("site") == F.col("_r"), "left").where(robots.allowed(F.col("u"), F.coalesce("_deny", F.array().cast("array<string>"))))
    new = first_wins(new.withColumn("pos", order.cast("long")), "site", "url").join(ends, F.col("site") == F.col("_e"), "left")
    new = new.select("site", (F.col("pos") + F.coalesce("_end", F.lit(0))).alias("pos"), "url", "u")
    used = first.groupBy("site").agg((F.count_if("ok") + 1).alias("n"))
    used = bases.select("site").join(used, "site", "left").select("site", F.coalesce("n", F.lit(1)).alias("n"))
    second = _budgeted(new, pages, used, budget).withColumn("depth", F.lit(2))
    return first.unionByName(second)


def progress(asked: DataFrame, discovered: DataFrame) -> DataFrame:
    """(site, discovered, crawled, failed): counters of a crawl; the home page is the first crawled."""
    n = asked.groupBy("site").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    d = discovered.groupBy("site").agg(F.countDistinct("url").alias("discovered"))
    return d.join(n, "site", "left").select("site", "discovered", (F.coalesce("ok", F.lit(0)) + 1).alias("crawled"), F.coalesce("failed", F.lit(0)).alias("failed"))


def external_pages(refs: DataFrame, good: DataFrame, described: DataFrame, budget: int = MOST_PAGES) -> DataFrame:
    """The references (site, pos, url, anchor) that fill what a site's good pages (site, n) leave of the budget,
    in their order, with what is known of them: ``described`` is (url, title, description, description_provenance, headings,
    body_excerpt, lang); one that could not be read keeps its anchor, or its host, as title."""
    w = Window.partitionBy("site").orderBy("pos")
    rows = refs.withColumn("_rn", F.row_number().over(w)).join(good.select(F.col("site").alias("_s"), "n"), F.col("site") == F.col("_s"), "left")
    rows = rows.where(F.col("_rn") <= F.greatest(F.lit(0), budget - F.coalesce("n", F.lit(0)))).drop("_rn", "_s", "n")
    d = described.withColumnRenamed("url", "_d")
    rows = rows.join(d, F.col("url") == F.col("_d"), "left").withColumn("u", urls.parsed(F.col("url")))
    title = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("title"), F.col("anchor"))), F.regexp_replace("u.host", r"^www\.", ""), F.col("url"))
    none = F.array().cast("array<string>")
    return rows.withColumns({"title": title, "headings": F.coalesce("headings", none), "description_provenance": F.coalesce("description_provenance", F.lit("none"))}).drop("_d")


def slots(asked: DataFrame, delay_ms: Column, *order: str) -> DataFrame:
    """Adds ``slot_ms``: when each request of a site may start, one crawl delay apart; null where no delay is asked."""
    w = Window.partitionBy("site").orderBy(*order)
    return asked.withColumn("slot_ms", ((F.row_number().over(w) - 1) * delay_ms).cast("long"))
