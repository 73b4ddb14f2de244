"""Robots rules and sitemaps (S2-S6, F16) from fetched text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

# Fixed values.
AGENT = "llmstxtgenerator"
PATHS = ("/sitemap.xml", "/sitemap_index.xml")
#: A number at the start, whatever follows.
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", re.I)


def rules(text: str | None, agent: str = AGENT) -> dict:
    """Rules for ``agent``: its own group's if it has one, else those of ``*``. The last user-agent line alone counts,
    an empty line ends a group; Allow and wildcards mean nothing."""
    deny: dict[str, list[str]] = {agent: [], "*": []}
    delay: dict[str, float | None] = {agent: None, "*": None}
    maps: dict[str, None] = {}
    current, named = "", False
    for line in map(str.strip, (text or "").split("\n")):
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not line:
            current = ""
        elif line[0] == "#" or not colon:
            continue
        elif key == "user-agent":
            current = value.lower()
            named |= current == agent
        elif key == "sitemap" and value:
            maps[value] = None
        elif key == "disallow" and value and current in deny:
            deny[current].append(value)
        elif key == "crawl-delay" and current in deny and not (current == "*" and named):
            number = _NUMBER.match(value)
            if number:
                delay[current] = float(number[0])
    who = agent if named else "*"
    return {"disallowed": deny[who], "sitemaps": list(maps), "crawl_delay": delay[who]}


def _parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([rules(x) for x in s], columns=["disallowed", "sitemaps", "crawl_delay"])


RULES = "disallowed array<string>, sitemaps array<string>, crawl_delay double"


def parsed(text: Column) -> Column:
    return F.pandas_udf(_parse, RULES)(text)


def allowed(u: Column, disallowed: Column) -> Column:
    hit = F.exists(disallowed, lambda r: (r == "/") | F.startswith(u["path"], r))
    return F.when(F.size(disallowed) == 0, True).otherwise(F.coalesce(~hit, F.lit(False)))


def fully_disallowed(disallowed: Column) -> Column:
    return F.array_contains(disallowed, "/")


def crawl_delay_ms(delay: Column) -> Column:
    return F.least(F.greatest(F.floor(delay * 1000 + 0.5), F.lit(0)), F.lit(10_000)).cast("int")


def sitemap_sources(origin: Column, sitemaps: Column) -> Column:
    return F.when(F.size(sitemaps) > 0, F.slice(sitemaps, 1, 3)).otherwise(F.array(*(F.concat(origin, F.lit(p)) for p in PATHS)))


def locations(xml: Column) -> Column:
    """The addresses of a sitemap or an index; lenient, so broken XML gives what can be read."""
    raw = F.regexp_extract_all(xml, F.lit(r"(?is)<loc[^>]*>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    return F.transform(raw, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def sitemap_urls(starts: DataFrame, fetches: DataFrame, most: int | None = 500, subs: int = 5) -> DataFrame:
    """(site, top, url, u, pos) from (site, url) and (url, body, content_type): normal addresses in document order.

    Indexes are followed twice, five entries each; 500 addresses a start, or all if ``most`` is None. Responses that are neither XML nor text, where that
    is known, and addresses that cannot be normalised count for nothing.
    """
    kind = F.col("content_type") if "content_type" in fetches.columns else F.lit("text/xml")
    good = F.col("body").isNotNull() & F.coalesce(kind.contains("xml") | kind.contains("text"), F.lit(False))
    body = fetches.where(good).select(F.col("url").alias("_u"), "body")
    at = starts.select("site", F.col("url").alias("top"), "url", F.lit("").alias("order"))
    found = None
    for _ in range(3):
        got = at.join(body, F.col("url") == F.col("_u")).withColumn("is_index", F.col("body").rlike("(?i)<sitemapindex"))
        locs = got.select("site", "top", "order", "is_index", F.posexplode(locations(F.col("body"))).alias("k", "loc"))
        locs = locs.withColumn("order", F.concat("order", F.format_string("%09d.", "k")))
        leaf = locs.where(~F.col("is_index")).select("site", "top", "loc", "order")
        found = leaf if found is None else found.unionByName(leaf)
        at = locs.where(F.col("is_index") & (F.col("k") < subs)).select("site", "top", F.col("loc").alias("url"), "order")
    found = found.withColumn("u", urls.normalized(F.col("loc"))).where(F.col("u.normal").isNotNull())
    w = Window.partitionBy("site", "top").orderBy("order")
    found = found.withColumn("pos", F.row_number().over(w))
    if most is not None:
        found = found.where(F.col("pos") <= most)
    return found.select("site", "top", F.col("u.normal").alias("url"), "u", "pos")
