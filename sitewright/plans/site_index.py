"""Site indexes of many sites in one job: extract, score, select, label, review, assemble, validate (§3.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions.genre import counts, genre
from ..operators import pages as P
from ..operators import review
from ..operators.url_sets import first_wins
from ..sources import html, robots
from .staging import materialize

NOTICE = (  # a fixed value
    "Note: This site's robots.txt disallows all crawling (Disallow: /). Only the homepage could be indexed; "
    "the full site structure may not be represented here."
)


def fetched(pages: DataFrame) -> DataFrame:
    """(site, pos, url, u, html) of (page_id, url, html): normal URLs, the first page of each, site is the host."""
    df = pages.select(F.col("page_id").alias("pos"), urls.normalized(F.col("url")).alias("u"), "html").where(F.col("u.normal").isNotNull())
    return first_wins(df.select(F.col("u.host").alias("site"), "pos", F.col("u.normal").alias("url"), "u", "html"), "site", "url")


def described(rows: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Extracted pages of staged rows (site, pos, url, u, html, ..) with genre, primary_lang and site_name of their site.

    A site's language and name are its first page's; its genre is told from that page and all discovered URLs (site, pos,
    url), of which only counts are gathered.
    """
    homes = F.min_by("html", "pos").alias("home")
    if discovered is None:
        told = rows.groupBy("site").agg(homes, F.struct(*counts()).alias("n"))
    else:
        n = discovered.groupBy(F.col("site").alias("_n")).agg(F.struct(*counts()).alias("n"))
        told = rows.groupBy("site").agg(homes).join(n, F.col("site") == F.col("_n"))
    # By itself: within the plan below, the rules' long expression would be computed many times slower.
    genres = materialize(told.select(F.col("site").alias("_site"), genre(F.col("home"), F.col("n"), F.col("site")).alias("genre")), "genres")
    d = materialize(html.described(rows).drop("x"), "described")
    first = d.groupBy("site").agg(F.min_by(F.struct("lang", "site_name", "description"), "pos").alias("h"), F.min("pos").alias("home_pos"))
    first = first.select(F.col("site").alias("_s"), F.coalesce(urls.base_language(F.col("h.lang")), F.lit("en")).alias("primary_lang"), F.col("h.site_name").alias("_name"), F.col("h.description").alias("home_description"), "home_pos")
    sites = materialize(first.join(genres, F.col("_s") == F.col("_site")).drop("_site"), "sites")
    d = d.join(sites, F.col("site") == F.col("_s")).withColumn("site_name", F.col("_name")).drop("_s", "_name")
    return P.without_tagline(d).drop("home_description", "home_pos")


def scored(pages: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    return P.score(described(materialize(fetched(pages), "fetched")), enrichment)


def build_index(pages: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """(site, n_primary, n_optional, file, n_faults) of a table (page_id, url, html)."""
    return index_of(materialize(fetched(pages), "fetched"), enrichment)


def index_of(
    rows: DataFrame, enrichment: DataFrame | None = None, discovered: DataFrame | None = None, rules: DataFrame | None = None,
    names: DataFrame | None = None, answers: DataFrame | None = None, bases: DataFrame | None = None,
) -> DataFrame:
    """The index of each site of staged rows (site, pos, url, u, html, and md_url if known).

    ``rules`` (site, rules) give the notice of sites that forbid all; ``names`` is (site, site_name, preamble), ``answers``
    (site, answer) a review of the draft, ``bases`` (site, base) the addresses that were submitted, else https and the host.
    """
    s = P.with_sections(P.score(described(rows, discovered), enrichment))
    if bases is None:
        s = s.withColumn("base", urls.parsed(F.concat(F.lit("https://"), F.col("site"), F.lit("/"))))
    else:
        s = s.join(bases.select(F.col("site").alias("_b"), urls.parsed(F.col("base")).alias("base")), F.col("site") == F.col("_b")).drop("_b")
    s = materialize(s, "scored")
    chosen, order, sections = P.select(s), None, None
    if answers is not None:
        chosen = materialize(chosen, "chosen")
        edits = review.edits(answers, chosen)
        chosen, order, sections = review.applied(chosen, edits), edits["order"], edits["sections"]
    ordered = P.ordered(P.grouped(chosen, sections))
    if order is not None:
        ordered = review.reordered(ordered, order)
    placed = materialize(P.labels(materialize(ordered, "ordered")), "placed")
    sites = placed.groupBy("site").agg(F.first("site_name").alias("site_name"))
    home = s.groupBy(F.col("site").alias("_h")).agg(F.min_by(F.struct("description", "description_provenance"), "pos").alias("h"))
    home = home.select("_h", T.home_summary(F.col("h.description"), F.col("h.description_provenance")).alias("summary"))
    sites = sites.join(home, F.col("site") == F.col("_h"), "left").drop("_h")
    if rules is None:
        sites = sites.withColumn("notice", F.lit(None).cast("string"))
    else:
        r = rules.select(F.col("site").alias("_r"), F.when(robots.fully_disallowed(F.col("rules.disallowed")), NOTICE).alias("notice"))
        sites = sites.join(r, F.col("site") == F.col("_r"), "left").drop("_r")
    if names is not None:
        n = names.select(F.col("site").alias("_n"), F.col("site_name").alias("_name"), "preamble")
        sites = sites.join(n, F.col("site") == F.col("_n"), "left").withColumn("site_name", F.coalesce("_name", "site_name")).drop("_n", "_name")
    files = materialize(P.assemble(placed, sites), "files")
    faults = P.validate(files).groupBy(F.col("site").alias("_f")).agg(F.count("*").alias("n"))
    return files.join(faults, F.col("site") == F.col("_f"), "left").withColumn("n_faults", F.coalesce("n", F.lit(0)).cast("long")).drop("_f", "n")
