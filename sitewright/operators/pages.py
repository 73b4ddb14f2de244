"""Scoring, sections, selection, labels, assembly and validation of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls

# Fixed values.
PRIMARY, INCLUDED = 40, 15
SECTION_PRIORITY = {
    "about": 100, "company": 100, "products": 90, "services": 90, "pricing": 85, "plans": 85, "docs": 80, "documentation": 80, "api": 78,
    "reference": 75, "guides": 70, "tutorials": 70, "examples": 70, "support": 60, "help": 60, "faq": 60, "resources": 50, "blog": 40,
    "news": 40, "changelog": 40,
}
_SECTIONS = (
    (r"/docs?/", "Docs"), (r"/api/", "API"), (r"/guide/", "Guides"), (r"/examples?/", "Examples"), (r"/blog/|/post/|/article/", "Blog"),
    (r"/about/", "About"), (r"/support/|/help/", "Support"), (r"/products?/", "Products"),
)
_CHROME = r"(?i)cookie|privacy|consent|preference center|sign\s*in|log\s*in|menu"


def without_tagline(pages: DataFrame) -> DataFrame:
    """pages other than the home page (``home_pos``) lose a description that is the home page's."""
    same = F.coalesce((F.col("pos") != F.col("home_pos")) & (T.trim(F.col("home_description")) != "") & (T.trim(F.col("description")) == T.trim(F.col("home_description"))), F.lit(False))
    return pages.withColumns({"description_provenance": F.when(same, "none").otherwise(F.col("description_provenance")), "description": F.when(~same, F.col("description"))})


def score(pages: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """O1: adds score and is_optional to (site, url, u, genre, primary_lang, ..); enrichment is (url, importance, description,
    description_provenance, section, display_label)."""
    df = pages
    if enrichment is not None:
        e = enrichment.select(F.col("url").alias("_url"), *(F.col(c).alias(f"_{c}") for c in ("importance", "description", "description_provenance", "section", "display_label")))
        df = df.join(e, F.col("url") == F.col("_url"), "left")
        new = F.col("_description").isNotNull() & ~F.col("_description").eqNullSafe(F.col("description"))
        df = df.withColumn("description_provenance", F.when(new, F.col("_description_provenance")).otherwise(F.col("description_provenance")))
        df = df.withColumn("description", F.coalesce("_description", "description")).withColumn("llm_section", F.col("_section")).withColumn("display_label", F.col("_display_label"))
        weight = F.coalesce(T.round_half_up((F.col("_importance") - 5.5) * 5), F.lit(0))
    else:
        df = df.withColumn("llm_section", F.lit(None).cast("string")).withColumn("display_label", F.lit(None).cast("string"))
        weight = F.lit(0)
    plus = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    url = F.col("url")
    md = F.col("md_url").isNotNull() if "md_url" in df.columns else F.lit(False)
    total = (
        plus((F.length("description") > 0) & (F.col("description_provenance") != "none"), 25) + plus(md, 20)
        + plus(F.col("description_provenance") == "json_ld", 10) + plus(F.size("headings") > 0, 10) + plus(F.length("body_excerpt") > 200, 10)
        + plus(url.rlike(r"[?&]page=\d+|/page/\d+"), -15) + plus(url.rlike("/(print|export)/"), -20) + plus(url.rlike("/(tag|category|archive|author)/"), -25)
        + plus(url.rlike("/(sponsored?|affiliate|giveaways?|sweepstakes|partner-?content)/"), -35)
        + plus(url.rlike("/(deals?|coupons?|promo(tions?|s)?)/") & ~F.col("genre").isin("ecommerce_store", "marketplace"), -35)
        + plus(urls.off_language(F.col("u"), F.col("lang"), F.col("primary_lang")), -20) + weight
    )
    df = df.withColumn("score", total.cast("double")).withColumn("is_optional", (F.col("score") >= INCLUDED) & (F.col("score") < PRIMARY))
    return df.drop(*(c for c in df.columns if c in ("_url", "_importance", "_description", "_description_provenance", "_section", "_display_label")))


def inferred_section(u: Column) -> Column:
    path = F.lower(u["path"])
    return F.coalesce(*(F.when(path.rlike(p), name) for p, name in _SECTIONS), F.lit("Resources"))


def with_sections(scored: DataFrame) -> DataFrame:
    """O2, O3."""
    own = F.when((F.col("llm_section") != "") & (F.col("llm_section") != "Optional"), F.col("llm_section"))
    return scored.withColumn("section", F.when(F.col("score") >= PRIMARY, F.coalesce(own, inferred_section(F.col("u")))).when(F.col("score") >= INCLUDED, "Optional"))


def select(pages: DataFrame, most_primary: int = 50, most_optional: int = 10) -> DataFrame:
    """Adds ``kind`` (primary or optional) and ``rank`` to the selected pages; ``base`` is the site's parsed base URL."""
    df = pages.withColumn("_key", F.coalesce(urls.comparison_key(F.col("u")), F.col("url")))
    best = Window.partitionBy("site", "_key").orderBy(F.desc("score"), "pos")
    df = df.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    home = (F.col("_key") == urls.comparison_key(F.col("base"))) | ((F.col("u.host") == F.col("base.host")) & (F.col("u.path") == "/"))
    home = F.coalesce(home, F.lit(False))
    kind = F.when(~home & (F.col("score") >= PRIMARY) & (F.col("section") != "Optional"), "primary").when(~home & F.col("is_optional"), "optional")
    df = df.withColumn("_home", home).withColumn("kind", kind)
    some = F.count("kind").over(Window.partitionBy("site"))
    rescue = Window.partitionBy("site", "_home").orderBy(F.desc("score"), "pos")
    df = df.withColumn("_some", some).withColumn("_r", F.row_number().over(rescue))
    df = df.withColumn("kind", F.when((F.col("_some") == 0) & F.col("_home") & (F.col("score") >= INCLUDED) & (F.col("_r") == 1), "optional").otherwise(F.col("kind")))
    w = Window.partitionBy("site", "kind").orderBy(F.desc("score"), "pos")
    df = df.where(F.col("kind").isNotNull()).withColumn("rank", F.row_number().over(w))
    return df.where(F.col("rank") <= F.when(F.col("kind") == "primary", most_primary).otherwise(most_optional)).drop("_key", "_rn", "_home", "_some", "_r")


def section_priority(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SECTION_PRIORITY.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit(50))


def grouped(selected: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Adds ``final_section`` and ``section_rank``; small sections dissolve where fewer than two have two pages.
    ``order``: (site, section, forced), an explicit order that comes first."""
    df = selected.withColumn("_s", F.when(F.col("kind") == "primary", F.coalesce(F.nullif("section", F.lit("")), F.lit("Resources"))))
    df = df.withColumn("_s", F.when(F.lower(T.trim(F.col("_s"))) != "optional", F.col("_s")))
    stats = df.where(F.col("_s").isNotNull()).groupBy("site", "_s").agg(F.count("*").alias("n"), F.avg("score").alias("avg"), F.min("rank").alias("first"))
    site = Window.partitionBy("site")
    stats = stats.withColumn("multi", F.sum((F.col("n") >= 2).cast("int")).over(site)).where((F.col("multi") >= 2) | (F.col("n") >= 2))
    stats = stats.withColumn("effective", F.col("avg") + (section_priority(F.col("_s")) - 50) * 0.3)
    if order is None:
        stats = stats.withColumn("forced", F.lit(None).cast("int"))
    else:
        stats = stats.join(order.select("site", F.col("section").alias("_s"), "forced"), ["site", "_s"], "left")
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.col("forced").asc_nulls_last(), F.desc("effective"), "first"))
    stats = stats.select("site", "_s", rank.alias("section_rank"))
    out = df.join(stats, ["site", "_s"], "left")
    return out.withColumn("final_section", F.when(F.col("section_rank").isNotNull(), F.col("_s")).otherwise("Optional")).drop("_s")


def ordered(pages: DataFrame) -> DataFrame:
    """Adds ``entry_rank``: sections in order, pages by score within, Optional last with overflow first on ties."""
    w = Window.partitionBy("site").orderBy(F.col("section_rank").asc_nulls_last(), F.when(F.col("section_rank").isNull(), -F.col("score")), F.when(F.col("kind") == "primary", 0).otherwise(1), "rank")
    return pages.withColumn("entry_rank", F.row_number().over(w))


def labels(pages: DataFrame) -> DataFrame:
    """Adds ``label``. Titles that repeat the site's name or each other give way to headings or the
    path; labels still alike get the first path segment in which they differ."""
    base = T.trim(F.coalesce(F.nullif("display_label", F.lit("")), F.col("title"), F.lit("")))
    site_norm = F.lower(T.trim(F.col("site_name")))
    df = pages.withColumn("_t", base)
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy("site", F.lower("_t"))))
    heading = F.try_element_at(F.filter(F.transform("headings", T.trim), lambda h: (h != "") & (F.length(h) <= 80) & (F.lower(h) != site_norm) & ~h.rlike(_CHROME)), F.lit(1))
    generic = (F.lower("_t") == site_norm) | (F.col("_n") >= 3)
    df = df.withColumn("label", F.when(F.col("_t") != "", F.when(generic, F.coalesce(heading, F.nullif(urls.last_label(F.col("u")), F.lit("")))).otherwise(F.col("_t"))))
    df = df.withColumn("_segs", urls.segments(F.col("u")))
    alike = Window.partitionBy("site", "label")
    df = df.withColumn("_same", F.count("*").over(alike))
    clash = df.where(F.col("label").isNotNull() & (F.col("_same") > 1))
    longest = clash.withColumn("_max", F.max(F.size("_segs")).over(alike)).where("_max > 0")
    each = longest.select("site", "label", F.explode(F.sequence(F.lit(1), F.col("_max"))).alias("i"), "_segs")
    differ = each.groupBy("site", "label", "i").agg(F.countDistinct(F.coalesce(F.try_element_at("_segs", F.col("i")), F.lit(""))).alias("kinds"))
    differ = differ.where("kinds > 1").groupBy(F.col("site").alias("_ds"), F.col("label").alias("_dl")).agg(F.min("i").alias("_i"))
    df = df.join(differ, (F.col("site") == F.col("_ds")) & (F.col("label") == F.col("_dl")), "left")
    prefix = T.to_label(F.try_element_at("_segs", F.col("_i")))
    df = df.withColumn("label", F.when(prefix != "", F.concat_ws(" ", prefix, "label")).otherwise(F.col("label")))
    return df.drop("_t", "_n", "_segs", "_same", "_ds", "_dl", "_i")


def entry(url: Column, label: Column, description: Column) -> Column:
    """O9."""
    flat = lambda c: T.trim(F.regexp_replace(c, r"\r?\n", " "))
    name = F.regexp_replace(flat(F.coalesce(label, url)), r"[\[\]]", "")
    tail = F.when(F.length(flat(description)) > 0, F.concat(F.lit(": "), flat(description))).otherwise("")
    return F.concat(F.lit("- ["), name, F.lit("]("), urls.display(url), F.lit(")"), tail)


def assemble(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, n_primary, n_optional, file) of labelled, ordered pages; sites is (site, site_name, summary, notice) and may
    have a preamble. A site's entries are at most those that ``select`` keeps."""
    has = lambda c, other: F.coalesce(c, other) if c in pages.columns else F.col(other)
    shown = F.when(F.col("description_provenance") != "none", F.col("description")) if "description_provenance" in pages.columns else F.col("description")
    e = pages.withColumn("line", entry(has("md_url", "url"), F.coalesce(has("label_override", "label"), has("title", "label")), shown))
    body = e.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("entry_rank", "final_section", "line"))).alias("es"),
        F.sum((F.col("final_section") != "Optional").cast("long")).alias("n_primary"), F.sum((F.col("final_section") == "Optional").cast("long")).alias("n_optional"),
    )
    lines = F.transform("es", lambda x, k: F.concat(
        F.when((k == 0) | (F.get("es", k - 1)["final_section"] != x["final_section"]), F.concat(F.when(k == 0, "").otherwise("\n"), F.lit("## "), x["final_section"], F.lit("\n\n"))).otherwise(""), x["line"]))
    out = sites.join(body, "site", "left")
    quote = F.when(F.length(T.trim(F.col("summary"))) > 0, F.concat(F.lit("> "), T.trim(F.regexp_replace("summary", r"\r?\n", " ")), F.lit("\n\n"))).otherwise("")
    warn = F.when(F.col("notice").isNotNull(), F.concat(F.lit("> ⚠️ "), F.col("notice"), F.lit("\n\n"))).otherwise("")
    said = T.trim(F.regexp_replace("preamble", r"\r?\n", " ")) if "preamble" in sites.columns else F.lit("")
    intro = F.when(F.length(said) > 0, F.concat(said, F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit("# "), F.coalesce(F.nullif("site_name", F.lit("")), F.lit("Untitled")), F.lit("\n\n"), quote, intro, warn, F.coalesce(F.array_join(lines, "\n"), F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("site", zero("n_primary"), zero("n_optional"), F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n")).alias("file"))


def validate(files: DataFrame) -> DataFrame:
    """(site, rule, line, detail), a row for each fault of (site, file); rules in their order, lines from 1, 0 for none."""
    lines = files.select("site", F.posexplode(F.split("file", "\n", -1)).alias("at", "l"))
    site = Window.partitionBy("site").orderBy("at")
    upto = site.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h2 = F.col("l").rlike("^## ")
    ls = lines.withColumn("h2", h2).withColumn("sec", F.sum(h2.cast("int")).over(upto)).withColumn("link", F.regexp_extract("l", r"^- \[[^\]]+\]\(([^)]+)\)", 1))
    per = ls.groupBy("site").agg(
        F.min(F.when(T.trim(F.col("l")) != "", F.struct("at", "l"))).alias("first"), F.sum(F.col("l").rlike("^# ").cast("int")).alias("h1s"),
        F.min(F.when(F.col("h2"), F.col("at"))).alias("first_h2"), F.max(F.when(F.col("h2"), F.col("at"))).alias("last_h2"),
        F.min(F.when(F.col("l").startswith("> "), F.col("at"))).alias("quote"),
        F.sum((T.trim(F.col("l")) == "## Optional").cast("int")).alias("optionals"), F.max(F.when(T.trim(F.col("l")) == "## Optional", F.col("at"))).alias("optional"),
    )
    row = lambda df, test, rule, line=F.lit(0), detail=F.lit(""): df.where(F.coalesce(test, F.lit(False))).select("site", F.lit(rule).alias("rule"), line.cast("int").alias("line"), detail.alias("detail"))  # noqa: E731, B008
    n = F.col("at") + 1
    in_preamble = ls.join(per.select("site", F.col("first.at").alias("f"), "first_h2"), "site")
    secs = ls.where("sec > 0").groupBy("site", "sec").agg(F.max(F.col("l").startswith("- ")).alias("some"), F.max(F.when(F.col("h2"), T.trim(F.substr("l", F.lit(4))))).alias("name"), (F.max("at") + 2).alias("next"), F.max("at").alias("end"))
    last = F.col("sec") == F.max("sec").over(Window.partitionBy("site"))
    secs = secs.withColumn("line", F.when(last, 0).otherwise(F.col("next")))
    items = ls.where((F.col("sec") > 0) & ~F.col("h2") & F.col("l").startswith("- "))
    dup = F.row_number().over(Window.partitionBy("site", "link").orderBy("at")) > 1
    links = items.where(F.col("l").startswith("- [") & (F.col("link") != ""))
    faults = [
        row(per, ~F.coalesce(F.col("first.l").startswith("# "), F.lit(False)), "V1", F.coalesce(F.col("first.at") + 1, F.lit(0))),
        row(per, F.col("h1s") > 1, "V2"),
        row(ls, F.col("l").rlike("^#{3,} "), "V3", n, T.trim(F.col("l"))),
        row(per, F.col("quote") > F.col("first_h2"), "V4", F.col("quote") + 1),
        row(in_preamble, F.col("l").rlike("^#{1,6} ") & (F.col("at") > F.coalesce("f", F.lit(-1))) & (F.col("at") < F.coalesce("first_h2", F.lit(2147483647))), "V5", n),
        row(per, F.col("optionals") > 1, "V6"),
        row(per, (F.col("optionals") == 1) & ~F.col("optional").eqNullSafe(F.col("last_h2")), "V7", F.col("optional") + 1),
        row(secs, ~F.col("some"), "V8", F.col("line"), F.col("name")),
        row(items, ~F.col("l").startswith("- ["), "V9", n, T.trim(F.col("l"))),
        row(items, F.col("l").startswith("- [") & (F.col("link") == ""), "V10", n, T.trim(F.col("l"))),
        row(links, ~F.col("link").rlike(r"(?i)^https?://[^/\s]+"), "V11", n, F.col("link")),
        row(links.withColumn("dup", dup), F.col("dup"), "V12", n, F.col("link")),
    ]
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out
