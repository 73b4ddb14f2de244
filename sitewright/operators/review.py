"""The final review of a draft (O11, O13, F13, J6, W8, A14): six edit lists, read from an answer and applied by joins.

``entries`` are selected pages (site, url, md_url or none, kind, rank, section, ..); answers are (site, answer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from .enrich import json_block

EDITS = (
    "struct<drop_urls:array<string>,moves:array<struct<url:string,section:string>>,section_order:array<string>,"
    "relabel:array<struct<url:string,label:string>>,redescribe:array<struct<url:string,description:string>>,"
    "entry_order:array<struct<section:string,urls:array<string>>>>"
)
LABEL_CHARS = 80
LEAST_LEFT, MOST_DROPPED = 5, 0.2


def aliases(entries: DataFrame) -> DataFrame:
    """(site, alias, url): the forms in which a draft shows an entry's URL. A form of several is the last one's."""
    link = F.coalesce("md_url", "url") if "md_url" in entries.columns else F.col("url")
    bare = F.regexp_replace(link, r"^(https?://[^/?#]+)/\z", "$1")
    order = F.when(F.col("kind") == "primary", 0).otherwise(1)
    each = entries.select("site", "url", order.alias("o"), "rank", F.posexplode(F.array(F.col("url"), bare, urls.display(link))).alias("k", "alias"))
    return each.groupBy("site", "alias").agg(F.max_by("url", F.struct("o", "rank", "k")).alias("url"))


def sections(entries: DataFrame) -> DataFrame:
    """(site, section): the distinct sections of the primary entries."""
    return entries.where(F.col("kind") == "primary").select("site", F.coalesce("section", F.lit("Resources")).alias("section")).distinct()


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(site, at, said) rows with the entry that ``said`` means."""
    return rows.join(names.withColumnRenamed("alias", "said"), ["site", "said"]).drop("said")


def _last(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("site", "url").agg(F.max_by(value, "at").alias(value))


def edits(answers: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """The edit lists: drop (site, url), move (site, url, new_section), label (site, url, new_label), describe (site, url,
    new_description), sections (site, section, forced) and order (site, section, url, override). What names no entry, cannot
    be sanitised or orders an unknown section has no effect; of two edits of an entry the last one counts. An answer
    without an object has no edits; one whose object isn't JSON raises an error (T17)."""
    block = json_block(F.col("answer"), "object")
    broken = block.isNotNull() & F.try_parse_json(block).isNull()
    e = answers.select("site", F.when(broken, F.raise_error(F.lit("a review is not JSON"))).otherwise(F.from_json(block, EDITS)).cast(EDITS).alias("e"))
    names = aliases(entries)
    items = lambda field: e.select("site", F.posexplode(f"e.{field}").alias("at", "i")).where(F.col("i").isNotNull())
    drop = _named(items("drop_urls").select("site", "at", F.col("i").alias("said")), names).select("site", "url").distinct()
    move = items("moves").select("site", "at", F.col("i.url").alias("said"), T.sanitize_section(F.col("i.section")).alias("new_section")).where("new_section is not null")
    move = _last(_named(move, names), "new_section")
    label = items("relabel").select("site", "at", F.col("i.url").alias("said"), T.trim(F.col("i.label")).alias("new_label"))
    label = _last(_named(label.where(F.length("new_label").between(1, LABEL_CHARS)), names), "new_label")
    describe = items("redescribe").select("site", "at", F.col("i.url").alias("said"), T.sanitize_description(F.col("i.description")).alias("new_description"))
    describe = _last(_named(describe.where("new_description is not null"), names), "new_description")
    known = sections(entries).unionByName(move.select("site", F.col("new_section").alias("section"))).distinct()
    forced = items("section_order").select("site", "at", F.col("i").alias("section")).groupBy("site", "section").agg(F.min("at").alias("forced")).join(known, ["site", "section"], "left_semi")
    lists = items("entry_order").select("site", "at", T.trim(F.col("i.section")).alias("section"), F.col("i.urls").alias("urls")).where("urls is not null")
    allowed = known.unionByName(e.select("site", F.lit("Optional").alias("section"))).distinct()
    each = lists.join(allowed, ["site", "section"], "left_semi").select("site", "section", F.col("at").alias("list"), F.posexplode("urls").alias("at", "said"))
    each = _named(each, names).groupBy("site", "section", "list", "url").agg(F.min("at").alias("override"))
    last = each.groupBy("site", "section").agg(F.max("list").alias("list"))
    order = each.join(last, ["site", "section", "list"]).drop("list")
    return {"drop": drop, "move": move, "label": label, "describe": describe, "sections": forced, "order": order}


def safe_drops(drop: DataFrame, entries: DataFrame) -> DataFrame:
    """the drops of sites where at most a fifth of the entries, or one, goes and five are left."""
    total = entries.groupBy("site").agg(F.count("*").alias("total"))
    n = drop.groupBy("site").agg(F.count("*").alias("n"))
    fine = n.join(total, "site").where((F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("total") * MOST_DROPPED))) & (F.col("total") - F.col("n") >= LEAST_LEFT))
    return drop.join(fine.select("site"), "site", "left_semi")


def applied(entries: DataFrame, e: dict[str, DataFrame]) -> DataFrame:
    """The entries that stay, moved and described anew, with ``label_override``."""
    out = entries.join(safe_drops(e["drop"], entries), ["site", "url"], "left_anti")
    for key in ("move", "describe", "label"):
        out = out.join(e[key], ["site", "url"], "left")
    return out.withColumns({
        "section": F.coalesce("new_section", "section"), "description_provenance": F.when(F.col("new_description").isNotNull(), "llm").otherwise(F.col("description_provenance")),
        "description": F.coalesce("new_description", "description"), "label_override": F.col("new_label"),
    }).drop("new_section", "new_description", "new_label")


def reordered(pages: DataFrame, order: DataFrame) -> DataFrame:
    """``entry_rank`` anew: within its final section, entries of the list (site, section, url, override) come first,
    in its order, the others as they were."""
    o = order.select("site", F.col("section").alias("final_section"), "url", "override")
    w = Window.partitionBy("site").orderBy(F.col("section_rank").asc_nulls_last(), F.col("override").asc_nulls_last(), "entry_rank")
    return pages.join(o, ["site", "final_section", "url"], "left").withColumn("entry_rank", F.row_number().over(w)).drop("override")
