"""What a language model said of pages and sites, from tables of its answers (X19-X22, J5): parsed, sanitised, matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ITEMS = "array<struct<section:string,importance:string,description:string,label:string>>"
ANALYSIS = "struct<site_name:string,preamble_confident:string,preamble:string>"


def json_block(answer: Column, kind: str) -> Column:
    """The widest block of an answer in square (``array``) or curly (``object``) brackets; null if there is none."""
    pattern = r"(?s)\[.*\]" if kind == "array" else r"(?s)\{.*\}"
    return F.nullif(F.regexp_extract(answer, pattern, 0), F.lit(""))


def parsed(answer: Column, kind: str, schema: str) -> tuple[Column, Column]:
    """The block as ``schema``, and whether there is one that isn't JSON, which fails a job."""
    block = json_block(answer, kind)
    value = F.from_json(block, schema)
    return value, block.isNotNull() & F.try_parse_json(block).isNull()


def rows(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """(site, url, section, importance, description, description_provenance, display_label).

    ``pages`` is (site, batch, at, url, title, description, description_provenance), ``at`` from 0 in a batch; ``answers``
    (site, batch, answer). Items belong to pages by their place; pages beyond a short answer have no row, nor do those of
    an answer without an array. One that has an array that isn't JSON raises an error.
    """
    items, broken = parsed(F.col("answer"), "array", ITEMS)
    sound = F.when(broken, F.raise_error(F.lit("the enrichment of a batch is not JSON"))).otherwise(items)
    a = answers.select(F.col("site").alias("_s"), F.col("batch").alias("_b"), F.posexplode(sound.cast(ITEMS)).alias("_at", "i"))
    both = pages.join(a, (F.col("site") == F.col("_s")) & (F.col("batch") == F.col("_b")) & (F.col("at") == F.col("_at"))).where(F.col("i").isNotNull())
    said = T.sanitize_description(F.col("i.description"))
    kept = F.when(said.isNull(), "none").when(~said.eqNullSafe(F.col("description")), "llm").otherwise(F.col("description_provenance"))
    return both.select(
        "site", "url", T.sanitize_section(F.col("i.section")).alias("section"), T.importance(F.col("i.importance").try_cast("double")).alias("importance"), said.alias("new_description"),
        kept.alias("new_provenance"), T.sanitize_label(F.col("i.label"), F.col("title")).alias("display_label"),
    ).withColumnsRenamed({"new_description": "description", "new_provenance": "description_provenance"})


def batches(pages: DataFrame, order: Column, size: int = 25) -> DataFrame:
    """Adds ``batch`` and ``at`` to pages, in order, ``size`` to a batch of a site."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("site").orderBy(order)) - 1
    return pages.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size).cast("int"), "at": (F.col("_n") % size).cast("int")}).drop("_n")


def site_names(sites: DataFrame) -> DataFrame:
    """(site, site_name, preamble) of (site, answer, deterministic_name): the model's name if it can be cleaned, and its
    preamble if it is sure of it and it has 20 characters."""
    value, _ = parsed(F.col("answer"), "object", ANALYSIS)
    s = sites.withColumn("_a", value)
    first = T.trim(F.element_at(F.split(T.trim(F.col("_a.site_name")), r"\r?\n"), 1))
    name = T.clean_site_name(F.regexp_replace(first, "^[\"'`]|[\"'`]\\z", ""))
    # The flag must be the truth value itself, not a string.
    sure = F.coalesce(F.get_json_object(F.to_json(F.try_parse_json(F.coalesce(_object(F.col("answer")), F.lit("{}")))), "$.preamble_confident") == "true", F.lit(False))
    sure = sure & _object(F.col("answer")).rlike(r'"preamble_confident"\s*:\s*true')
    preamble = T.trim(F.col("_a.preamble"))
    return s.select("site", F.coalesce(name, F.col("deterministic_name")).alias("site_name"), F.when(sure & (F.length(preamble) >= 20), preamble).alias("preamble"))


def _object(answer: Column) -> Column:
    return json_block(answer, "object")
