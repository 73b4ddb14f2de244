"""A corpus pipeline: quality rules, line dedup, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; what a stage rejects, cuts or repeats is so in its output.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import lines, mixing, neardup, packing, quality
from sitewright.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v2 rejects. Null texts have no words and go; null ids and repeated rows that pass stay;
    an empty table stays empty."""
    return quality.keep(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that an earlier line of their group makes superfluous, by (doc_id, line), null ids first.
    Null and empty texts stay as they are; rows that repeat an id and a text lose the same lines; a document may be left
    with an empty text."""
    return lines.dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id. Shingles have five words, similarity is 0.8. Documents
    without an id or without words are in no group and stay; rows that repeat an id are one document and go or stay."""
    groups = neardup.near_duplicates(docs, width=5, percent=80)
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.select(*COLUMNS).join(dropped, F.col("doc_id") == F.col("dropped_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken. A null source is a source, the last; documents without words are taken
    as often as their source's epochs say; rows that repeat an id and a size are taken alike."""
    return mixing.mix(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row, and its place in a sequence. Null texts are an end id; null ids stay null."""
    return packing.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Token ids, least squares and connected components are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
