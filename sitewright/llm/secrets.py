"""Secret scans over a ledger of content-addressed blobs (native).

Every text version, of whatever path and time, is a blob named by its SHA-256. The ledger is a Parquet folder that is only
added to: a row (blob, rules, found) says which rules, by kind and version, were evaluated on a blob, and what they found.
``scan`` reads the ledger and evaluates only unseen pairs of blob and rule version, each blob once, however many paths
have it; ``update`` adds that to the ledger; ``join_back`` gives every path the findings that the ledger has for its blob,
so new paths of old blobs have theirs without a scan. Kinds are numbered by their place in RULES and never anew.

Defined results: a null text is the empty blob; empty texts have no findings; repeated rows are scanned each and give repeated rows; a null
``doc_id`` stays null; other columns are ignored; an empty table gives empty results. Offsets are code points, ends
are exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let, prefix_sums, shared_dir, stage, text_of


@dataclass(frozen=True)
class Rule:
    """``group`` of a match of ``pattern`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token')))}|{_either_case('api')}_?{_either_case('key')})"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run is matched whole from its start, so the least length can stand in the pattern for access and hex.
BASE_RULES = (
    Rule("assign", ASSIGN, group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:bigint,kind:int,end:bigint,version:int,sha256:string>"
LEDGER = f"blob string, rules array<string>, found array<{SPAN}>"
#: A list of so many blobs to scan goes to the texts; a longer one meets them in a shuffle.
BROADCAST_BLOBS = 200_000
#: Places in which the paths of one blob meet its findings.
COPIES = 16


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches: the pieces between matches and the matches alternate, so their lengths give offsets."""

    def of(matches: Column) -> Column:
        pieces = F.split(text, rule.pattern, -1)
        steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches

        def located(ends: Column) -> Column:
            return F.transform(
                F.arrays_zip(matches.alias("m"), held.alias("h"), ends.alias("e")),
                lambda x: F.struct(
                    (x["e"] - F.length(x["m"])).alias("start"), F.lit(order).alias("kind"), x["e"].alias("end"),
                    F.length(x["h"]).alias("held"), F.lit(rule.version).alias("version"), F.sha2(x["m"], 256).alias("sha256"),
                ),
            )

        ends = let(steps, lambda s: F.zip_with(prefix_sums(s), s, lambda a, b: a + b))
        kept = F.filter(let(ends, located), lambda x: x["held"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"], x["kind"], x["end"], x["version"], x["sha256"]))

    none = F.array().cast(f"array<{SPAN}>")
    found = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), of).cast(f"array<{SPAN}>")
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def paths(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): the path and the content address of its text."""
    return docs.select("doc_id", F.sha2(text_of(), 256).alias("blob"))


def _number(rule: Rule) -> int:
    return [r.kind for r in RULES].index(rule.kind)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rules, found): for every blob with an unseen pair, the rules evaluated now and their findings.

    Of each blob one document is read; which one is decided on ids and addresses. If few blobs are to be scanned, their list
    goes to the texts and no text is moved; else texts are dealt by id and address, so copies of one text go apart.
    """
    ids = [r.id for r in rules]
    all_rules = F.array(*map(F.lit, ids))
    todo = docs.select("doc_id", F.sha2(text_of(), 256).alias("blob")).groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if ledger is None:
        todo = todo.withColumn("todo", all_rules)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(ids)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0)
    todo = todo.select(F.xxhash64("blob", "first_id").alias("k"), F.col("blob").alias("todo_blob"), "first_id", "todo")
    if ledger is not None:
        todo = stage(todo, "unseen-blobs")
        if todo.count() <= BROADCAST_BLOBS:
            todo = F.broadcast(todo)
    named = docs.select("doc_id", text_of().alias("text")).withColumn("blob", F.sha2("text", 256)).withColumn("k", F.xxhash64("blob", "doc_id"))
    same = (F.col("blob") == F.col("todo_blob")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    text = F.col("text")
    none = F.array().cast(f"array<{SPAN}>")
    found = F.concat(*(F.when(F.array_contains("todo", r.id), spans(text, r, _number(r))).otherwise(none) for r in rules))
    return named.join(todo, "k").where(same).select("blob", F.col("todo").alias("rules"), F.array_sort(found).alias("found"))


def open_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger of a folder, or None before the first update."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else None


def update(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what a ledger has not seen, add it, and return the ledger."""
    spark = docs.sparkSession
    scan(docs, open_ledger(spark, folder), rules).write.mode("append").option("compression", "zstd").parquet(folder)
    return open_ledger(spark, folder)


def join_back(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): every path with the findings of its blob by these rules. Only blobs with findings are joined; paths
    of one blob are dealt to COPIES places."""
    wanted = lambda x: F.concat_ws("@", x["kind"].cast("string"), x["version"].cast("string")).isin([f"{_number(r)}@{r.version}" for r in rules])
    hits = ledger.select("blob", F.filter("found", wanted).alias("found")).where(F.size("found") > 0)
    hits = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    hits = hits.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    none = F.array().cast(f"array<{SPAN}>")
    at = paths(docs).withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int"))
    return at.join(hits, ["blob", "s"], "left").select("doc_id", F.coalesce("found", none).alias("found"))


def joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> DataFrame:
    """The findings of every document, from a ledger that is brought up to date first. A ``folder`` that is given is kept, and later
    calls with it scan unseen texts and rule versions only; else the ledger begins empty and ends with the driver."""
    found = F.col("found")
    base = F.filter(found, lambda x: x["kind"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    if folder is None:
        folder = f"{shared_dir(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}"
        common._STAGED.append((docs.sparkSession, folder))
    return join_back(docs, update(docs, folder, rules), rules).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base, rules), 256).alias("base_sha256"), joined(found, rules).alias("spans"),
    )
