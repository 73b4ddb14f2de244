"""Helpers shared by the training-text operators."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, wherever Catalyst moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of other characters than WS, in order."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_WS}+")).cast("long")


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array of longs: sums within blocks, then the blocks' bases, so that
    growing arrays are copied block by block and not once per element of the whole."""
    zero = F.array().cast("array<bigint>")

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), zero.alias("out"))
        return F.aggregate(
            xs,
            start,
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocked(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(block)), lambda at: F.slice(xs, at, block))
        return let(
            parts,
            lambda ps: let(
                running(F.transform(ps, total)),
                lambda bases: F.flatten(F.zip_with(ps, bases, lambda p, b: F.transform(running(p), lambda x: x + b))),
            ),
        )

    return let(values, lambda xs: F.when(F.size(xs) == 0, zero).when(F.size(xs) <= block, running(xs)).otherwise(blocked(xs)))


# ---- tables between stages -------------------------------------------------------------------------------------

_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and one
    process is both; elsewhere there is no such folder to be made up."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sitewright-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be over
            return


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors,
    and lets Spark drop the shuffle files behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    free(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing still to be computed reads."""
    for df in tables:
        path = df._staged_path
        _delete(df.sparkSession, path)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are out of scope."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of rows, which both sides hold in full: a thousand instead of ten thousand, unless
    the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def rows_of(frame: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch, a few of them as Python values at a time."""
    for k in range(0, frame.num_rows, step):
        yield from zip(*(c.to_pylist() for c in frame.slice(k, step).columns), strict=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- graph and order ------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the least node.

    Alternates large-star and small-star steps; each is an aggregate with map-side combining and an equi-join,
    so a hub's edges are never gathered in one task. Nulls and self-loops are ignored; no edges give no rows.
    """
    kind = edges.schema[a].dataType
    u, v = F.col(a), F.col(b)
    now = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(
        F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")
    )
    now = stage(now.distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stage(large.distinct(), "edges")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = (
            small.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        after = stage(small, "edges")
        unstage(now, large)
        now = after
        # A fixed point is a set of stars: no centre is itself a leaf.
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if mark == seen or mark["n"] == 0:
            break
        chained = now.select("lo").join(now.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count()
        if not chained:
            break
        seen = mark
    centres = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(centres)
    return out.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def extended(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after more edges (a, b): those are joined whose components are, so that what is connected
    already is not gone through again."""
    name = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    named = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    over = stage(components(named), "components")
    moved = comps.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    known = over.join(comps.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(known.select("node", "component"))


#: Places that the rows of one key are dealt to where it is joined.
SALTS = 64


def salt(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")


def shared_keys(rows: DataFrame, key: str, row: str, *totals: Column) -> DataFrame:
    """(key, salt, totals): the places that rows with a key are dealt to by ``salt(row)``. A value of the key is joined with
    these and then with the rows by both, so that a key that many rows have is not one task's, and others aren't copied."""
    return rows.groupBy(key, salt(row).alias("salt")).agg(*totals)


def batches(rows: Iterable, size: Callable[[object], int], most: int) -> Iterator[list]:
    """Lists of rows of about ``most`` bytes; a longer row is alone."""
    out, held = [], 0
    for row in rows:
        n = size(row)
        if out and held + n > most:
            yield out
            out, held = [], 0
        out.append(row)
        held += n
    if out:
        yield out
