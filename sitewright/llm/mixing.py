"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential draw over its quality weight, drawn from its id. Within a source keys are sorted and
sizes summed up to the source's budget: complete epochs first, then the fraction by key. Where the next document is
larger than what is left, the ones behind it that fit are taken in their order. A source's cut is found by sums per
range of keys and then in the one range that the budget ends in, so no task sorts a whole source; the cuts are one row a
source, and documents are compared with them where they are.

Defined results: null texts have size 0; a null source is a source, the last; a null ``doc_id`` is kept and drawn as
null; sources without words get target 0 and nothing taken; rows that repeat an id and a size get the same number of
copies; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stage, text_of

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Ranges of keys within a source; the last step sorts one of them.
RANGES = 1 << 14
#: Rounds that go on behind a document that does not fit.
STEPS = 4
#: Plans of more sources (a few hundred bytes each) are not broadcast; the rows of a source are then dealt to PARTS.
BROADCAST_SOURCES, PARTS = 50_000, 64
SEED = 20


def quality_weight(text: Column) -> Column:
    """Share of characters that are letters, from 0.05 to 1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.length(text), F.lit(1)))


def _slot() -> Column:
    """Where a document stands in its source's order; a total order on (id, size)."""
    return F.struct("range", "key", "doc_id", "size")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """Adds size and the sampling order to (doc_id, source, text); keeps the named columns."""
    text = F.col("__text")
    out = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_of().alias("__text"), *(F.col(k) for k in keep if k not in ("doc_id", "source")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(u) / quality_weight(text)
    return out.select(
        "doc_id", "source", n_words(text).alias("size"), key.alias("key"), F.floor(F.lit(float(RANGES)) * (key / (1 + key))).cast("int").alias("range"),
        *(k for k in keep if k not in ("doc_id", "source")),
    )


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources stand in code-point order, null last, and take the weights in turn. Sorted by cap over weight, the sources
    at their cap come first; the others share what these leave by weight, which is what resharing comes to.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cyclic = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = totals.withColumn("w", cyclic).withColumn("cap", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(everything).cast("double"))
    t = t.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(onward))
    t = t.withColumn("capped", F.col("left") * F.col("w") >= F.col("cap") * F.col("rest"))
    share = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), share * F.col("w") / open_weight)))
    return t.select("source", "source_size", F.col("target").cast("double").alias("target"))


def _with(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with what is said of their source: (s, ...), one row a source. A table of few sources goes to the rows; with
    more, the rows of one source are dealt by range."""
    if few:
        return rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s")))
    dealt = sources.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    here = rows.withColumn("__at", F.pmod("range", F.lit(PARTS)))
    return here.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("__at") == F.col("__part"))).drop("__at", "__part")


def _taken(step: int) -> Column:
    """Whether the document goes into the fraction by this step or one before."""
    out, before = F.lit(False), None
    for k in range(step + 1):
        now = (_slot() <= F.col(f"cut{k}")) & (F.col("size") <= F.col(f"cap{k}"))
        if before is not None:
            now = now & (_slot() > F.col(f"cut{before}"))
        out, before = out | F.coalesce(now, F.lit(False)), k
    return out


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """A row for each source: source_size, target, epochs (copies of every document), the steps of the fraction that is
    taken once more, and the document that closes the budget.

    A step takes the documents in order up to the first that is larger than what is left; the next one goes on behind it
    with those that still fit. So the gap is soon below what the smallest document behind has.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(totals, weights, most).withColumnRenamed("source", "s")
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    t = stage(t.withColumn("gap", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    few = t.count() <= BROADCAST_SOURCES
    slot = "struct<range:int,key:double,doc_id:bigint,size:bigint>"
    for k in range(STEPS):
        fits = F.col("size") <= F.col("gap")
        if k:
            fits = fits & (_slot() > F.col(f"cut{k - 1}"))
        said = t.select("s", "gap", *([f"cut{k - 1}"] if k else []))
        able = _with(rows, said, few).where(fits)
        in_order = Window.partitionBy("source").orderBy("range")
        ranges = able.groupBy("source", "gap", "range").agg(F.sum("size").alias("held")).withColumn("upto", F.sum("held").over(in_order))
        past = (F.col("upto") > F.col("gap")) & (F.col("upto") - F.col("held") <= F.col("gap"))
        ends = ranges.groupBy(F.col("source").alias("s")).agg(
            F.max(F.when(past, F.struct(F.col("range").alias("r"), (F.col("upto") - F.col("held")).alias("used")))).alias("e"), F.max("upto").alias("all")
        )
        ends = stage(ends.select("s", F.col("e.r").alias("r"), F.coalesce("e.used", "all").alias("used")), "mix-ends")
        inside = _with(rows, t.join(ends.withColumnRenamed("s", "e_s"), F.col("s").eqNullSafe(F.col("e_s"))).drop("e_s").where("r is not null"), few)
        inside = inside.where(fits & (F.col("range") == F.col("r")))
        running = Window.partitionBy("source").orderBy("key", "doc_id", "size")  # equal rows are counted together
        inside = inside.withColumn("upto", F.col("used") + F.sum("size").over(running)).where(F.col("upto") <= F.col("gap"))
        last = inside.groupBy(F.col("source").alias("l_s")).agg(F.max(_slot()).alias("last"), F.max("upto").alias("upto"))
        ends = ends.withColumnRenamed("s", "e_s").join(last, F.col("e_s").eqNullSafe(F.col("l_s")), "left")
        t = t.join(ends, F.col("s").eqNullSafe(F.col("e_s")), "left")
        # Where nothing of the last range fits the step ends before it, and where all fits behind every range.
        nothing = F.struct(F.coalesce("r", F.lit(RANGES)).alias("range"), F.lit(-1.0).alias("key"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("size"))
        cut = F.when(F.col("e_s").isNull() & F.col("used").isNull(), F.lit(None)).otherwise(F.coalesce("last", nothing)).cast(slot)
        if k:
            cut = F.coalesce(cut, f"cut{k - 1}")
        t = t.withColumns({f"cut{k}": cut, f"cap{k}": F.col("gap"), "gap": F.col("gap") - F.coalesce("upto", "used", F.lit(0))})
        t = stage(t.drop("e_s", "l_s", "r", "used", "last", "upto"), "mix-plan")
    # What is left goes to the document whose size comes nearest to it.
    behind = _with(rows, t.where(F.col("gap") > 0), few).where(~_taken(STEPS - 1) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    nearest = behind.groupBy(F.col("source").alias("n_s")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "doc_id", "size")).alias("nearest"))
    return t.join(nearest, F.col("s").eqNullSafe(F.col("n_s")), "left").drop("n_s", "gap")


def apply(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to sized rows."""
    nearest = F.col("doc_id").eqNullSafe(F.col("nearest.doc_id")) & (F.col("size") == F.col("nearest.size"))
    extra = _taken(STEPS - 1) | F.coalesce(nearest & F.col("nearest").isNotNull(), F.lit(False))
    return _with(rows, plans, plans.count() <= BROADCAST_SOURCES).select(*rows.columns, "source_size", "target", (F.col("epochs") + extra.cast("int")).alias("copies"))


def mix(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text", "lang", "source", "n_chars")) -> DataFrame:
    """The mixed documents, a row for each copy, with the given columns."""
    plans = stage(plan(stage(sized(docs), "sizes")), "mix-plan")
    mixed = apply(sized(docs.withColumn("__doc", F.struct(*columns)), "__doc"), plans).where(F.col("copies") > 0)
    return mixed.select("__doc", F.explode(F.sequence(F.lit(1), "copies"))).select("__doc.*")


def digest(docs: DataFrame) -> DataFrame:
    rows = stage(sized(docs), "sizes")
    out = apply(rows, stage(plan(rows), "mix-plan"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
