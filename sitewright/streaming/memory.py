"""Tables of limited size, least recently used key out first (T-2), over accesses that are read as data.

A table of n keys still holds a key if fewer than n other keys came since its last access. That number, the access's stack distance,
needs no table to be kept: of the accesses j before access i, those whose own last access lies before i's are counted. Those up to
i's last access are among them all, and of those behind it each key's first, so the number is the count less i's last place plus one.

The count is taken over ranges of places, a bounded number of accesses each. As every place is the last access of one other access at
most, the accesses whose last one lies in a range are as bounded, whatever a key's share of the rows. So it is made of three parts:
within the range of i, within the range of its last access, and sums over whole ranges for the rest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import materialize
from . import rate_limit

#: Keys that a service holds a bucket for.
KEYS = 10_000
#: Accesses in a range, the least; and ranges, the most: there is a sum for each pair of these.
LEAST_RANGE, MOST_RANGES = 1 << 16, 4096


def below_before(x: np.ndarray) -> np.ndarray:
    """For each value the number of smaller ones before it, by merging blocks of 1, 2, 4, .. values. Equal ones may count."""
    n = len(x)
    order, out, half = np.argsort(x, kind="stable"), np.zeros(n, np.int64), 1
    while half < n:
        by_block = order[np.argsort(order // (2 * half), kind="stable")]
        left = (by_block // half) % 2 == 0
        upto = np.cumsum(left)
        # All blocks but the last are full, so half of the values in the blocks before stand left.
        right = by_block[~left]
        out[right] += upto[~left] - right // (2 * half) * half
        half *= 2
    return out


def _counted(name: str, order: Callable[[pa.Table], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def count(rows: pa.Table) -> pa.Table:
        at, n = order(rows), np.empty(rows.num_rows, np.int64)
        n[at] = below_before(rows.column("_prev").to_numpy()[at])
        return rows.append_column(name, pa.array(n))

    return count


def _in_time(rows: pa.Table) -> np.ndarray:
    return np.argsort(rows.column("_at").to_numpy())


def _range_by_range(rows: pa.Table) -> np.ndarray:
    """Within a range from the last to the first, so that accesses of one range don't count each other."""
    return np.lexsort((-rows.column("_prev").to_numpy(), rows.column("_r").to_numpy()))


def placed(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Rows with ``_at``, their place in a total order from 0, and their number. Spark deals ranges of the order and sorts each; how many
    rows are in the ranges before is a row a range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = materialize(dealt, "accesses").withColumn("_part", F.shiftright("_id", 33))
    held = materialize(dealt.groupBy("_part").agg(F.count("*").alias("_n")), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("_part", before.alias("_before"))
    out = dealt.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1))
    return out.select(*rows.columns, "_at"), held.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def distances(rows: DataFrame, key: str, *order: str, range_size: int | None = None) -> DataFrame:
    """Rows with ``since``: how many other keys came since the last access of theirs, null at a key's first.

    ``order`` is to be total, nulls come first; a null key is a key; an empty table stays empty.
    """
    at, n = placed(rows, *order)
    size = range_size or max(LEAST_RANGE, -(-n // MOST_RANGES))
    place = lambda c: F.floor(c / size).cast("int")
    at = at.withColumn("_r", place(F.col("_at")))
    # The last place of a key in each range, so that no task has all of a key.
    last = at.groupBy(F.col(key).alias("_key"), F.col("_r").alias("_of")).agg(F.max("_at").alias("_last"))
    last = last.select("_key", "_of", F.lag("_last").over(Window.partitionBy("_key").orderBy("_of")).alias("_earlier"))
    here = F.lag("_at").over(Window.partitionBy(key, "_r").orderBy("_at"))
    both = at.withColumn("_here", here).join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_r") == F.col("_of")))
    prev = F.coalesce("_here", "_earlier", F.lit(-1))
    pairs = both.select(*rows.columns, "_at", "_r", prev.alias("_prev")).withColumn("_q", place(F.col("_prev")))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    pairs = materialize(pairs.groupBy("_r").applyInArrow(_counted("_same", _in_time), f"{columns}, _same bigint"), "last-accesses")

    sums = _sums(pairs, -(-n // size))
    again = pairs.where("_prev >= 0").groupBy("_q").applyInArrow(_counted("_near", _range_by_range), f"{columns}, _same bigint, _near bigint")
    again = again.join(sums, (F.col("_r") == F.col("_sr")) & (F.col("_q") == F.col("_sq")))
    since = F.col("_same") + F.col("_near") + F.col("_far") - F.col("_prev") - 1
    first = pairs.where("_prev < 0").select(*rows.columns, F.lit(None).cast("long").alias("since"))
    return again.select(*rows.columns, since.alias("since")).unionByName(first)


def _sums(pairs: DataFrame, ranges: int) -> DataFrame:
    """(_sr, _sq, _far): accesses in ranges before _sr whose last one is in a range before _sq, or that have none."""
    cells = pairs.groupBy("_r", "_q").agg(F.count("*").alias("_n"))
    every = pairs.sparkSession.range(ranges).select(F.col("id").cast("int").alias("_r")).withColumn("_q", F.explode(F.sequence(F.lit(-1), F.col("_r"))))
    full = every.join(cells, ["_r", "_q"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    before = lambda c, part, by: F.coalesce(F.sum(c).over(Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A range of last accesses has cells from the range of its own on; earlier ones would be empty.
    full = full.withColumn("_up", before("_n", "_q", "_r")).withColumn("_far", before("_up", "_r", "_q"))
    return full.where("_n > 0 AND _q >= 0").select(F.col("_r").alias("_sr"), F.col("_q").alias("_sq"), "_far")


def remembered(rows: DataFrame, key: str, *order: str, keys: int = KEYS, range_size: int | None = None) -> DataFrame:
    """Rows with ``since`` and ``held``: whether a table of ``keys`` keys still has the key when the access comes."""
    out = distances(rows, key, *order, range_size=range_size)
    return out.withColumn("held", F.coalesce(F.col("since") < keys, F.lit(False)))


def admit(events: DataFrame, key: str, at: Column, event: str, capacity: float, per_second: float, keys: int = KEYS, range_size: int | None = None) -> DataFrame:
    """T-1 with T-2: (key, event, since, held, allowed, remaining, retry_s) of token buckets that a service holds for ``keys`` keys at a
    time: a bucket that was given up starts full again. Accesses are ordered by (at, event)."""
    rows = events.select(F.col(key), at.cast("timestamp").alias("_ts"), F.col(event).cast("long").alias(event))
    held = materialize(remembered(rows, key, "_ts", event, keys=keys, range_size=range_size), "held")
    out = rate_limit.admit(held, key, F.col("_ts"), event, capacity, per_second, held=F.col("held"), keep=("since", "held"))
    return out.select(key, event, "since", "held", "allowed", "remaining", "retry_s")
