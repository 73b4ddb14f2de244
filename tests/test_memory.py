"""Tables of limited size against a table that is kept, access by access."""

import datetime as dt
import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.streaming import memory, rate_limit

START = dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65, 500])
def test_below_before(n):
    x = np.random.default_rng(n).permutation(n)
    assert memory.below_before(x).tolist() == [int((x[:i] < x[i]).sum()) for i in range(n)]


def accesses(seed, n=900):
    """One key has a third of the rows, some come once, one is null; several come at one time."""
    r, t, out = random.Random(seed), START, []
    for i in range(n):
        t += dt.timedelta(seconds=r.choice([0, 0, 1, 600]))
        out.append((r.choice(["hot"] * 20 + [f"k{r.randrange(40)}"] * 35 + [f"once{i}", None]), t, i))
    return out


def by_hand(rows, keys, capacity, rate):
    table, recent, out = OrderedDict(), OrderedDict(), {}
    for key, t, i in sorted(rows, key=lambda x: x[1:]):
        since = list(reversed(recent)).index(key) if key in recent else None
        recent.pop(key, None)
        recent[key] = True
        held = key in table
        tokens, last = table.pop(key, (capacity, t))
        tokens = min(capacity, tokens + (t - last).total_seconds() * rate)
        allowed = tokens >= 1
        table[key] = (tokens - allowed, t)
        if len(table) > keys:
            table.popitem(last=False)
        out[i] = (since, held, allowed)
    return out


@pytest.mark.parametrize(("seed", "keys", "size"), [(1, 5, 37), (2, 12, 100), (3, 1, 64), (4, 1000, 2000), (5, 20, 1)])
def test_buckets_of_a_table_of_limited_size(spark, seed, keys, size):
    rows = accesses(seed, 120 if size == 1 else 900)
    df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "key string, ts timestamp_ntz, event long")
    got = memory.admit(df, "key", F.col("ts"), "event", 3, 3 / 3600, keys=keys, range_size=size).collect()
    want = by_hand(rows, keys, 3.0, 3 / 3600)
    assert {x.event: (x.since, x.held, x.allowed) for x in got} == want and len(got) == len(want)
    assert len({x[1] for x in want.values()}) == 2 and len({x[2] for x in want.values()}) == 2


def test_a_large_table_forgets_nothing(spark):
    df = spark.createDataFrame(accesses(6, 400), "key string, ts timestamp_ntz, event long")
    limited = {(x.event, x.allowed, x.remaining, x.retry_s) for x in memory.admit(df, "key", F.col("ts"), "event", 3, 3 / 3600).collect()}
    assert limited == {(x.event, x.allowed, x.remaining, x.retry_s) for x in rate_limit.admit(df, "key", F.col("ts"), "event", 3, 3 / 3600).collect()}


def test_odd_rows(spark):
    """No rows; rows without a time, which come first; other columns, which stay."""
    df = spark.createDataFrame([("a", None, 1, [1.5]), ("b", START, 2, None), ("a", START, 3, [])], "key string, ts timestamp_ntz, event long, x array<double>")
    assert memory.remembered(df.limit(0), "key", "ts", "event").count() == 0
    got = memory.remembered(df, "key", "ts", "event", keys=1).orderBy("event").collect()
    assert [(x.event, x.since, x.held, x.x) for x in got] == [(1, None, False, [1.5]), (2, None, False, None), (3, 1, False, [])]
