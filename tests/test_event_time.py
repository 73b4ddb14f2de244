"""Buckets of a stream whose requests come out of order, cut into batches anyhow, against the fold of the whole table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitewright.streaming import rate_limit

START = dt.datetime(2024, 3, 1)
REQUEST = "request long, principal string, known boolean, asks boolean, ts timestamp"


def some_requests(seed, n=500):
    r, t, out = random.Random(seed), START, []
    for i in range(n):
        t += dt.timedelta(seconds=r.choice([0, 1, 5, 40]))
        who = r.choice(["ip:hot"] * 4 + [f"ip:{r.randrange(5)}", "user:a", "user:b"])
        out.append((i, who, who.startswith("user"), r.random() < 0.7, t))
    return out


def as_a_table(spark, rows):
    df = spark.createDataFrame(rows, REQUEST).withColumn("t", F.unix_micros("ts") / 1e6)
    first = rate_limit.limited(df, "submit", F.lit(True)).withColumnsRenamed({"allowed": "submitted", "retry_s": "submit_retry"})
    asked = rate_limit.limited(first.where("submitted AND asks").drop("attempt"), "new_crawl", F.lit(True))
    told = {x.request: (x.allowed, x.retry_s) for x in asked.collect()}
    return {x.request: (x.principal, x.submitted, x.submit_retry, *told.get(x.request, (None, None))) for x in first.collect()}


def as_a_stream(spark, batches, folder, delay, restart=False):
    last = max(x[4] for b in batches for x in b if x[4]) + dt.timedelta(days=400)
    # Two later requests of others let the watermark pass all and wait themselves.
    batches = [*batches, [(-1, "end", False, False, last)], [(-2, "end", False, False, last)]]
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/*"))
    step = 1 if restart else len(batches)
    for i in range(0, len(batches), step):
        for j, b in enumerate(batches[i : i + step], i):
            spark.createDataFrame(b, REQUEST).coalesce(1).write.parquet(str(folder / f"in/batch={j}"))
        out = rate_limit.limited_stream(stream, delay).writeStream.format("parquet").option("path", str(folder / "out"))
        out.option("checkpointLocation", str(folder / "at")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(folder / "out")).collect()
    assert len(got) == len({x.request for x in got})
    return {x.request: (x.principal, x.submitted, x.submit_retry, x.allowed, x.retry_s) for x in got}


@pytest.mark.parametrize(("seed", "cuts", "restart"), [(1, 1, False), (2, 3, False), (3, 4, True)])
def test_any_cut_gives_the_tables_result(spark, tmp_path, seed, cuts, restart):
    """Each request comes up to ten minutes late; a query that is started anew for each batch goes on where it was."""
    rows, r = some_requests(seed), random.Random(seed)
    come = sorted(rows, key=lambda x: x[4] + dt.timedelta(seconds=r.uniform(0, 600)))
    at = sorted(r.sample(range(1, len(rows)), cuts - 1))
    batches = [come[i:j] for i, j in zip([0, *at], [*at, len(rows)], strict=True)]
    assert cuts == 1 or any(a[4] > b[4] for a in batches[0] for b in batches[1])
    got, want = as_a_stream(spark, batches, tmp_path, "10 minutes", restart), as_a_table(spark, rows)
    assert got == want
    assert {x[1] for x in want.values()} == {True, False} and {x[3] for x in want.values()} == {True, False, None}


def test_odd_requests(spark, tmp_path):
    """Without a time: dropped. Without a principal: one that is unknown."""
    rows = [(1, None, None, True, START), (2, "ip:1", False, None, START), (3, "ip:1", False, True, None)]
    got = as_a_stream(spark, [rows], tmp_path, "1 minute")
    assert got == {1: ("unknown", True, None, True, None), 2: ("ip:1", True, None, None, None)}
