"""Token buckets (T-1-T-4) and the throttle (T-11) over events: folds for batches, keyed state for streams."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Capacity and tokens a second, by use.
LIMITS = {
    "anon_submit": (60, 60 / 3600), "auth_submit": (300, 300 / 3600), "anon_new_crawl": (3, 3 / 3600), "auth_new_crawl": (50, 50 / 3600),
    "cron_monitor": (12, 12 / 3600), "zip_download": (1, 1 / 86400),
}


def admit(events: DataFrame, key: str, at: Column, event: str, capacity: float, per_second: float, held: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, event, allowed, remaining, retry_s) of events folded in time order within each key; buckets start full, and again
    where ``held`` says that a key's bucket was given up. ``keep`` columns follow the event.

    Rows are dealt by key and sorted, by Spark, which spills; the fold then reads them once and holds one bucket, so a key
    with many events takes time but no memory.
    """
    kind = events.schema[key].dataType.simpleString()

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, tokens, last, begun = None, 0.0, 0.0, False
        for frame in frames:
            allowed, remaining, retry = [], [], []
            for k, t, same in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2).to_pylist(), strict=True):
                if not begun or k != who or not same:
                    who, tokens, last, begun = k, float(capacity), t, True
                tokens, last = min(float(capacity), tokens + max(0.0, t - last) * per_second), t
                ok = tokens >= 1
                retry.append(None if ok else max(1, ceil((1 - tokens) / per_second)))
                tokens -= ok
                allowed.append(ok)
                remaining.append(floor(tokens))
            new = [pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(retry, pa.int64())]
            yield pa.RecordBatch.from_arrays([frame.column(0), *frame.columns[3:], *new], [key, event, *keep, "allowed", "remaining", "retry_s"])

    same = F.lit(True) if held is None else held
    rows = events.select(F.col(key), (F.unix_micros(at.cast("timestamp")) / 1e6).alias("_t"), same.alias("_same"), F.col(event).cast("long").alias(event), *keep)
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "_t", event)
    kept = "".join(f", `{c}` {events.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(fold, f"`{key}` {kind}, `{event}` bigint{kept}, allowed boolean, remaining bigint, retry_s bigint")


def buckets(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Rows (.., key, t, capacity, per_second, attempt, tokens, last), folded in order of ``t`` (seconds) and ``tie`` within each
    key, with ``allowed`` and ``retry_s``; ``tokens`` and ``last`` come as a key's bucket before, null if it is full, and leave as it
    is behind the row. A row that is no attempt takes nothing: ``allowed`` says whether it would have been.

    Rows are dealt by key and sorted by Spark, which spills; the fold holds one bucket.
    """
    ours = ("tokens", "last", "allowed", "retry_s")
    rest = [c for c in rows.columns if c not in ours]

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, tokens, last, begun = None, 0.0, 0.0, False
        for frame in frames:
            out = []
            for k, t, capacity, rate, attempt, tokens_before, last_before in zip(*(frame.column(c).to_pylist() for c in (key, "t", "capacity", "per_second", "attempt", "tokens", "last")), strict=True):
                if not begun or k != who:
                    who, begun = k, True
                    tokens, last = (capacity, t) if tokens_before is None else (tokens_before, last_before)
                now = min(capacity, tokens + max(0.0, t - last) * rate)
                ok = now >= 1
                if attempt:
                    tokens, last = now - ok, t
                out.append((tokens, last, ok, None if ok else max(1, ceil((1 - now) / rate))))
            new = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(frame.column(c) for c in rest), *new], [*rest, *ours])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    one = rows.select(*rest, "tokens", "last").repartition(F.col(key)).sortWithinPartitions(key, "t", tie)
    return one.mapInArrow(fold, f"{kinds}, tokens double, last double, allowed boolean, retry_s bigint")


def limited(rows: DataFrame, action: str, attempt: Column, state: DataFrame | None = None) -> DataFrame:
    """T-4: rows (.., request, principal, known, t) through the buckets of their principals for an action, larger ones for known
    users, by ``buckets``. ``state`` is (principal, tokens, last) of buckets that are not full."""
    auth, anon = LIMITS[f"auth_{action}"], LIMITS[f"anon_{action}"]
    pick = lambda i: F.when(F.col("known"), F.lit(float(auth[i]))).otherwise(F.lit(float(anon[i])))
    rows = rows.drop("tokens", "last", "allowed", "retry_s").withColumns({"capacity": pick(0), "per_second": pick(1), "attempt": attempt})
    if state is None:
        rows = rows.withColumns({"tokens": F.lit(None).cast("double"), "last": F.lit(None).cast("double")})
    else:
        rows = rows.join(state.select(F.col("principal").alias("_p"), "tokens", "last"), F.col("principal") == F.col("_p"), "left").drop("_p")
    return buckets(rows, "principal", "request").drop("capacity", "per_second")


def admit_stream(events: DataFrame, capacity: float, per_second: float, idle_ms: int = 3_600_000) -> DataFrame:
    """(key, event, allowed) of a stream (key string, event long, ts timestamp): each micro-batch is sorted within its
    keys; a bucket idle long enough to be full is forgotten."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event"])
        out = []
        for event, ts in zip(rows["event"], rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, strict=True):
            tokens = min(capacity, tokens + max(0.0, ts - (ts if last is None else last)) * per_second)
            last = ts
            out.append(tokens >= 1)
            tokens -= out[-1]
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": key[0], "event": rows["event"], "allowed": out})

    return events.groupBy("key").applyInPandasWithState(fold, "key string, event bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


_ORDERED = "request bigint, principal string, submitted boolean, submit_retry bigint, allowed boolean, retry_s bigint"


def limited_stream(requests: DataFrame, delay: str) -> DataFrame:
    """T-4 in event time: (request, principal, submitted, submit_retry, allowed, retry_s) of a stream (request long, principal string, known
    boolean, asks boolean, ts timestamp) whose rows come up to ``delay`` out of order, over micro-batches or within them.

    A principal's requests wait in its state until the watermark is past them and are then folded in order of (ts, request): first
    through the bucket of submissions, then, if they pass and ask for a crawl, through that of crawls, else ``allowed`` is null. So any cut into
    batches gives the result of ``limited``. An event-time timer wakes a principal for its earliest waiting request, and later, when
    both buckets are full, to be forgotten: a new bucket is the same. State is two buckets and the requests of one delay.
    Rows without a time are dropped, and so are, by Spark, those that come after the watermark; the query's progress counts these.
    """
    limits = {known: [LIMITS[f"{who}_{action}"] for action in ("submit", "new_crawl")] for known, who in ((True, "auth"), (False, "anon"))}
    none = {"request": "int64", "principal": "object", "submitted": "boolean", "submit_retry": "Int64", "allowed": "boolean", "retry_s": "Int64"}

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buckets, waiting = [[None, None], [None, None]], []
        if state.exists:
            *flat, times, ids, known, asks = state.get
            buckets, waiting = [list(flat[:2]), list(flat[2:])], list(zip(times, ids, known, asks, strict=True))
        for f in frames if not state.hasTimedOut else ():
            us = f["ts"].astype("datetime64[us]").astype("int64")
            waiting += zip(us.tolist(), f["request"].tolist(), map(bool, f["known"]), map(bool, f["asks"]), strict=True)
        watermark = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = [w for w in waiting if w[0] <= 1000 * watermark]
        waiting, out = waiting[len(ready) :], []

        def take(which: int, known: bool, t: float) -> tuple[bool, int | None]:
            capacity, rate = limits[known][which]
            tokens, last = buckets[which]
            tokens = float(capacity) if tokens is None else min(float(capacity), tokens + max(0.0, t - last) * rate)
            ok = tokens >= 1
            buckets[which] = [tokens - ok, t]
            return ok, None if ok else max(1, ceil((1 - tokens) / rate))

        for us, request, known, asks in ready:
            submitted = take(0, known, us / 1e6)
            allowed = take(1, known, us / 1e6) if submitted[0] and asks else (None, None)
            out.append((request, key[0], *submitted, *allowed))
        # When the slower of the limits that a principal may have has filled both buckets.
        full = [last + (max(c for c, _ in pair) - tokens) / min(r for _, r in pair) for (tokens, last), pair in zip(buckets, zip(*limits.values(), strict=True), strict=True) if tokens is not None]
        wake = waiting[0][0] // 1000 + 1 if waiting else ceil(1000 * max(full, default=0.0))
        if waiting or wake > watermark:
            state.update((*buckets[0], *buckets[1], *([w[i] for w in waiting] for i in range(4))))
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=list(none)).astype(none)

    rows = requests.where(F.col("ts").isNotNull()).select("request", F.coalesce("principal", F.lit("unknown")).alias("principal"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("asks", F.lit(False)).alias("asks"), "ts").withWatermark("ts", delay)
    kinds = "t1 double, l1 double, t2 double, l2 double, times array<bigint>, ids array<bigint>, known array<boolean>, asks array<boolean>"
    return rows.groupBy("principal").applyInPandasWithState(fold, _ORDERED, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def throttled(rows: DataFrame, key: str, at: str, least_ms: int, *tie: str) -> DataFrame:
    """T-11: of the rows of each key, in order of (at, tie), those that are let through: the first, and each that comes ``least_ms`` or
    more after the last one that was. A null key is a key; rows without a time are not let through."""

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last, begun = None, None, False
        for frame in frames:
            through = []
            for k, t in zip(frame.column(key).to_pylist(), frame.column("_us").to_pylist(), strict=True):
                if not begun or k != who:
                    who, last, begun = k, None, True
                through.append(t is not None and (last is None or t - last >= 1000 * least_ms))
                if through[-1]:
                    last = t
            yield frame.filter(pa.array(through, pa.bool_()))

    one = rows.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).repartition(F.col(key)).sortWithinPartitions(key, "_us", *tie)
    return one.mapInArrow(fold, one.schema).drop("_us")


def interval(capacity: float, per_second: float) -> str:
    """T-3: the interval in which a limit is told."""
    return "hour" if per_second * 3600 >= 1 else "day" if per_second * 86400 >= 1 else "week"


def told(capacity: float, per_second: float) -> int:
    seconds = {"hour": 3600, "day": 86400, "week": 604800}[interval(capacity, per_second)]
    return max(1, floor(ceil(per_second * seconds * 1000) / 1000))
