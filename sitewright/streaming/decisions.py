"""Submissions decided one after another (D7, T-4, T-12, T-15, K1): what one request is told changes what the next one sees.

A crawl that is dispatched has later requests for its page attach to it, a check of a page's signature makes it the stored one,
and a crawl is only dispatched if the principal's bucket allows it. So a decision hangs on earlier ones of the same page and of
the same principal, which hang on others in turn, and neither key alone parts the requests.

The fixed point of two folds has them all: one over pages in time order, which takes as given whom the buckets would let through,
and one over buckets, which takes as given who asks for a crawl. Each round both are dealt by their key, sorted and folded by
Spark. By induction over time a state that both agree on is that of a service that answers one by one: the first request that
differed would have the same page and the same bucket before it. Each round settles the earliest open request at least, and
since the buckets also say of those who did not ask whether they would have been let through, most at once.

Streams: each micro-batch is decided on the state that the one before left, in a folder a batch id. A batch that is
repeated reads the same state and overwrites its own result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import monitor, store
from ..operators.requests import at_canonical, first_look, prepared
from ..plans.staging import materialize
from . import rate_limit

#: Seconds for which a job is waited for that nobody has heard of again.
ALIVE = 60.0 * store.STUCK_MINUTES
_STATE = "kind string, key string, at double, request bigint, tokens double"


def _pages(looks: DataFrame) -> DataFrame:
    """Rows (request, t, key, asks, served, allowed, stored, told, same, last, last_request, checked) in order within each key, with
    ``outcome`` active, unchanged, attempt or null, ``by``, the request whose job is active, and the page's state behind them.

    Only rows that ask, and are not served elsewhere, change the page: an attempt that is allowed begins a job, and a check of a
    stored page makes its present signature the stored one."""
    ours = ("last", "last_request", "checked", "outcome", "by")
    rest = [c for c in looks.columns if c not in ours]
    used = ("key", "t", "request", "asks", "served", "allowed", "stored", "told", "same", "last", "last_request", "checked")

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, begun, last, by, checked = None, False, None, None, False
        for frame in frames:
            out = []
            for key, t, request, asks, served, allowed, stored, told, same, last_before, by_before, checked_before in zip(*(frame.column(c).to_pylist() for c in used), strict=True):
                if not begun or key != page:
                    page, begun, last, by, checked = key, True, last_before, by_before, bool(checked_before)
                outcome = None
                if last is not None and t - last <= ALIVE:
                    outcome = "active"
                elif asks and not served:
                    unchanged = stored and told and (same or checked)
                    checked = checked or (stored and told)
                    outcome = "unchanged" if unchanged else "attempt"
                found = by if outcome == "active" else None
                if outcome == "attempt" and allowed:
                    last, by = t, request
                out.append((last, by, checked, outcome, found))
            new = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(frame.column(c) for c in rest), *new], [*rest, *ours])

    kinds = ", ".join(f"`{c}` {looks.schema[c].dataType.simpleString()}" for c in rest)
    one = looks.select(*rest, *ours[:3]).repartition("key").sortWithinPartitions("key", "t", "request")
    return one.mapInArrow(fold, f"{kinds}, last double, last_request bigint, checked boolean, outcome string, by bigint")


def _candidates(ready: DataFrame, state: DataFrame) -> DataFrame:
    """The requests that are let in, with the looks whose outcome may depend on the requests before them: those before the first
    hit in the store, and that one if it is a job, since a later one counts."""
    hit = first_look(F.col("looks"), lambda x: x["state"].isNotNull())
    r = ready.where(F.col("refused").isNull() & F.col("submitted")).withColumns({"hit": hit, "at": at_canonical()})
    open_ = F.filter("looks", lambda x: F.col("hit").isNull() | (x["prio"] < F.col("hit.prio")) | ((x["prio"] == F.col("hit.prio")) & (F.col("hit.state") == "attached")))
    told = F.col("now").isNotNull()
    look = F.transform(open_, lambda x: F.struct(
        x["key"].alias("key"), x["prio"].alias("prio"), (F.col("hit").isNull() & (x["key"] == F.col("canonical"))).alias("asks"), x["stored"].alias("stored"), told.alias("told"),
        (told & ~monitor.changed(x["sig"], F.col("now"))).alias("same"),
    ))
    rows = r.select("request", "t", "principal", "known", F.lit(False).alias("served"), F.lit(False).alias("tries"), F.lit(True).alias("allowed"), F.lit(None).cast("long").alias("retry_s"), F.inline(look))
    pages = state.where("kind = 'page'").select(F.col("key").alias("_k"), F.col("at").alias("last"), F.col("request").alias("last_request"), (F.col("tokens") > 0).alias("checked"))
    return rows.join(pages, F.col("key") == F.col("_k"), "left").drop("_k").withColumns({"before": F.struct("last", "last_request", "checked"), "behind": F.struct("last", "last_request", "checked")})


_LOOK = ("key", "prio", "asks", "stored", "told", "same", "before", "behind", "outcome", "by")


def _round(rows: DataFrame, crawl: DataFrame) -> DataFrame:
    """A round: rows (a look each) folded by page, put together by request, folded by bucket. ``moved`` says whether a request's
    part in either fold is another one than it was taken for."""
    rows = rows.select(*(c for c in rows.columns if c not in ("outcome", "by", "behind", "last", "last_request", "checked")), "before.*")
    folded = _pages(rows).withColumn("behind", F.struct("last", "last_request", "checked"))
    request = F.struct("t", "principal", "known", "served", "tries", "allowed", "retry_s")
    one = folded.groupBy("request").agg(F.first(request).alias("r"), F.array_sort(F.collect_list(F.struct("prio", *(c for c in _LOOK if c != "prio")))).alias("looks")).select("request", "r.*", "looks")
    asking = first_look(F.col("looks"), lambda x: x["asks"])
    # All addresses are looked up before a page is checked or a crawl is asked for.
    served = F.exists("looks", lambda x: (x["outcome"] == "active") & ~x["asks"])
    one = one.withColumns({"_asks": asking, "_served": F.coalesce(served, F.lit(False))})
    one = one.withColumn("_tries", ~F.col("_served") & F.coalesce(F.col("_asks.outcome") == "attempt", F.lit(False)))
    one = one.withColumnsRenamed({"allowed": "_was", "retry_s": "_retry"})
    out = rate_limit.limited(one, "new_crawl", F.col("_tries"), crawl).drop("attempt", "_retry")
    moved = (F.col("served") != F.col("_served")) | (F.col("tries") != F.col("_tries")) | (F.col("_tries") & (F.col("_was") != F.col("allowed")))
    out = out.withColumn("moved", moved).withColumns({"served": F.col("_served"), "tries": F.col("_tries")})
    return out.drop("_served", "_tries", "_was", "_asks")


def empty_state(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _STATE)


def decided_in_order(
    requests: DataFrame, pages: DataFrame, jobs: DataFrame, finals: DataFrame, addresses: DataFrame, signatures: DataFrame, state: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(decisions, state) of requests decided in the order of (ts, request); inputs as of ``requests.decided``, where the store is
    that before the first of them, and each request's own time is its now.

    Decisions are (request, decision, key, retry_s, page_id, job_id, dispatched_by): ``job_id`` is a job of the store, ``dispatched_by``
    the request whose job it is otherwise, its own if it was dispatched. ``state`` (kind, key, at, request, tokens) is what later
    requests need: buckets that are not full, jobs that may be alive, pages whose signature was checked.
    """
    state = empty_state(requests) if state is None else state
    bucket = lambda kind: state.where(F.col("kind") == kind).select(F.col("key").alias("principal"), "tokens", F.col("at").alias("last"))
    ready = prepared(requests, pages, jobs, finals, addresses, signatures, F.col("ts"))
    ready = rate_limit.limited(ready, "submit", F.col("refused").isNull(), bucket("submit")).withColumnsRenamed({"allowed": "submitted", "retry_s": "submit_retry"})
    ready = materialize(ready.drop("attempt"), "submitted")
    crawl = bucket("new_crawl")
    rows, done = _candidates(ready, state), None
    while done is None or not done.where("moved").isEmpty():
        done = materialize(_round(rows, crawl), "decided")
        rows = done.select("request", "t", "principal", "known", "served", "tries", "allowed", "retry_s", F.inline("looks"))
    hit = first_look(F.col("looks"), lambda x: x["state"].isNotNull())
    late = first_look(F.col("made"), lambda x: x["outcome"] == "active")
    asked = first_look(F.col("made"), lambda x: x["asks"])
    out = ready.select("request", "refused", "submitted", "submit_retry", "canonical", hit.alias("hit"), at_canonical().alias("at"), "looks")
    out = out.join(done.select("request", F.col("looks").alias("made"), "allowed", "retry_s"), "request", "left").withColumns({"late": late, "asked": asked})
    # A job that was begun here counts where it is found before anything in the store, or is newer than a job at the same address.
    by_late = F.col("late").isNotNull() & (F.col("hit").isNull() | (F.col("late.prio") <= F.col("hit.prio")))
    decision = F.coalesce(
        "refused", F.when(~F.col("submitted"), "submit_flood"), F.when(by_late, "attached"), "hit.state", F.when(F.col("asked.outcome") == "unchanged", "cached_unchanged"), F.when(~F.col("allowed"), "new_crawl_quota"), F.lit("dispatched")
    )
    told = decision.isin("cached", "attached", "cached_unchanged", "dispatched")
    key = F.when(by_late, F.col("late.key")).otherwise(F.coalesce("hit.key", "canonical"))
    page = F.get(F.filter("looks", lambda x: x["key"] == F.col("_key")), F.lit(0))["page"]
    out = out.withColumns({"decision": decision, "_key": F.when(told, key)})
    decisions = out.select(
        "request", "decision", F.col("_key").alias("key"), F.when(decision == "submit_flood", F.col("submit_retry")).when(decision == "new_crawl_quota", F.col("retry_s")).alias("retry_s"),
        F.when(told, F.coalesce(page, store.page_id(F.col("_key")))).alias("page_id"), F.when(told & ~by_late, F.col("hit.job")).alias("job_id"),
        F.when(told & by_late, F.col("late.by")).when(decision == "dispatched", F.col("request")).alias("dispatched_by"),
    )
    return decisions, _state_behind(state, ready, done)


def _state_behind(state: DataFrame, ready: DataFrame, done: DataFrame) -> DataFrame:
    newest = F.struct("t", "request")
    parts = []
    for kind, rows in (("submit", ready), ("new_crawl", done)):
        b = rows.groupBy("principal").agg(F.max_by(F.struct("tokens", "last", "known"), newest).alias("b"))
        parts.append(b.select(F.lit(kind).alias("kind"), F.col("principal").alias("key"), F.col("b.last").alias("at"), F.lit(None).cast("long").alias("request"), F.col("b.tokens").alias("tokens")))
    looks = done.select("t", "request", F.inline("looks")).groupBy("key").agg(F.max_by("behind", newest).alias("p"))
    parts.append(looks.select(F.lit("page").alias("kind"), "key", F.col("p.last").alias("at"), F.col("p.last_request").alias("request"), F.coalesce(F.col("p.checked").cast("double"), F.lit(0.0)).alias("tokens")))
    new = parts[0].unionByName(parts[1]).unionByName(parts[2])
    kept = state.join(new.select("kind", "key"), ["kind", "key"], "left_anti").select(*new.columns)
    now = ready.agg(F.max("t").alias("now"))
    limit = lambda i: F.when(F.col("key").startswith("user:"), F.when(F.col("kind") == "submit", F.lit(float(rate_limit.LIMITS["auth_submit"][i]))).otherwise(float(rate_limit.LIMITS["auth_new_crawl"][i]))).otherwise(
        F.when(F.col("kind") == "submit", F.lit(float(rate_limit.LIMITS["anon_submit"][i]))).otherwise(float(rate_limit.LIMITS["anon_new_crawl"][i]))
    )
    full = F.col("tokens") + (F.col("now") - F.col("at")) * limit(1) >= limit(0)
    over = F.when(F.col("kind") == "page", (F.col("tokens") == 0) & F.coalesce(F.col("now") - F.col("at") > ALIVE, F.lit(True))).otherwise(full)
    return new.unionByName(kept).crossJoin(F.broadcast(now)).where(~F.coalesce(over, F.lit(False))).drop("now")


def created(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """K1, K6: the jobs (id, url, source, created_at) that ``store.create_jobs`` is to make of decisions."""
    r = requests.select(F.col("request").cast("long").alias("_r"), "ts", F.coalesce(F.concat(F.lit("user:"), F.col("user")), F.concat(F.lit("ip:"), F.col("ip"))).alias("source"))
    out = decisions.where("decision = 'dispatched'").join(r, F.col("request") == F.col("_r"))
    return out.select(store.page_id(F.concat_ws(" ", F.col("request").cast("string"), F.col("key"))).alias("id"), F.col("key").alias("url"), "source", F.col("ts").alias("created_at"))


def decide_stream(requests: DataFrame, folder: str, of_batch: Callable[[DataFrame], dict[str, DataFrame]]) -> DataStreamWriter:
    """A writer that decides each micro-batch of a stream of requests and writes ``folder``/decisions/batch=n; start it with a
    checkpoint. ``of_batch`` gives the store's tables (pages, jobs, finals, addresses, signatures) for a batch.

    Requests are decided in the order of their batches, within one in that of their times. The state behind batch n is a table of
    its own, which n + 1 reads: a batch that is run again, whole or after a loss, gives the same rows and the same state.
    """

    def decide(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={n - 1}") if n else None
        decisions, after = decided_in_order(batch, state=state, **of_batch(batch))
        decisions.write.mode("overwrite").parquet(f"{folder}/decisions/batch={n}")
        after.write.mode("overwrite").parquet(f"{folder}/state/batch={n}")

    return requests.writeStream.foreachBatch(decide)
