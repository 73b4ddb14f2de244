"""Submissions decided one after another, against a service that answers one by one; streams against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitewright.operators import requests, store
from sitewright.streaming import decisions, rate_limit

START = dt.datetime(2024, 3, 1)
REQUEST = "request long, ts timestamp_ntz, user string, ip string, origin string, host string, url string"
HOSTS = ["a.com", "www.a.com", "b.com", "www.b.com", "c.com", "www.c.com"]
# c.com leads to b.com, www.c.com to www.b.com, so c.com is asked for at its own address and as www.b.com's, without www.
FINALS = {"https://a.com/": "https://a.com/", "https://www.a.com/": "https://a.com/", "https://b.com/": "https://www.b.com/", "https://www.b.com/": "https://www.b.com/", "https://c.com/": "https://b.com/", "https://www.c.com/": "https://www.b.com/"}


def flip(url):
    return url.replace("https://www.", "https://") if "://www." in url else url.replace("https://", "https://www.")


def canonical(url):
    one, two = FINALS.get(url, url), FINALS.get(flip(url), flip(url))
    return one if one == two else one.replace("https://www.", "https://")


@pytest.fixture(scope="module")
def tables(spark):
    at = START - dt.timedelta(hours=23)
    pages = spark.createDataFrame([("https://a.com/", "pa", "# a", at, "old"), ("https://b.com/", "pb", " ", at, None)], "url string, id string, result string, updated_at timestamp_ntz, content_signature string")
    jobs = spark.createDataFrame([(7, "https://www.b.com/", "scoring", START, START), (6, "https://www.b.com/", "failed", START, START)], "id long, page_url string, status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    return {
        "pages": pages, "jobs": jobs, "finals": spark.createDataFrame(list(FINALS.items()), "url string, final string"),
        "addresses": spark.createDataFrame([(h, ["8.8.8.8"]) for h in HOSTS], "host string, ips array<string>"),
        "signatures": spark.createDataFrame([("https://a.com/", "new")], "url string, now string"),
    }


def some_requests(seed, n=220):
    r, t, out = random.Random(seed), START, []
    for k in range(n):
        t += dt.timedelta(seconds=r.choice([0, 1, 30, 120, 400, 1500]))
        user = r.choice([None] * 5 + ["u1"])
        url = r.choice([f"https://{h}/" for h in HOSTS] + ["http://10.0.0.1/"] * (k % 20 == 0))
        out.append((k, t, user, "1.1.1.1", "https://evil.com" if r.random() < 0.03 else None, "app.com", url))
    r.shuffle(out)
    return out


def one_by_one(rows):
    """(request, decision, key, job_id, dispatched_by) as a service gives them."""
    jobs, checked, buckets, out = {}, {}, {}, []

    def take(who, name):
        capacity, rate = rate_limit.LIMITS[("auth_" if who.startswith("user:") else "anon_") + name]
        tokens, last = buckets.get((who, name), (capacity, t))
        tokens = min(capacity, tokens + (t - last) * rate)
        ok = tokens >= 1
        buckets[(who, name)] = (tokens - ok, t)
        return ok

    for k, ts, user, ip, origin, _, url in sorted(rows, key=lambda x: (x[1], x[0])):
        t = (ts - START).total_seconds()
        who = f"user:{user}" if user else f"ip:{ip}"
        if origin or "10.0" in url:
            out.append((k, "forbidden" if origin else "unsafe", None, None, None))
            continue
        if not take(who, "submit"):
            out.append((k, "submit_flood", None, None, None))
            continue
        found = None
        for key in dict.fromkeys((url, flip(url), canonical(url))):
            if key == "https://a.com/" and t < 3600:
                found = (k, "cached", key, None, None)
            elif key in jobs and t - jobs[key][0] <= 900:
                found = (k, "attached", key, None, jobs[key][1])
            elif key == "https://www.b.com/" and t <= 900:
                found = (k, "attached", key, 7, None)
            if found:
                break
        key = canonical(url)
        if not found and key == "https://a.com/":
            if key in checked:
                found = (k, "cached_unchanged", key, None, None)
            checked[key] = True
        if not found:
            if take(who, "new_crawl"):
                jobs[key], found = (t, k), (k, "dispatched", key, None, k)
            else:
                found = (k, "new_crawl_quota", None, None, None)
        out.append(found)
    return sorted(out)


COLUMNS = ("request", "decision", "key", "job_id", "dispatched_by")


@pytest.mark.parametrize("seed", [1, 7])
def test_decisions_are_those_of_a_service(spark, tables, seed):
    rows = some_requests(seed)
    got, _ = decisions.decided_in_order(spark.createDataFrame(rows, REQUEST), **tables)
    want = one_by_one(rows)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == want
    assert {"attached", "cached", "cached_unchanged", "dispatched", "new_crawl_quota", "unsafe", "forbidden"} <= {x[1] for x in want}


def test_two_requests_for_a_new_page(spark, tables):
    rows = [(1, START, None, "1.1.1.1", None, "app.com", "https://www.c.com/"), (2, START, "u", "1.1.1.2", None, "app.com", "https://www.c.com/")]
    tables = tables | {"jobs": tables["jobs"].limit(0)}
    df = spark.createDataFrame(rows, REQUEST)
    got, _ = decisions.decided_in_order(df, **tables)
    assert [(r.request, r.decision, r.dispatched_by) for r in got.orderBy("request").collect()] == [(1, "dispatched", 1), (2, "attached", 1)]
    job = decisions.created(got, df).collect()
    assert [(j.url, j.source) for j in job] == [(canonical("https://www.c.com/"), "ip:1.1.1.1")]
    pages, jobs = store.create_jobs(tables["pages"].select("url", "id").withColumn("monitored", F.lit(False)), spark.createDataFrame([], "id string, page_url string, status string, source string, created_at timestamp_ntz, updated_at timestamp_ntz"), decisions.created(got, df), F.lit(START))
    assert pages.where("monitored").count() == 1 and jobs.where("status = 'pending'").count() == 1


def test_no_requests(spark, tables):
    got, state = decisions.decided_in_order(spark.createDataFrame([], REQUEST), **tables)
    assert got.count() == 0 and state.count() == 0


def test_a_stream_decides_as_a_batch(spark, tables, tmp_path):
    """Whatever the cut into micro-batches; a batch that is run again leaves the same."""
    rows = sorted(some_requests(3, 60), key=lambda x: (x[1], x[0]))
    for i, part in enumerate((rows[:7], rows[7:31], rows[31:])):
        spark.createDataFrame(part, REQUEST).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    for run in range(2):  # the second begins anew, over what the first left
        decisions.decide_stream(stream, str(tmp_path / "out"), lambda batch: tables).option("checkpointLocation", str(tmp_path / f"at{run}")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.option("basePath", str(tmp_path / "out/decisions")).parquet(str(tmp_path / "out/decisions"))
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == one_by_one(rows)


def test_throttle(spark):
    rows = [("a", 0, 1), ("a", 499, 2), ("a", 500, 3), ("a", 999, 4), ("a", 1000, 5), ("b", 700, 6), (None, 1, 7), (None, 1, 8), ("b", None, 9), ("a", 5000, 10)]
    df = spark.createDataFrame([(k, None if t is None else START + dt.timedelta(milliseconds=t), i) for k, t, i in rows], "k string, at timestamp_ntz, i long")
    assert sorted(r.i for r in rate_limit.throttled(df, "k", "at", 500, "i").collect()) == [1, 3, 5, 6, 7, 10]
    assert rate_limit.throttled(df.limit(0), "k", "at", 500).count() == 0


def test_bucket_state_goes_on(spark):
    rows = [(k, f"ip:{k % 3}", False, 60.0 * k) for k in range(400)]
    df = spark.createDataFrame(rows, "request long, principal string, known boolean, t double")
    whole = {r.request: r.allowed for r in rate_limit.limited(df, "new_crawl", F.lit(True)).collect()}
    first = rate_limit.limited(df.where("request < 150"), "new_crawl", F.lit(True)).collect()
    last = {r.principal: (r.principal, r.tokens, r.last) for r in sorted(first, key=lambda r: r.request)}
    state = spark.createDataFrame(list(last.values()), "principal string, tokens double, last double")
    rest = rate_limit.limited(df.where("request >= 150"), "new_crawl", F.lit(True), state).collect()
    assert {r.request: r.allowed for r in [*first, *rest]} == whole and not all(whole.values())


def test_looks_are_told_apart(spark, tables):
    df = spark.createDataFrame([(1, START, None, "1.1.1.1", None, "app.com", "https://a.com/")], REQUEST)
    r = requests.prepared(df, **tables, now=F.col("ts")).first()
    assert [(x.prio, x.key, x.state) for x in r.looks] == [(1, "https://a.com/", "cached"), (2, "https://www.a.com/", None)]
