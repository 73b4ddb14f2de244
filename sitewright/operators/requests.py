"""Submissions (D7, T-4, U10, U11, U28-U31, J8): what is looked up for each request, and decided against a snapshot of the store.

``decided`` takes all requests of a batch on the state before it and folds only their limits in order; ``streaming.decisions``
decides them one after another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..plans.staging import materialize
from ..streaming import rate_limit
from . import monitor, store

MOST_URL_CHARS = 2048


def unsafe(u: Column, url: Column, addresses: Column) -> Column:
    """Why an address may not be asked, or null. ``addresses`` are the answers for its host, null where there are
    none. A host in brackets is looked up like a name (T9)."""
    said = lambda why: F.concat(F.lit("Unsafe URL ("), why, F.lit("): "), url)
    host = u["host"]
    bad = F.filter(addresses, forbidden)
    return (
        F.when(u["scheme"].isNull(), said(F.lit("invalid URL")))
        .when(~u["scheme"].isin("http", "https"), said(F.lit("only http(s) URLs are allowed")))
        .when(u["port"] != "", said(F.concat(F.lit("non-default port not allowed ("), u["port"], F.lit(")"))))
        .when(host == "", said(F.lit("missing hostname")))
        .when(host.rlike(r"^\d+\.\d+\.\d+\.\d+\z"), F.when(urls.forbidden_ipv4(host), said(F.lit("forbidden IP range"))))
        .when((host == "localhost") | host.endswith(".localhost"), said(F.lit("loopback host")))
        .when(addresses.isNull(), said(F.lit("DNS lookup failed")))
        .when(F.size(bad) > 0, said(F.concat(F.lit("forbidden IP range ("), F.get(bad, F.lit(0)), F.lit(")"))))
    )


def forbidden(ip: Column) -> Column:
    """An address of either kind; what is neither is forbidden."""
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z"), urls.forbidden_ipv4(ip)).when(ip.contains(":") & ip.rlike(r"^[0-9A-Fa-f:.]+\z"), urls.forbidden_ipv6(ip)).otherwise(True)


def canonical(rows: DataFrame, finals: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``canonical`` to (.., url): where both its forms with and without www lead, if to one place, else where it
    leads itself, without www. ``finals`` is (url, final); an address that has none leads to itself."""
    f = finals.where(F.col("final").isNotNull())
    a, b = f.select(F.col("url").alias("_a"), F.col("final").alias("_fa")), f.select(F.col("url").alias("_b"), F.col("final").alias("_fb"))
    out = rows.withColumn("_alt", urls.flip_www(F.col(url))).join(a, F.col(url) == F.col("_a"), "left").join(b, F.col("_alt") == F.col("_b"), "left")
    out = out.withColumns({"_fa": F.coalesce("_fa", url), "_fb": F.coalesce("_fb", "_alt")})
    out = out.withColumns({"_na": F.coalesce(urls.parsed(F.col("_fa"))["normal"], F.col("_fa")), "_nb": F.coalesce(urls.parsed(F.col("_fb"))["normal"], F.col("_fb"))})
    bare = F.regexp_replace("_fa", r"^(?i)(https?://)www\.", "$1")
    out = out.withColumn("_bare", F.coalesce(urls.parsed(bare)["normal"], bare))
    return out.withColumn("canonical", F.when(F.col("_na") == F.col("_nb"), F.col("_na")).otherwise(F.col("_bare"))).drop("_alt", "_a", "_fa", "_b", "_fb", "_na", "_nb", "_bare")


def typed_url(raw: Column) -> Column:
    """What a person typed, with https:// unless it has a scheme."""
    t = T.trim(raw)
    return F.when((t == "") | t.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), t).otherwise(F.concat(F.lit("https://"), t))


def safe_next(path: Column) -> Column:
    """A path on the same site to go on to, else the root."""
    bad = ~path.startswith("/") | path.startswith("//") | path.startswith("/\\") | path.rlike(rf"[\x00-\x1f{T.JS_WS}]") | path.rlike("(?i)%2f|%5c")
    return F.when(path.isNull() | (path == "") | bad, "/").otherwise(path)


def origin_allowed(origin: Column, host: Column) -> Column:
    """No Origin header, or one of the same host and port."""
    u = urls.parsed(origin)
    of = F.concat(u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""))
    return F.when(F.coalesce(origin, F.lit("")) == "", True).otherwise(F.coalesce(of == host, F.lit(False)))


def client_ip(edge: Column, forwarded: Column, real: Column) -> Column:
    """The client's address: the first of the edge's header, of the forwarded ones, the real one, or ``unknown``."""
    first = lambda c: F.nullif(T.trim(F.element_at(F.split(c, ","), 1)), F.lit(""))
    return F.coalesce(first(edge), first(forwarded), F.when(real != "", T.trim(real)), F.lit("unknown"))


def admitted(requests: DataFrame, action: str) -> DataFrame:
    """T-4: (request, allowed, retry_s) of (request, principal, known, ts): buckets by principal, larger ones for known users."""
    rows = requests.select(F.col("request").cast("long"), "principal", "known", seconds(F.col("ts")).alias("t"))
    return rate_limit.limited(rows, action, F.lit(True)).select("request", "allowed", "retry_s")


def seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def prepared(requests: DataFrame, pages: DataFrame, jobs: DataFrame, finals: DataFrame, addresses: DataFrame, signatures: DataFrame, now: Column) -> DataFrame:
    """Requests (request, ts, user, ip, origin, host, url) with all that a snapshot of the store says of them, staged: (request, t,
    principal, known, refused, raw, canonical, now, looks). ``now`` is a request's time, or one for all.

    ``looks`` has the addresses that a request is looked up at, in order (T-12, S18): (prio, key, state, page, job, sig, stored), with
    state cached, attached or null, and ``stored`` whether there is a result.
    """
    known = F.col("user").isNotNull()
    r = requests.withColumns({"url": T.trim(F.col("url")), "_long": F.length("url") > MOST_URL_CHARS, "known": known, "principal": F.when(known, F.concat(F.lit("user:"), F.col("user"))).otherwise(F.concat(F.lit("ip:"), F.col("ip")))})
    r = materialize(r.withColumns({"_u": urls.parsed(F.col("url")), "_ok": origin_allowed(F.col("origin"), F.col("host"))}).drop("user", "ip", "origin", "host"), "requests")
    r = r.join(addresses.select(F.col("host").alias("_h"), "ips"), F.col("_u.host") == F.col("_h"), "left").drop("_h")
    refused = (
        F.when(~F.col("_ok"), "forbidden").when(F.coalesce("url", F.lit("")) == "", "missing").when(F.col("_long"), "too_long")
        .when(F.col("_u.scheme").isNull() | ~F.col("_u.scheme").isin("http", "https"), "invalid").when(unsafe(F.col("_u"), F.col("url"), F.col("ips")).isNotNull(), "unsafe")
    )
    r = canonical(r.withColumns({"refused": refused, "raw": F.coalesce("_u.normal", "url")}).drop("ips", "_u", "_ok", "_long"), finals)
    r = r.withColumn("alt", F.coalesce(urls.parsed(urls.flip_www(F.col("url")))["normal"], F.col("url")))
    s = signatures.select(F.col("url").alias("_s"), F.col("now").alias("now"))
    r = r.join(s, F.col("canonical") == F.col("_s"), "left").drop("_s", "url")
    r = materialize(r.select(F.col("request").cast("long"), seconds(F.col("ts")).alias("t"), "ts", "principal", "known", "refused", "raw", "alt", "canonical", "now"), "prepared")
    live = jobs.where(~F.col("status").isin(*store.TERMINAL)).groupBy("page_url").agg(F.collect_list(F.struct("created_at", "id", "updated_at")).alias("live"))
    stored = F.length(T.trim(F.col("result"))) > 0
    p = pages.select(F.col("url").alias("_k"), F.col("id").alias("page"), F.coalesce(stored, F.lit(False)).alias("stored"), "updated_at", F.col("content_signature").alias("sig"))
    known_at = p.join(live, F.col("_k") == F.col("page_url"), "full").withColumn("_k", F.coalesce("_k", "page_url")).drop("page_url")
    look = lambda k, prio: F.struct(F.lit(prio).alias("prio"), F.col(k).alias("key"))
    looks = F.array(look("raw", 1), F.when(F.col("alt") != F.col("raw"), look("alt", 2)), F.when((F.col("canonical") != F.col("raw")) & (F.col("canonical") != F.col("alt")), look("canonical", 3)))
    one = F.struct("t", "principal", "known", "refused", "raw", "canonical", "now")
    k = r.select("request", "ts", one.alias("r"), F.inline(F.array_compact(looks))).join(known_at, F.col("key") == F.col("_k"), "left")
    fine = F.filter("live", lambda j: j["updated_at"] >= now - F.expr(f"INTERVAL {store.STUCK_MINUTES} MINUTES"))
    job = F.array_max(fine)["id"]
    fresh = F.coalesce("stored", F.lit(False)) & ~store.is_stale(F.col("updated_at"), now)
    k = k.withColumns({"job": F.when(~fresh, job), "state": F.when(fresh, "cached").when(job.isNotNull(), "attached"), "stored": F.coalesce("stored", F.lit(False))})
    k = k.groupBy("request").agg(F.first("r").alias("r"), F.array_sort(F.collect_list(F.struct("prio", "key", "state", "page", "job", "sig", "stored"))).alias("looks"))
    return materialize(k.select("request", "r.*", "looks"), "looked-up")


def first_look(looks: Column, fits: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(looks, fits), F.lit(0))


def at_canonical() -> Column:
    return first_look(F.col("looks"), lambda x: x["key"] == F.col("canonical"))


def decided(requests: DataFrame, pages: DataFrame, jobs: DataFrame, finals: DataFrame, addresses: DataFrame, signatures: DataFrame, as_of: Column) -> DataFrame:
    """(request, decision, key, retry_s, page_id, job_id, content_signature) of requests (request, ts, user, ip, origin, host, url), each
    against the same snapshot; ``streaming.decisions`` has those where one request sees what the ones before it did.

    ``pages`` is (url, id, result, updated_at, content_signature), ``jobs`` as in ``store``, ``finals`` (url, final), ``addresses`` (host,
    ips), ``signatures`` (url, now): what the sites look like now, null where that could not be told. Decisions:
    forbidden, missing, too_long, invalid, unsafe, submit_flood, cached, attached, cached_unchanged, new_crawl_quota, dispatched.
    """
    r = prepared(requests, pages, jobs, finals, addresses, signatures, as_of)
    r = rate_limit.limited(r, "submit", F.col("refused").isNull()).withColumnsRenamed({"allowed": "_submit", "retry_s": "_submit_retry"})
    r = r.withColumns({"_hit": first_look(F.col("looks"), lambda x: x["state"].isNotNull()), "_at": F.when(at_canonical()["stored"], at_canonical())})
    unchanged = F.col("_at").isNotNull() & F.col("now").isNotNull() & ~monitor.changed(F.col("_at.sig"), F.col("now"))
    open_ = F.col("refused").isNull() & F.col("_submit")
    r = r.withColumn("_new", open_ & F.col("_hit").isNull() & ~unchanged)
    r = rate_limit.limited(r, "new_crawl", F.col("_new"))
    decision = F.coalesce("refused", F.when(~F.col("_submit"), "submit_flood"), "_hit.state", F.when(~F.col("_new"), "cached_unchanged"), F.when(~F.col("allowed"), "new_crawl_quota"), F.lit("dispatched"))
    done = decision.isin("cached", "attached", "cached_unchanged", "dispatched")
    return r.select(
        "request", decision.alias("decision"), F.when(done, F.coalesce("_hit.key", "canonical")).alias("key"),
        F.when(decision == "submit_flood", F.col("_submit_retry")).when(decision == "new_crawl_quota", F.col("retry_s")).alias("retry_s"),
        F.when(done, F.coalesce("_hit.page", "_at.page")).alias("page_id"), F.when(done, F.col("_hit.job")).alias("job_id"),
        F.when(open_ & F.col("_hit").isNull() & F.col("_at").isNotNull(), F.coalesce("now", "_at.sig")).alias("content_signature"),
    )
