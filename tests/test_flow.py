"""Discovery, review, requests, the store and crawls on literals; ids are those of the operator inventory."""

import json

import pytest
from pyspark.sql import functions as F

from sitewright import flow_queries
from sitewright.functions import genre as G
from sitewright.functions import text as T
from sitewright.functions import urls
from sitewright.operators import discovery, enrich, pages, requests, review, store, views
from sitewright.plans import crawl
from sitewright.sources import html, robots


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("http://0x7f.1/", "127.0.0.1"), ("http://0177.0.0.1/", "127.0.0.1"), ("http://1.2.3/", "1.2.0.3"), ("http://2130706433/", "127.0.0.1"), ("http://256.1.1.1/", None), ("http://1.2.3.4.5/", None),
        ("http://09.1.1.1/", None), ("https:a.com/x", "a.com"), ("https://a.com\\b", "a.com"), ("https://faß.de/", "xn--fa-hia.de"), ("http://[::FFFF:10.0.0.1]/", "[::ffff:a00:1]"), ("http://[::1%25a]/", None),
        ("http://[1:0:0:2:0:0:0:3]/", "[1:0:0:2::3]"), ("http://a b/", None), ("http://a.com:99999/", None), ("http://%41.com/", "a.com"), ("http://a.com:/", "a.com"), ("http://u@p@a.com/", "a.com"), ("http:///", None), ("http://a<b/", None),
    ],
)
def test_u1_hosts(url, host):
    got = urls.parse_url(url)
    assert (got and got["host"]) == host


@pytest.mark.parametrize(("url", "expected"), [("https:rel", "https://a.com/b/c/rel"), ("\\\\h\\p", "https://h/p"), ("//b.c", "https://b.c/"), ("?q=2", "https://a.com/b/c/d?q=2"), ("#f", "https://a.com/b/c/d"), ("http:x", "http://x/")])
def test_u1_relative_forms(url, expected):
    assert urls.parse_url(url, "https://a.com/b/c/d")["normal"] == expected


def test_u6_short_addresses_are_refused(spark):
    bad = ["http://0x7f.1/", "http://0177.0.0.1/", "http://2130706433/", "http://[::ffff:a00:1]/"]
    assert values(spark, bad, lambda c: urls.rejection(urls.parsed(c))) == ["Private or reserved IP ranges aren't allowed"] * 4


def test_s2_crawl_delay():
    got = [robots.rules(f"User-agent: *\nCrawl-delay: {x}")["crawl_delay"] for x in ("2s", "1.5 s", ".5", "x", "", "-1", "1e1x")]
    assert got == [2.0, 1.5, 0.5, None, None, -1.0, 10.0]


#: For each rule with a gap between marks, a text whose marks stand words apart.
GAPS = [
    ("landing_page", "our beta has a waitlist", 1), ("government", "department of public health. the city of x has many services", 9), ("academic_research", "faculty and their research. phd", 9), ("marketplace", "a marketplace with many sellers. become a host", 9),
    ("media_publication", "breaking news. subscriber-only", 30), ("community_forum", "posted by a at 3 days ago. forum with members", 9), ("social_platform", "followers and following. share a new photo or share a photo", 9),
    ("entertainment", "stream all the shows. album and its release", 9), ("nonprofit", "donate something today. a foundation with a mission", 9), ("corporate", "press release of the company. annual report", 9),
    ("personal", "i am a very good designer. hire me", 9), ("saas_product", "log in. pricing of all plans. book a demo", 9), ("marketing_site", "features and some integrations. contact sales", 9), ("event_site", "conference of 2031. keynote. call for papers", 9),
]


def test_x24_gaps_between_marks(spark):
    rows = [(i, text, [f"https://a.com/x{k}" for k in range(n)]) for i, (_, text, n) in enumerate(GAPS)]
    df = spark.createDataFrame(rows, "i int, h string, us array<string>").select("i", "h", F.posexplode("us").alias("pos", "url"))
    n = df.groupBy("i", "h").agg(F.struct(*G.counts()).alias("n")).select("i", G.genre(F.col("h"), F.col("n"), F.lit("a.com")).alias("g"))
    assert [r.g for r in n.orderBy("i").collect()] == [g for g, _, _ in GAPS]


def test_x24_marks_do_not_reach_over_lines(spark):
    df = spark.createDataFrame([("our beta\nhas a waitlist", "https://a.com/x"), ("our beta\u2028has a waitlist", "https://a.com/x")], "h string, url string").withColumn("pos", F.lit(1))
    got = df.groupBy("h").agg(F.struct(*G.counts()).alias("n")).select(G.genre(F.col("h"), F.col("n"), F.lit("a.com")).alias("g")).collect()
    assert [r.g for r in got] == ["generic", "generic"]


def test_js_white_space(spark):
    assert values(spark, ["\u00a0\u2003 a b\u2028\ufeff", "\u3000x\t\u0085"], T.trim) == ["a b", "x\t\u0085"]


def test_o4_home_is_the_root_of_the_host_alone(spark):
    rows = [(1, "https://a.com/"), (2, "https://a.com/sites/a.com"), (3, "https://b.com/")]
    df = spark.createDataFrame(rows, "pos long, url string").select(F.lit("s").alias("site"), "pos", "url", urls.parsed(F.col("url")).alias("u"), F.lit(50.0).alias("score"), F.lit(False).alias("is_optional"), F.lit("Docs").alias("section"), urls.parsed(F.lit("https://a.com/")).alias("base"))
    assert {r.pos for r in pages.select(df).collect()} == {2, 3}


def test_k11_names_that_meet(spark):
    names = ["a.txt", "a.txt", "a-2.txt", "a-2.txt", "b.txt", "a.txt", "c-2.txt"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r.file for r in store.export_names(df, "name", "i").orderBy("i").collect()]
    assert got == ["a.txt", "a-2.txt", "a-2-2.txt", "a-2-3.txt", "b.txt", "a-3.txt", "c-2.txt"]


def test_k10_exports_equal_a_loop(spark):
    d = "/root/testdata/sf0.001"
    got = flow_queries.export_files(spark, d).collect()
    per = {}
    for r in got:
        per.setdefault(r.user_id, []).append(r.file)
    assert got and all(len(set(v)) == len(v) <= 30 for v in per.values())


def test_s7_s16_gate(spark):
    big = b"x" * (discovery.MOST_BYTES + 1)
    rows = [("ok", 200, "text/html", None, b"<p>\xff</p>", None), ("cap", 200, "text/html", None, big[1:], None), ("big", 200, "text/html", None, big, None), ("bot", 200, "text/html", None, b"<title> Just a moment... </title>", None), ("x", None, None, None, None, "Timeout"), ("app", 200, "application/xhtml+xml", None, b"<a/>", None)]
    f = spark.createDataFrame(rows, "url string, status int, content_type string, content_length long, body binary, failure string")
    got = {r.url: (r.ok, r.error) for r in discovery.gated(f).select("url", "ok", "error").collect()}
    assert got == {"ok": (True, None), "cap": (True, None), "big": (False, "Response too large"), "bot": (False, "Bot challenge page"), "x": (False, "Timeout"), "app": (True, None)}


def test_s15_redirects(spark):
    rows = [("http://a.b/0", 301, "/1"), ("http://a.b/1", 302, "http://a.b/1"), ("http://a.b/loop", 301, "http://a.b/pool"), ("http://a.b/pool", 301, "/loop"), ("http://a.b/bad", 301, "http://[x/"), ("http://a.b/none", 301, None)]
    f = spark.createDataFrame(rows, "url string, status int, location string")
    got = {r.url[11:]: (r.final and r.final[11:], bool(r.error)) for r in discovery.redirected(f.select("url"), f).collect()}
    assert got == {"0": ("1", False), "1": ("1", False), "loop": (None, True), "pool": (None, True), "bad": ("bad", False), "none": ("none", False)}


def test_f7_picks(spark):
    q = spark.createDataFrame([("a", i, f"u{i}") for i in range(5)] + [("b", 0, "v0"), ("c", 0, "w0"), ("c", 1, "w1"), ("c", 2, "w2")], "site string, pos long, url string")
    p = spark.createDataFrame([("a", [5, 2, 5, 0, 9]), ("c", []), ("b", None)], "site string, indices array<int>")
    got = [(r.site, r.url) for r in discovery.picked(q, p, skip_below=2).orderBy("site", "pos").collect()]
    assert got == [("a", "u4"), ("a", "u1"), ("b", "v0")]  # T16: an empty list empties the queue


def test_x20_x21_answers(spark):
    p = spark.createDataFrame([("s", 0, 0, "u0", "T0", "old description", "meta"), ("s", 0, 1, "u1", "T1", None, "none")], "site string, batch int, at int, url string, title string, description string, description_provenance string")
    items = [{"section": "Docs", "importance": 6.5, "description": "old description", "label": "T0"}, {"section": "<x>", "description": "A {{new}} one is here"}, {"section": "more"}]
    a = spark.createDataFrame([("s", 0, "text " + json.dumps(items))], "site string, batch int, answer string")
    got = sorted(tuple(r) for r in enrich.rows(p, a).collect())
    assert got == [("s", "u0", "Docs", 7, "old description", "meta", None), ("s", "u1", None, 5, "A  one is here", "llm", None)]
    bad = spark.createDataFrame([("s", 0, "[not json]")], "site string, batch int, answer string")
    with pytest.raises(Exception, match="not JSON"):
        enrich.rows(p, bad).collect()
    assert enrich.rows(p, bad.withColumn("answer", F.lit("none"))).count() == 0


def test_f13_drops(spark):
    e = spark.createDataFrame([("a", f"u{i}") for i in range(10)] + [("b", f"v{i}") for i in range(5)] + [("c", f"w{i}") for i in range(6)], "site string, url string")
    d = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("b", "v1"), ("c", "w1")], "site string, url string")
    assert {r.url for r in review.safe_drops(d, e).collect()} == {"u1", "u2", "w1"}


def test_u28_u31(spark):
    assert values(spark, [" a.b ", "ftp://x", "", "HTTPS://y"], requests.typed_url) == ["https://a.b", "ftp://x", "", "HTTPS://y"]
    assert values(spark, ["/ok", "//x", "/\\x", "/a\tb", "/%5cx", None, "x"], requests.safe_next) == ["/ok", "/", "/", "/", "/", "/", "/"]
    assert values(spark, [None, "https://h:8080", "https://h", "x"], lambda c: requests.origin_allowed(c, F.lit("h:8080"))) == [True, True, False, False]


def test_t8_t9(spark):
    assert values(spark, ["crawling", "failed", "partial"], lambda c: views.next_visible(F.lit("assembling"), c)) == ["assembling", "failed", "partial"]
    assert values(spark, ["pending", "crawling", "failed", "complete"], lambda c: views.step_state(c, F.lit("crawling"))) == ["waiting", "active", "error", "done"]


def test_x5_x10_u23(spark):
    page = '<html><head><link rel="canonical" href="/c?x=1"><meta property="og:site_name" content="www.a.com"><title>Acme - Home</title><script type="application/ld+json">{"@graph": [{"description": "A description of the page."}]}</script></head></html>'
    assert html.extract(page)["desc_ld"] is None and html.extract(page, True)["desc_ld"] == "A description of the page."
    df = spark.createDataFrame([("a.com", 1, "https://a.com/b", page)], "site string, pos long, url string, html string").withColumn("u", urls.parsed(F.col("url")))
    (r,) = html.described(df).collect()
    assert (r.url, r.u.path, r.site_name) == ("https://a.com/c?x=1", "/c", "Acme")


def test_sql_functions(spark):
    from sitewright import sql

    sql.register(spark)
    r = spark.sql("SELECT url_normal('HTTP://A.com/x/?utm_source=1', NULL).normal AS u, html_parts('<title>T</title>').title_h1 AS h, robots_rules('User-agent: *\\nDisallow: /a').disallowed AS d").first()
    assert (r.u, r.h, r.d) == ("http://a.com/x", None, ["/a"])


def test_t10_updates_may_be_applied_twice(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    j = spark.createDataFrame([(1, "https://a.b/", "crawling", None, None, None)], "id long, page_url string, status string, genre string, site_name string, error string").withColumns({"created_at": at, "updated_at": at})
    p = spark.createDataFrame([], "url string, id string, result string, site_name string, genre string, crawled_pages string, last_checked_at timestamp_ntz, updated_at timestamp_ntz")
    up = spark.createDataFrame([(1, "complete", "blog", "A", None, "# A", "[]")], "id long, status string, genre string, site_name string, error string, result string, crawled_pages string")
    once = store.update_jobs(p, j, up, at)
    twice = store.update_jobs(*once, up, at)
    assert [sorted(map(tuple, df.collect())) for df in once] == [sorted(map(tuple, df.collect())) for df in twice]
    assert once[0].first().result == "# A" and once[1].first().status == "complete"


def _response(url, body, kind="text/html", status=200):
    return (url, status, kind, None, body.encode(), None, None)


def test_crawl(spark):
    """Rules, seeds, links of the home page and of pages, a Markdown sibling, a notice, a review."""
    page = '<html lang="en"><head><title>{0}</title><meta name="description" content="A long enough description of {0}."></head><body><h1>{0}</h1>{1}</body></html>'
    links = "".join(f'<a href="/docs/{k}">d</a>' for k in "abc")
    rows = [
        _response("https://a.test/", page.format("Home", links + '<a href="/private/x">p</a>')), _response("https://a.test/robots.txt", "User-agent: *\nDisallow: /private", "text/plain"),
        *(_response(f"https://a.test/docs/{k}", page.format(f"Doc {k}", '<a href="/guide/deep">g</a>')) for k in "ab"), _response("https://a.test/docs/c", "x", status=500),
        _response("https://a.test/guide/deep", page.format("Deep", '<a href="/never">n</a>')), _response("https://a.test/docs/a.md", "# A", "text/plain"),
        _response("https://b.test/", page.format("Other", "")), _response("https://b.test/robots.txt", "User-agent: *\nDisallow: /", "text/plain"),
    ]
    f = spark.createDataFrame(rows, "url string, status int, content_type string, content_length long, body binary, failure string, location string")
    sites = spark.createDataFrame([("a", "https://a.test"), ("b", "https://b.test/"), ("c", "https://c.test/")], "site string, base string")
    sitemaps = spark.createDataFrame([("a", 0, "https://a.test/docs/b?utm_source=x"), ("a", 1, "https://other.test/"), ("a", 2, "https://a.test/tag/x/"), ("b", 0, "https://b.test/x")], "site string, pos long, url string")
    rendered = spark.createDataFrame([], "url string, html string")
    c = crawl.crawl(sites, f, sitemaps, rendered)
    asked = [(r.url[14:], r.depth, r.ok) for r in c["asked"].where("site = 'a'").orderBy("pos").collect()]
    assert asked == [("/docs/b", 1, True), ("/docs/a", 1, True), ("/docs/c", 1, False), ("/guide/deep", 2, True)]
    assert {r.url: r.md_url for r in c["pages"].where("site = 'a'").collect()}["https://a.test/docs/a"] == "https://a.test/docs/a.md"
    assert [(r.site, r.error) for r in c["failed"].collect()] == [("c", "Failed to fetch homepage: browser render failed")]
    edits = {"relabel": [{"url": "https://a.test/docs/a.md", "label": "Start"}], "entry_order": [{"section": "Optional", "urls": ["https://a.test/guide/deep"]}]}
    answers = spark.createDataFrame([("a", json.dumps(edits))], "site string, answer string")
    names = spark.createDataFrame([("a", "Acme", "What Acme is, in a few words.")], "site string, site_name string, preamble string")
    out = {r.site: r for r in crawl.crawled_index(sites, f, sitemaps, rendered, names=names, answers=answers).collect()}
    assert out["a"].file.startswith("# Acme\n\n> A long enough description of Home.\n\nWhat Acme is, in a few words.\n\n## ")
    assert "- [Start](https://a.test/docs/a.md): A long enough description of Doc a." in out["a"].file and out["a"].n_faults == 0
    assert "> ⚠️ Note: This site's robots.txt disallows all crawling" in out["b"].file


def test_s14_pages_that_share_a_sibling(spark):
    """one row a page, whatever was answered to another page or twice; answers that name a page are that page's."""
    p = spark.createDataFrame([("a", 1, "https://a.test/x"), ("a", 2, "https://a.test/x?page=2")], "site string, pos long, url string").withColumn("u", urls.normalized(F.col("url")))
    p = p.withColumn("u", F.col("u").withField("query", F.lit("")))
    f = spark.createDataFrame([(1, "https://a.test/x.md", 200, "text/markdown"), (1, "https://a.test/x.md", 200, "text/markdown"), (2, "https://a.test/x.md", 200, "text/html")], "pos long, url string, status int, content_type string")
    f = f.withColumns({"body": F.encode(F.lit("x"), "utf-8"), "failure": F.lit(None).cast("string")})
    got = lambda **k: [(r.pos, r.md_url) for r in discovery.markdown_urls(p, f, **k).orderBy("pos").collect()]
    assert got(asked_by=["pos"]) == [(1, "https://a.test/x.md"), (2, None)]
    assert got() == [(1, "https://a.test/x.md"), (2, "https://a.test/x.md")]


def test_s5_more_addresses_than_a_crawl_takes(spark, tmp_path):
    """F8: a listing has all addresses of a site, of which a crawl takes the first 500."""
    spark.range(1200).select((F.col("id") * 2 + 2).alias("page_id"), F.concat(F.lit("https://a.test/p"), "id").alias("url"), F.lit("<p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert flow_queries.sitemap_listing(spark, str(tmp_path)).count() == 1200
    starts = spark.createDataFrame([("a", "u")], "site string, url string")
    f = spark.createDataFrame([("u", "".join(f"<loc>http://a/{k}</loc>" for k in range(600)))], "url string, body string")
    assert robots.sitemap_urls(starts, f).count() == 500


def test_s15_hops_are_dealt_by_url(spark):
    """no task holds the whole table of redirects, small as it may be on disk."""
    f = spark.createDataFrame([("https://a.test/1", 301, "/2"), ("https://a.test/2", 302, "/3")], "url string, status int, location string")
    out = discovery.redirected(f.select("url"), f)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.final, r.hops) for r in out.orderBy("url").collect()] == [("https://a.test/3", 2), ("https://a.test/3", 1)]
