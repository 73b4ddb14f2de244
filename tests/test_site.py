"""Site-index operators on literals; ids are those of the operator inventory."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sitewright import queries as site
from sitewright.functions import text as T
from sitewright.functions import urls
from sitewright.functions.genre import counts, genre
from sitewright.operators import pages, store
from sitewright.plans import site_index
from sitewright.sources import html, robots
from sitewright.streaming import rate_limit


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://User:pw@Example.COM/Docs/?utm_source=a&x=1#frag", "https://example.com/Docs?x=1"), ("http://a.com", "http://a.com/"), ("ftp://a.com/", None), ("javascript:x", None),
        ("not a url", None), ("https://a.com:443/b//", "https://a.com/b"), ("https://a.com/a/../b/./c", "https://a.com/b/c"), ("https://a.com/?GCLID=1", "https://a.com/"), ("https://a.com/für", "https://a.com/f%C3%BCr"),
    ],
)
def test_u1_normalize(url, expected):
    got = urls.parse_url(url)
    assert (got and got["normal"]) == expected
    assert not expected or urls.parse_url(expected)["normal"] == expected


def test_u1_relative():
    assert urls.parse_url("../x?y=1", "https://a.com/b/c/d")["normal"] == "https://a.com/b/x?y=1"


def test_u4_skip(spark):
    bad = ["https://a.com/x.PNG", "https://a.com/wp-admin/", "https://a.com/feedback", "https://a.com/?page=2", "https://a.com/?v=abcdef", "https://a.com/posts/123456", "https://a.com/@jane", "https://a.com/shorts/x", "::", "https://a.com/x/3f2504e0-4f89-11d3-9a0c-0305e82c3301"]
    good = ["https://a.com/", "https://a.com/docs?page=2", "https://a.com/blog/first-post", "https://a.com/?v=abc"]
    assert values(spark, bad + good, lambda c: urls.skipped(urls.parsed(c))) == [True] * len(bad) + [False] * len(good)


def test_u6_rejections(spark):
    got = values(spark, ["https://example.com/x", "http://a.b:8080/", "http://10.1.2.3/", "http://[::ffff:10.0.0.1]/", "http://asdf/", "http://x.localhost/"], lambda c: urls.rejection(urls.parsed(c)))
    assert [g is None for g in got] == [True] + [False] * 5


def test_u7_u8_ranges(spark):
    v4 = ["10.0.0.1", "100.64.0.1", "168.63.129.16", "169.254.169.254", "172.31.0.1", "224.0.0.1", "x", "1.2.3", "8.8.8.8", "172.32.0.1"]
    assert values(spark, v4, urls.forbidden_ipv4) == [True] * 8 + [False] * 2
    v6 = ["::", "::1", "fe80::1", "fd00::1", "ff02::1", "::ffff:10.0.0.1", "::ffff:a00:1", "fe81::1", "2606:4700::1"]
    assert values(spark, v6, urls.forbidden_ipv6) == [True] * 7 + [False] * 2  # T10: fe81 is let through


def test_u17_labels(spark):
    assert values(spark, ["getting-started", "iOS_SDK", "foo__bar--baz"], T.to_label) == ["Getting Started", "IOS SDK", "Foo Bar Baz"]


def test_x3_x11_titles(spark):
    assert values(spark, ["Quick start | Next.js Docs", "Quick start - Next.js", "React — A JS Library", "Home", "Acme Homepage"], T.clean_title) == ["Quick start", "Quick start", "React — A JS Library", "Home", "Acme"]
    assert values(spark, ["Stripe | Financial Infrastructure", "Ab · B · C", "x", None], T.clean_site_name) == ["Stripe", "Ab", None, None]


def test_x15_neuter(spark):
    assert values(spark, ["<b onload=x>a</b> [[s]] {{t}} [text](http://x) `c`\nd"], T.neuter) == ["a   text c d"]


def test_t2_importance(spark):
    got = values(spark, [float(x) for x in range(1, 11)], lambda c: T.round_half_up((c - 5.5) * 5), "double")
    assert got == [-22, -17, -12, -7, -2, 3, 8, 13, 18, 23]


def test_s2_robots():
    r = robots.rules("User-agent: *\nDisallow: /a\nCrawl-delay: 2\n\nUser-agent: LlmsTxtGenerator\nDisallow: /b\nDisallow:\nSitemap: https://x/s.xml\nAllow: /")
    assert r == {"disallowed": ["/b"], "sitemaps": ["https://x/s.xml"], "crawl_delay": None}
    assert robots.rules("User-agent: *\nDisallow: /a\n\nDisallow: /c")["disallowed"] == ["/a"]
    assert robots.rules(None)["disallowed"] == []


def test_s5_sitemaps(spark):
    starts = spark.createDataFrame([("a", "u0")], "site string, url string")
    fetches = spark.createDataFrame([("u0", "<sitemapindex><sitemap><loc>u1</loc></sitemap><sitemap><loc>u2</loc></sitemap></sitemapindex>"), ("u1", "<urlset><url><loc> http://a/p1/ </loc></url><url><loc>http://a/?q=2&amp;x</loc></url><url><loc>::</loc></url>"), ("u2", "broken <loc>http://a/p3</loc> <")], "url string, body string")
    assert [r.url for r in robots.sitemap_urls(starts, fetches).orderBy("pos").collect()] == ["http://a/p1", "http://a/?q=2&x", "http://a/p3"]
    kinds = fetches.withColumn("content_type", F.when(F.col("url") == "u2", "image/png").otherwise("application/xml"))
    assert robots.sitemap_urls(starts, kinds).count() == 2


def test_x1_html():
    page = """<html lang="en"><head><title>T &amp; U</title><meta property="og:title" content=" O "><script>var a = "</p>";</script></head>
      <body><nav><a href="/x">skip</a></nav><h1>Hi <span class="sr-only">hidden</span>there</h1><main><p>One <b>bold<p>Two</main><footer>no</footer></body></html>"""
    x = html.extract(page)
    assert (x["title_og"], x["title_tag"], x["title_h1"], x["lang"], x["excerpt"]) == ("O", "T & U", "Hi there", "en", "One boldTwo")
    assert x["anchors"] == [{"href": "/x", "text": "skip"}] and x["headings"] == ["Hi hiddenthere"]


def test_x24_genre(spark):
    rows = [("add to cart free shipping", ["https://a.com/"] * 6, "a.com"), ("x", ["https://a.com/docs"] * 9, "a.com"), ("x", ["https://a.gov/"], "a.gov"), ("coming soon", ["https://a.com/"], "a.com"), ("nothing", ["https://a.com/x"] * 9, "a.com")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, us array<string>, host string")
    n = df.select("i", "h", "host", F.posexplode("us").alias("pos", "url")).groupBy("i", "h", "host").agg(F.struct(*counts()).alias("n"))
    assert [r.g for r in n.select("i", genre(F.col("h"), F.col("n"), F.col("host")).alias("g")).orderBy("i").collect()] == ["ecommerce_store", "developer_docs", "government", "landing_page", "generic"]


def test_o12_validation(spark):
    good = "# A\n\n> s\n\n## Docs\n\n- [x](https://a.com/): d\n\n## Optional\n\n- [y](https://a.com/y)\n"
    files = spark.createDataFrame([("good", good), ("empty", ""), ("bad", "# A\n# B\n## Optional\n## X\n- plain\n- [z](/rel)\n### H\n")], "site string, file string")
    got = {}
    for r in pages.validate(files).collect():
        got.setdefault(r.site, set()).add(r.rule)
    assert got == {"empty": {"V1"}, "bad": {"V2", "V3", "V5", "V7", "V8", "V9", "V11"}}


def test_k1_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "url string, id int, result string")
    new = spark.createDataFrame([("a", 9, None), ("c", 3, "z")], "url string, id int, result string")
    assert sorted(map(tuple, store.upsert(old, new, "url", keep=("id",)).collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")]


def test_t1_bucket(spark):
    ev = spark.createDataFrame(pd.DataFrame({"key": ["a"] * 4, "event": range(4), "ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 01:00:00", "2024-01-01 01:00:01"])}))
    out = rate_limit.admit(ev, "key", F.col("ts"), "event", 1, 1 / 3600).orderBy("event").collect()
    assert [(r.allowed, r.retry_s) for r in out] == [(True, None), (False, 3599), (True, None), (False, 3599)]


def test_t1_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limit.admit_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), 1, 1 / 86400)
    q = stream.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.event): r.allowed for r in spark.table("admitted").collect()}
    batch = rate_limit.admit(ev, "key", F.col("ts"), "event", 1, 1 / 86400)
    assert got == {(r.key, r.event): r.allowed for r in batch.collect()} and sum(got.values()) == 313


def test_f9_x25_home_description(spark):
    page = '<html lang="en"><head><title>{0}</title><meta name="description" content="{1}"></head><body><h1>{0}</h1><p>Some text of the page.</p></body></html>'
    tagline = "The one tagline that many pages of this site repeat."
    rows = [(1, "https://a.test/", page.format("Home page", tagline)), (2, "https://a.test/docs/x", page.format("Guide", f" {tagline} ")), (3, "https://a.test/docs/y", page.format("Other", "A description that only this page has."))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.pos: r for r in site_index.scored(pages).collect()}
    assert [(got[k].description is None, got[k].description_provenance) for k in (1, 2, 3)] == [(False, "meta"), (True, "none"), (False, "meta")]
    assert got[3].score - got[2].score == 25
    (site,) = site_index.build_index(pages).collect()
    assert f"\n\n> {tagline}\n\n" in site.file and site.file.count(tagline) == 1 and site.n_faults == 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.n_faults == 0 for r in rows)


def test_w1_plan_prunes_before_the_shuffle(spark):
    plan = __spark_entry__.queries()["latest_job"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", sorted(site.oracle_sql()))
def test_queries_equal_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "documents", "part", "events", "orders", "customer", "nation", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = site.queries()[name](spark, d)
    cols = sorted(df.columns)
    want = con.sql(site.oracle_sql()[name])
    order = [want.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[k] for k in order)) for r in want.fetchall()) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def _page_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_cut_references_are_text_in_queries(spark, tmp_path):
    """a title that ends within a reference, which SQL leaves as it is; the extraction itself reads it as a browser does."""
    page = "<html lang='en'><head><title>a&amp;b &amp;&amp</title></head><body><article><h1>a &lt; b &amp</h1></article></body></html>"
    d = _page_table(spark, tmp_path, [(1, "https://a.com/", page)])
    assert site.html_lang_title(spark, d).first().title == "a&b &&amp"
    assert html.extract(page)["title_tag"] == "a&b &&"


def test_first_sentence_behind_the_excerpt(spark, tmp_path):
    """A page's description is the first sentence of its whole text, also where its excerpt ends before it."""
    said = "Here at last stands a sentence of the page."
    page = f"<html lang='en'><head><title>T</title></head><body><article><h1>T</h1><p>{'AB!! ' * 1000}</p><p>{said}</p></article></body></html>"
    d = _page_table(spark, tmp_path, [(1, "https://a.com/x", page)])
    row = site.page_titles(spark, d).first()
    assert (row.description, row.description_provenance) == (said, "excerpt")
    assert site.scored_sections(spark, d).first().score == 45 - 17
    assert said in site.site_indexes_enriched(spark, d).first().file
    assert len(html.extract(page)["excerpt"]) == html.EXCERPT_BYTES


def test_extraction_in_small_batches(spark):
    """neither pages nor what is found in them wait in a worker by the ten thousand."""
    found = list(html._extract(iter([pd.Series(["<p>a</p>", None] * 50), pd.Series([], dtype=object)])))
    assert max(map(len, found)) <= html.FEW and sum(map(len, found)) == 100
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        assert values(spark, ["<p>x</p>"] * 600, lambda c: html.raw(c)["excerpt"]) == ["x"] * 600
        assert int(spark.conf.get(name)) == html.MOST
    finally:
        spark.conf.set(name, before)
