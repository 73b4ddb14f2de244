"""Text functions as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the web platform counts it.
JS_WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def _all(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def trim(c: Column) -> Column:
    return _all(c, (rf"^[{JS_WS}]+|[{JS_WS}]+\z", ""))


def collapse(c: Column) -> Column:
    return trim(_all(c, (rf"[{JS_WS}]+", " ")))


def round_half_up(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("int")


def title_case(c: Column) -> Column:
    """First ASCII letter of each word in upper case, the rest as it is."""
    parts = F.regexp_extract_all(c, F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike(r"^[a-z]"), F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))).otherwise(w)), "")


def to_label(segment: Column) -> Column:
    return trim(title_case(_all(segment, ("[-_]+", " "))))


# What a title or a site name may end with.
_TAIL_WORDS = rf"(?i)[{JS_WS}]*(Home|Homepage|Welcome|Official Site|Official Website)[{JS_WS}]*\z"
_DASH_TAIL = rf"[{JS_WS}]+-[{JS_WS}]+\w[^-]{{0,40}}\z"


def clean_title(c: Column) -> Column:
    short = trim(_all(c, (rf"[{JS_WS}]+[|·•][{JS_WS}]+[^|·•]{{1,60}}\z", ""), (_DASH_TAIL, ""), (_TAIL_WORDS, "")))
    return F.when(short != "", short).otherwise(trim(c))


def clean_site_name(c: Column) -> Column:
    seps = "|·•—–"
    name = trim(_all(collapse(c), (rf"[{JS_WS}]+[{seps}][{JS_WS}]+[^{seps}]{{1,60}}\z", ""), (_DASH_TAIL, ""), (_TAIL_WORDS, "")))
    first = trim(F.element_at(F.split(name, rf"[{JS_WS}]*[{seps}][{JS_WS}]*"), 1))
    compound = (F.length(name) > 40) | name.rlike(f"[{seps}]")
    chosen = F.when(compound & F.length(first).between(2, 60), first).otherwise(name)
    return F.when(F.length(chosen).between(2, 60), chosen)


def looks_like_host(value: Column, host: Column) -> Column:
    """A name that is the host itself, a part of it at either end, or a bare domain."""
    low, bare = F.lower(value), F.regexp_replace(F.lower(host), r"^www\.", "")
    return bare.endswith(low) | low.endswith(bare) | low.rlike(r"^[\w-]+\.[a-z]{2,6}\z")


def site_name_from_host(host: Column) -> Column:
    return title_case(_all(F.element_at(F.split(_all(host, (r"^www\.", "")), r"\."), 1), ("-", " ")))


def normalize_html(c: Column) -> Column:
    """What a page's signature is taken of: no scripts, styles or comments, white space collapsed."""
    return collapse(_all(c, (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?s)<!--.*?-->", "")))


def neuter(c: Column) -> Column:
    # Fixed values, in this order: tags, [[..]], {{..}}, links to their text, backticks, line breaks.
    return trim(_all(c, ("<[^>]*>", ""), (r"(?s)\[\[.*?\]\]", ""), (r"(?s)\{\{.*?\}\}", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("`+", ""), (r"\r?\n", " ")))


def sanitize_section(c: Column, most: int = 30) -> Column:
    t = trim(c)
    return F.when((t != "") & (F.length(t) <= most) & t.rlike(r"^[\p{L}\p{N} \-&/]+\z"), t)


def sanitize_description(c: Column, most: int = 240) -> Column:
    t = trim(F.substr(neuter(c), F.lit(1), F.lit(most)))
    return F.when(F.length(t) >= 10, t)


def sanitize_label(c: Column, title: Column, most: int = 80) -> Column:
    t = trim(F.substr(neuter(c), F.lit(1), F.lit(most)))
    return F.when((t != "") & ~F.coalesce(t == trim(title), F.lit(False)), t)


def importance(c: Column) -> Column:
    return F.when(c.isNull(), 5).otherwise(F.least(F.greatest(round_half_up(c), F.lit(1)), F.lit(10)))


def home_summary(description: Column, provenance: Column) -> Column:
    """The home page's description where it comes from a source to be trusted."""
    return F.when((description != "") & provenance.isin("json_ld", "og", "meta", "llm"), description)


def first_sentence(excerpt: Column) -> Column:
    """The first sentence of 21 to 299 characters' worth, if the first match has that length."""
    # Sentences begin where one has ended: no other place of a run is tried.
    s = trim(F.regexp_extract(excerpt, r"(?<![^.!?\n])[^.!?\n]{20,}+[.!?]", 0))
    # An array of one, so that the sentence is looked for once.
    return F.element_at(F.transform(F.array(s), lambda x: F.when(F.length(x).between(21, 299), x)), 1)


# Public messages by what the raw one holds, in order.
_PUBLIC = (
    (lambda m: m.startswith("unsafe url") | m.contains("forbidden ip"), "This URL can't be crawled."),
    (lambda m: m.contains("http 403") | m.contains("bot challenge"), "This site blocked the crawler."),
    (lambda m: m.startswith("http "), "The site returned an error."),
    (lambda m: m.contains("timeout") | m.contains("timed out"), "The site took too long to respond."),
    (lambda m: m.contains("dns"), "Couldn't resolve that domain."),
    (lambda m: m.contains("browser render failed"), "Couldn't render this site."),
    (lambda m: m.contains("exceeded time budget"), "Crawl took longer than the budget allows."),
    (lambda m: m.contains("ai service is unavailable"), "AI service is unavailable. Please try again later."),
)


def public_error(c: Column) -> Column:
    m = F.lower(c)
    return F.coalesce(*(F.when(test(m), said) for test, said in _PUBLIC), F.lit("Couldn't generate a result for this site."))


def is_bot_challenge(html: Column) -> Column:
    low = F.lower(html)
    marks = reduce(lambda a, b: a | b, (low.contains(m) for m in ("cf-browser-verification", "cf_chl_opt", "__cf_chl_")))
    title = trim(F.lower(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1)))
    return marks | (low.contains("challenge-platform") & low.contains("cloudflare")) | title.rlike(
        r"^(just a moment\b|attention required|access denied|please wait\b|checking your browser|you have been blocked|please verify)"
    )


def is_spa_shell(html: Column, excerpt: Column) -> Column:
    n = F.length(trim(excerpt))
    mount = html.rlike(rf"""(?i)<div[{JS_WS}]+id=["'](?:root|app|__next|__nuxt|svelte)["'][^>]*>[{JS_WS}]*</div>""")
    hints = html.rlike(r"\bng-app\b|\bng-view\b|\bdata-ng-app\b|\bdata-reactroot\b|\bdata-react-helmet\b|\{\{[^}]{1,60}\}\}")
    return F.when((n < 100) & (mount | (F.length(html) > 5000)), True).when(n > 300, False).otherwise(hints)
