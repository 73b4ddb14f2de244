"""Page extraction (X1, X2, X4-X9, X12, U23): one parse of each page in an Arrow function, rules on its result native."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..plans.staging import materialize

# Fixed values of HTML and of what counts as boilerplate.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: What an end tag that is looked for further out does not go through.
_WALLS = frozenset("applet caption html marquee object table td template th".split())
_SPECIAL = _ENDS_P | _WALLS | frozenset("body button dd dt head li select tbody tfoot thead tr".split())
#: By start tag: open elements that it ends, and what it does not look beyond.
_ITEMS = {
    "li": (frozenset(["li"]), frozenset(["ol", "ul", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr"])), "th": (frozenset(["td", "th"]), frozenset(["tr"])), "tr": (frozenset(["tr"]), frozenset(["tbody", "thead", "tfoot"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset()), "thead": (frozenset(["tbody", "thead", "tfoot"]), frozenset()), "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset()),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"])), "a": (frozenset(["a"]), frozenset()), "button": (frozenset(["button"]), frozenset()),
}
_CELLS = frozenset("td th".split())
_OF_TABLES = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
_ROWS = frozenset("table tbody tfoot thead tr".split())
_MAIN_TAGS, _MAIN_CLASSES = {"main", "article"}, {"content", "post-content", "entry-content"}
_BOILERPLATE_TAGS = frozenset("script style nav footer header form".split())
_BOILERPLATE_CLASSES = frozenset("sidebar menu nav cookie banner".split())
_HIDDEN_CLASSES = frozenset("sr-only visually-hidden visuallyhidden screen-reader-text a11y-hidden".split())
_UNSEEN = frozenset(("script", "style", "noscript"))
EXCERPT_BYTES = 4096
#: The first sentence of a text, as ``T.first_sentence`` finds it.
_SENTENCE = re.compile(r"(?<![^.!?\n])[^.!?\n]{20,}+[.!?]")


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.items = tag, attrs, []

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(x for x in reversed(n.items) if isinstance(x, Node))

    def text(self, leave_out=lambda n: False) -> str:
        out, stack = [], [iter(self.items)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    out.append(x)
                elif not leave_out(x):
                    stack.append(iter(x.items))
                    break
            else:
                stack.pop()
        return "".join(out)


class _Builder(HTMLParser):
    """The tree that a browser builds, as far as texts and their places go: elements that others end, end tags that stop at the
    block they stand in, formatting that is ended across blocks, and what stands between the cells of a table put before it.

    Not rebuilt are copies of formatting elements that a browser makes in later blocks: they change no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _find(self, tags: frozenset[str], walls: frozenset[str]) -> int | None:
        """The place of the innermost open element of these, if no wall is before it."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                return k
            if tag in walls:
                return None
        return None

    def _end(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        k = self._find(tags, walls)
        if k is not None:
            del self.open[k:]

    def _add(self, item: Node | str) -> None:
        """Put an item where it belongs: into the innermost element, or before the table that it cannot stand in."""
        inner = self.open[-1]
        if inner.tag not in _ROWS or (isinstance(item, Node) and item.tag in _OF_TABLES | _UNSEEN | {"template"}) or (isinstance(item, str) and not item.strip()):
            inner.items.append(item)
            return
        k = max(i for i, n in enumerate(self.open) if n.tag == "table" or i == 0)
        outer = self.open[k - 1] if k else inner
        at = next((i for i in range(len(outer.items) - 1, -1, -1) if outer.items[i] is self.open[k]), len(outer.items))
        outer.items.insert(at, item)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "head", "body") and self._find(frozenset([tag]), frozenset()) is not None:
            return
        if tag in _OF_TABLES and self._find(frozenset(["table"]), frozenset(["template"])) is None:
            return
        if tag in _ENDS_P:
            self._end(frozenset(["p"]), _WALLS | {"button"})
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self.open.pop()
        if tag == "body":
            self._end(frozenset(["head"]), frozenset())
        if tag in _ITEMS:
            ends, walls = _ITEMS[tag]
            if tag == "a":
                self._close_across(tag)
            else:
                if tag in _OF_TABLES and tag not in _CELLS:
                    self._end(_CELLS, frozenset(["table"]))
                    if tag != "tr":
                        self._end(frozenset(["tr"]), frozenset(["table"]))
                self._end(ends, walls | ((_WALLS - ends) if tag not in _OF_TABLES else frozenset(["table"])))
            if tag in ("li", "dt", "dd"):
                self._end(frozenset(["p"]), _WALLS | {"button"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self._add(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # Only elements of drawings and formulas end so.
        if tag not in _VOID and self._find(frozenset(["svg", "math"]), frozenset()) is not None:
            self.open.pop()

    def _close_across(self, tag: str) -> None:
        """End a formatting element; blocks that were opened in it stay open."""
        k = self._find(frozenset([tag]), _WALLS)
        if k is not None:
            inner = [n for n in self.open[k + 1 :] if n.tag in _SPECIAL]
            self.open[k:] = self.open[k + 1 :] if inner else []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in _FORMATTING:
            self._close_across(tag)
        elif tag in _HEADINGS:
            self._end(_HEADINGS, _WALLS)
        elif tag in _OF_TABLES or tag == "table":
            self._end(frozenset([tag]), frozenset(["table"]) - {tag})
        elif tag in _SPECIAL:
            self._end(frozenset([tag]), (_WALLS | {"button"} if tag == "p" else _WALLS | {"ol", "ul"} if tag == "li" else _WALLS) - {tag})
        else:
            self._end(frozenset([tag]), _SPECIAL)

    def handle_data(self, data: str) -> None:
        self._add(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _squeeze(s: str) -> str:
    return " ".join(s.split())


def _boilerplate(n: Node) -> bool:
    return n.tag in _BOILERPLATE_TAGS or n.tag in _UNSEEN or bool(n.classes() & _BOILERPLATE_CLASSES)


def _hidden(n: Node) -> bool:
    return bool(n.classes() & _HIDDEN_CLASSES) or n.attrs.get("aria-hidden") == "true" or "hidden" in n.attrs


def _main(n: Node) -> bool:
    return n.tag in _MAIN_TAGS or n.attrs.get("role") == "main" or bool(n.classes() & _MAIN_CLASSES) or n.attrs.get("id") == "content"


def _json_names(found: list[Node]) -> str | None:
    for node in found:
        try:
            data = json.loads(node.text())
        except ValueError:
            continue
        graph = data.get("@graph", [data]) if isinstance(data, dict) else data if isinstance(data, list) else []
        for item in graph:
            if isinstance(item, dict):
                publisher = item.get("publisher")
                for name in (item.get("name"), publisher.get("name") if isinstance(publisher, dict) else None):
                    if isinstance(name, str) and 0 < len(name) <= 300:
                        return name
    return None


def _json_description(found: list[Node]) -> str | None:
    """The first description of more than 20 characters in JSON-LD."""
    for node in found:
        try:
            data = json.loads(node.text())
        except ValueError:
            continue
        graph = data.get("@graph") if isinstance(data, dict) else None
        for item in graph if isinstance(graph, list) else [data]:
            said = item.get("description") if isinstance(item, dict) else None
            if isinstance(said, str) and len(said) > 20:
                return said
    return None


def extract(html: str | None, json_ld: bool = False) -> dict:
    """Raw candidates of a page. JSON-LD gives names; descriptions only if ``json_ld`` asks for them, since the service drops
    scripts before it looks there (T1)."""
    root = tree(html or "")
    nodes = [n for n in root.walk()]
    by: dict[str, list[Node]] = {}
    for n in nodes:
        by.setdefault(n.tag, []).append(n)
    metas: dict[str, str] = {}
    for m in by.get("meta", ()):
        key = m.attrs.get("property") or m.attrs.get("name")
        if key and "content" in m.attrs:
            metas.setdefault(key, m.attrs["content"].strip())
    head = next(iter(by.get("head", ())), None)
    # Without a tag the head begins with what only it may hold.
    above = head or next(iter(by.get("html", ())), root)
    title = next((n for n in above.items if isinstance(n, Node) and n.tag == "title"), None)
    h1 = next(iter(by.get("h1", ())), None)
    source = next((n for n in nodes if _main(n)), None) or next(iter(by.get("body", ())), root)
    heads = [n.text(lambda x: x.tag in _UNSEEN).strip() for n in nodes if n.tag in ("h1", "h2", "h3")][:10]
    text = _squeeze(source.text(_boilerplate))
    excerpt = text.encode()[:EXCERPT_BYTES].decode(errors="ignore")
    sentence = _SENTENCE.search(text)
    links = [n for n in by.get("link", ()) if "canonical" in n.attrs.get("rel", "").split()]
    h2 = next(iter(by.get("h2", ())), None)
    return {
        "title_og": metas.get("og:title"), "title_tag": title.text().strip() if title else None,
        "title_h1": _squeeze(h1.text(_hidden)) if h1 else None, "lang": next((n.attrs["lang"] for n in by.get("html", ()) if n.attrs.get("lang")), None),
        "canonical": links[0].attrs.get("href") if links else None, "desc_og": metas.get("og:description"), "desc_meta": metas.get("description"),
        "h2": h2.text().strip() if h2 else None, "headings": list(dict.fromkeys(h for h in heads if h)), "excerpt": excerpt,
        "sentence": sentence[0] if sentence else None,
        "desc_ld": _json_description([n for n in by.get("script", ()) if n.attrs.get("type") == "application/ld+json"]) if json_ld else None,
        "name_og": metas.get("og:site_name"), "name_app": metas.get("application-name"),
        "name_ld": _json_names([n for n in by.get("script", ()) if n.attrs.get("type") == "application/ld+json"]),
        "anchors": [{"href": n.attrs["href"], "text": _squeeze(n.text())[:120]} for n in by.get("a", ()) if n.attrs.get("href")],
    }


RAW = (
    "title_og string, title_tag string, title_h1 string, lang string, canonical string, desc_og string, desc_meta string, h2 string, "
    "headings array<string>, excerpt string, sentence string, desc_ld string, name_og string, name_app string, name_ld string, anchors array<struct<href:string,text:string>>"
)


#: Pages whose results a worker holds before it hands them on, and pages that it is handed at once.
FEW, MOST = 32, 256


def _extract(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A batch of pages is answered in several small ones: what is found in pages may take many times their bytes."""
    for s in pages:
        for k in range(0, len(s), FEW):
            yield pd.DataFrame([extract(x) for x in s.iloc[k : k + FEW]])


def raw(html: Column) -> Column:
    """What ``extract`` finds. Whole pages go to Python in batches, which a worker holds in full: MOST rows instead of Spark's ten
    thousand, unless the session says otherwise."""
    spark, name = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(MOST))
    return F.pandas_udf(_extract, RAW)(html)


def described(pages: DataFrame) -> DataFrame:
    """Adds title, description, its provenance, headings, excerpt, lang and site-name candidates to (.., url, u, html)."""
    df = materialize(pages.withColumn("x", raw(F.col("html"))).drop("html"), "extracted")
    title = F.coalesce(*(F.when(T.trim(F.col(c)) != "", T.clean_title(T.trim(F.col(c)))) for c in ("x.title_og", "x.title_tag", "x.title_h1")))
    df = df.withColumn("title", F.coalesce(F.nullif(title, F.lit("")), urls.title_from(F.col("url"), F.col("u"))))
    usable = lambda c: F.when(F.length(c) > 20, F.col(c))
    sentence = T.first_sentence(F.col("x.sentence"))  # of the whole text, which an excerpt may end before
    h2 = F.when(F.length("x.h2").between(11, 199), F.col("x.h2"))
    sources = {"json_ld": usable("x.desc_ld"), "og": usable("x.desc_og"), "meta": usable("x.desc_meta"), "excerpt": sentence, "heading": h2}
    df = df.withColumn("description", F.coalesce(*sources.values()))
    where = F.coalesce(*(F.when(c.isNotNull(), name) for name, c in sources.items()), F.lit("none"))
    df = df.withColumn("description_provenance", where).withColumn("lang", F.col("x.lang")).withColumn("headings", F.col("x.headings"))
    og = F.when(~T.looks_like_host(F.col("x.name_og"), F.col("u.host")), F.col("x.name_og"))
    name = F.coalesce(T.clean_site_name(og), *(T.clean_site_name(F.col(c)) for c in ("x.name_app", "x.name_ld", "x.title_tag", "x.title_h1")))
    df = df.withColumn("body_excerpt", F.col("x.excerpt")).withColumn("site_name", F.coalesce(name, T.site_name_from_host(F.col("u.host"))))
    # A page is known by its canonical address, if it names one.
    named = F.length("x.canonical") > 0
    at = F.coalesce(urls.written(F.col("_c")), F.col("x.canonical"))
    df = df.withColumn("_c", F.when(named, urls.parsed(F.col("x.canonical"), F.col("url")))).withColumn("url", F.when(named, at).otherwise(F.col("url")))
    return df.withColumn("u", F.when(named, F.col("_c")).otherwise(F.col("u"))).drop("_c")


def anchors(pages: DataFrame) -> DataFrame:
    """(site, page_url, at, href, text, u): every link, resolved against its page."""
    a = pages.select("site", F.col("url").alias("page_url"), F.posexplode(raw(F.col("html"))["anchors"]).alias("at", "a"))
    a = a.where(~F.lower("a.href").rlike(r"^(mailto:|tel:|javascript:|#)"))
    return a.select("site", "page_url", "at", "a.href", "a.text", urls.parsed(F.col("a.href"), F.col("page_url")).alias("u"))
