"""URL functions (U1-U27). One Arrow function parses; everything else is Catalyst expressions over its struct."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_case, to_label, trim

# Fixed values.
TRACKING_PARAMS = frozenset(
    "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid _ga mc_cid mc_eid ref source from via hl gl lang "
    "locale lng ln continue followup passive ec flowname flowentry service state redirect_uri redirect_url return_url returnurl "
    "returnto next dsh emr osid ifkv".split()
)
SKIP_EXTENSIONS = "jpg jpeg png gif svg webp ico pdf zip gz tar mp4 mp3 wav woff woff2 ttf eot css js map".split()
SKIP_PATHS = ("/cdn-cgi/", "/wp-login", "/wp-admin", "/wp-json", "/.well-known/", "/feed", "/rss", "/atom")
CONTENT_PARAMS = ("v", "id", "postid", "p", "article_id", "video_id")
LOCALES = (
    "ar bg bn cs da de el en es et fa fi fr gu he hi hr hu id is it ja kn ko lt lv ml mr ms nl no pa pl pt ro ru sk sl sv sw ta te "
    "th tl tr ur vi zh"
).split()
_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}

URL = "scheme string, host string, port string, path string, query string, params array<struct<k:string,v:string>>, normal string"


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        if low == "..":
            if out:
                out.pop()
        elif low != ".":
            out.append(part)
            continue
        if k == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")
_FORBIDDEN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")


def _number(part: str) -> int | None:
    """A part of an IPv4 address: decimal, octal with a leading 0, or hexadecimal with 0x."""
    base = 16 if part[:2].lower() == "0x" else 8 if len(part) > 1 and part[0] == "0" else 10
    digits = part[2:] if base == 16 else part[1:] if base == 8 else part
    if not digits:
        return 0 if base != 10 else None
    return int(digits, base) if re.fullmatch({16: "[0-9A-Fa-f]+", 8: "[0-7]+", 10: "[0-9]+"}[base], digits) else None


def _ipv4(host: str) -> str | None:
    """The address of a host whose last part is a number; ValueError if it has none."""
    parts = host.split(".")
    if len(parts) > 1 and parts[-1] == "":
        parts.pop()
    if not (parts[-1].isascii() and parts[-1].isdigit() or re.fullmatch("0[xX][0-9A-Fa-f]*", parts[-1])):
        return None
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        raise ValueError(host)
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(host: str) -> str:
    groups = [int.from_bytes(ipaddress.IPv6Address(host).packed[k : k + 2]) for k in range(0, 16, 2)]
    zeros = max((m.span() for m in re.finditer("0+", "".join("0" if g == 0 else "1" for g in groups))), key=lambda s: (s[1] - s[0], -s[0]), default=(0, 0))
    text = [f"{g:x}" for g in groups]
    if zeros[1] - zeros[0] < 2:
        return ":".join(text)
    return ":".join(text[: zeros[0]]) + "::" + ":".join(text[zeros[1] :])


def _host(raw: str) -> str:
    """A host as browsers write it; ValueError if it isn't one."""
    if raw.startswith("["):
        if not raw.endswith("]") or "%" in raw:
            raise ValueError(raw)
        return f"[{_ipv6(raw[1:-1])}]"
    host = unicodedata.normalize("NFKC", unquote(raw, errors="strict").lower()).lower().replace("\u3002", ".").replace("\u00AD", "")
    if not host.isascii():  # sharp s and final sigma stay letters of their own
        host = ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in host.split("."))
    if not host or _FORBIDDEN.search(host):
        raise ValueError(raw)
    return _ipv4(host) or host


def _split(text: str, base: str | None) -> tuple[str, str, str, str]:
    """(scheme, authority, path, query) of a URL, relative ones taken at their base; without a fragment."""
    text = text.split("#", 1)[0]
    found = _SCHEME.match(text)
    scheme = found[1].lower() if found else None
    rest = text[found.end() :] if found else text
    head, mark, query = rest.partition("?")
    base_scheme = _SCHEME.match(base)[1].lower() if base and _SCHEME.match(base) else None
    if (scheme or base_scheme) in _PORTS:
        head = head.replace("\\", "/")
    if scheme and scheme not in _PORTS:
        return scheme, "", head, query
    if scheme and (scheme != base_scheme or head.startswith("/")):
        authority, _, path = head.lstrip("/").partition("/")
        return scheme, authority, "/" + path, query
    if not base_scheme:
        raise ValueError(text)
    if not scheme and head.startswith("//"):
        authority, _, path = head.lstrip("/").partition("/")
        return base_scheme, authority, "/" + path, query
    return _split(urljoin(base, head + mark + query), None)


def parse_url(url: str | None, base: str | None = None) -> dict | None:
    """The parts of an absolute URL, percent-encoded as browsers do, and its normal form (http and https only); None if
    it cannot be parsed."""
    if url is None:
        return None
    try:
        text = url.strip("".join(map(chr, range(33)))).replace("\t", "").replace("\n", "").replace("\r", "")
        scheme, authority, path, raw_query = _split(text, base)
        if scheme not in _PORTS:
            return {"scheme": scheme, "host": "", "port": "", "path": path, "query": raw_query, "params": [], "normal": None}
        place = authority.rpartition("@")[2]
        name, digits = re.fullmatch(r"(\[.*\]|[^:]*)(?::(.*))?", place).groups()
        host = _host(name)
        if digits and not (digits.isascii() and digits.isdigit() and int(digits) < 65536):
            return None
        port = "" if not digits or int(digits) == _PORTS[scheme] else str(int(digits))
        path = _dots(quote(path, safe="!$%&'()*+,/:;=@[]^_|~-."))
        query = quote(raw_query, safe="!$%&()*+,/:;=?@[]^_`{|}~-.\\")
        params = parse_qsl(raw_query, keep_blank_values=True)
        kept = [p for p in params if p[0].lower() not in TRACKING_PARAMS]
        clean = urlencode(kept, safe="*-._") if len(kept) < len(params) else query
        bare = path.rstrip("/") or "/"
        normal = f"{scheme}://{host}{':' + port if port else ''}{bare}{'?' + clean if clean else ''}" if scheme in ("http", "https") else None
        return {"scheme": scheme, "host": host, "port": port, "path": path, "query": query, "params": [{"k": k, "v": v} for k, v in params], "normal": normal}
    except (ValueError, UnicodeError, AttributeError):
        return None


_COLUMNS = ["scheme", "host", "port", "path", "query", "params", "normal"]


def _parse(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for urls, bases in parts:
        yield pd.DataFrame([parse_url(u, b) or dict.fromkeys(_COLUMNS) for u, b in zip(urls, bases, strict=True)], columns=_COLUMNS)


def parsed(url: Column, base: Column | None = None) -> Column:
    """The URL's struct; its fields are null if it cannot be parsed. Project it once and reuse it."""
    return F.pandas_udf(_parse, URL)(url, base if base is not None else F.lit(None).cast("string"))


def _parse_normal(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for urls, bases in parts:
        first = (parse_url(u, b) for u, b in zip(urls, bases, strict=True))
        yield pd.DataFrame([parse_url(u["normal"]) if u and u["normal"] else dict.fromkeys(_COLUMNS) for u in first], columns=_COLUMNS)


def normalized(url: Column, base: Column | None = None) -> Column:
    """The struct of a URL's normal form, in one pass; its fields are null if it has none."""
    return F.pandas_udf(_parse_normal, URL)(url, base if base is not None else F.lit(None).cast("string"))


def written(u: Column) -> Column:
    """A parsed URL put together again, parameters and a closing slash kept."""
    return F.concat(origin(u), u["path"], F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(""))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    """U3, on two structs."""
    return F.coalesce(bare_host(a["host"]) == bare_host(b["host"]), F.lit(False))


def flip_www(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://www\."), F.regexp_replace(url, r"^(https?://)www\.", "$1")).otherwise(F.regexp_replace(url, r"^(https?://)", "$1www."))


def has_param(u: Column, name: str) -> Column:
    return F.exists(u["params"], lambda p: p["k"] == name)


def skipped(u: Column) -> Column:
    """U4: not a structural page. The rules are one disjunction; what cannot be parsed is skipped."""
    path = F.lower(u["path"])
    rules = path.rlike(
        rf"\.({'|'.join(SKIP_EXTENSIONS)})\z|/page/\d+|/print/|/(tag|category|author|archive)/|/[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}"
        r"|/\d{6,}(/|\z)|^/(user|users|u|profile|profiles|member|members)/|^/@[^/]|/(shorts|clips?|reels?|watch)\b"
    )
    for part in SKIP_PATHS:
        rules = rules | path.contains(part)
    first = lambda name: F.try_element_at(F.filter(u["params"], lambda p: p["k"] == name), F.lit(1))["v"]
    rules = rules | (has_param(u, "page") & ~path.contains("/docs")) | has_param(u, "print")
    for name in CONTENT_PARAMS:
        rules = rules | F.coalesce(F.length(first(name)) >= 6, F.lit(False))
    return F.coalesce(rules, F.lit(True))


def segments(u: Column) -> Column:
    """Path segments without blanks and index files."""
    return F.filter(F.split(u["path"], "/"), lambda s: (s != "") & ~s.rlike(r"(?i)^index\.(html?|php|aspx?)\z"))


def depth(u: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(u["path"], "/"), lambda s: s != "")), F.lit(2147483647))


def last_label(u: Column) -> Column:
    """U16."""
    return to_label(F.regexp_replace(F.try_element_at(segments(u), F.lit(-1)), r"\.[^.]+\z", ""))


def title_from(url: Column, u: Column) -> Column:
    """U24."""
    last = F.try_element_at(F.filter(F.split(u["path"], "/"), lambda s: s != ""), F.lit(-1))
    t = trim(title_case(F.regexp_replace(F.regexp_replace(last, "[-_]", " "), r"\.[^.]+\z", "")))
    return F.coalesce(F.when(t != "", t), url)


def filename(u: Column) -> Column:
    """U18."""
    stems = F.transform(segments(u), lambda s: F.regexp_replace(s, r"\.[^.]+\z", ""))
    name = F.array_join(F.concat(F.array(F.regexp_replace(u["host"], r"^www\.", "")), stems), "_")
    name = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), "-+", "-")
    return F.coalesce(F.concat(name, F.lit(".txt")), F.lit("page-0.txt"))


def comparison_key(u: Column) -> Column:
    """Host and path, less index files and a closing slash."""
    path = F.regexp_replace(F.regexp_replace(u["path"], r"/index\.[^/]*\z", "/"), r"/\z", "")
    return F.concat(u["host"], path)


def display(url: Column) -> Column:
    """A bare origin without its slash, parentheses encoded."""
    return F.replace(F.replace(F.regexp_replace(url, r"^(https?://[^/?#]+)/\z", "$1"), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def locale(u: Column) -> Column:
    """U13."""
    first = F.lower(F.try_element_at(F.filter(F.split(u["path"], "/"), lambda s: s != ""), F.lit(1)))
    code = F.element_at(F.split(first, "[-_]"), 1)
    return F.when(first.rlike(r"^[a-z]{2,3}([-_][a-z0-9]{2,4})?\z") & code.isin(*LOCALES), code)


def base_language(tag: Column) -> Column:
    return F.nullif(F.lower(F.element_at(F.split(tag, "[-_]"), 1)), F.lit(""))


def off_language(u: Column, lang: Column, primary: Column) -> Column:
    return F.coalesce(locale(u) != primary, F.lit(False)) | F.coalesce(base_language(lang) != primary, F.lit(False))


def origin(u: Column) -> Column:
    return F.concat(u["scheme"], F.lit("://"), u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""))


def markdown_sibling(u: Column) -> Column:
    """S13."""
    query = F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise("")
    return F.when(u["path"].endswith("/"), F.concat(origin(u), u["path"], F.lit("index.html.md"), query)).otherwise(F.concat(origin(u), u["path"], F.lit(".md")))


def forbidden_ipv4(ip: Column) -> Column:
    """Private, shared, loopback, link-local, metadata, benchmark, multicast and reserved ranges; malformed ones, too."""
    p = F.transform(F.split(ip, r"\."), lambda x: F.regexp_extract(x, r"^[+-]?\d+", 0).try_cast("int"))
    at = lambda k: F.try_element_at(p, F.lit(k))
    a, b, c, d = (at(k) for k in (1, 2, 3, 4))
    bad = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 172) & b.between(16, 31))
    bad = bad | ((a == 169) & (b == 254)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & (c == 0)) | ((a == 198) & b.isin(18, 19))
    bad = bad | ((a == 168) & (b == 63) & (c == 129) & (d == 16))
    return F.coalesce((F.size(p) != 4) | F.exists(p, lambda x: x.isNull()) | bad, F.lit(True))


def forbidden_ipv6(ip: Column) -> Column:
    """U8."""
    low = F.lower(ip)
    pair = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\z"
    hi, lo = (F.conv(F.regexp_extract(low, pair, k), 16, 10).try_cast("int") for k in (1, 2))
    byte = lambda v, s: F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string")
    plain = low.isin("::", "::1") | low.rlike("^(fe80:|fc|fd|ff)")
    dotted = r"^::ffff:(\d+\.\d+\.\d+\.\d+)\z"
    return F.when(plain, True).when(low.rlike(dotted), forbidden_ipv4(F.regexp_extract(low, dotted, 1))).when(
        low.rlike(pair), forbidden_ipv4(F.concat_ws(".", byte(hi, 8), byte(hi, 0), byte(lo, 8), byte(lo, 0)))
    ).otherwise(False)


def rejection(u: Column) -> Column:
    """Why a submitted URL is refused, or null."""
    host = u["host"]
    inner = F.regexp_replace(host, r"^\[|\]\z", "")
    private = F.lit("Private or reserved IP ranges aren't allowed")
    return (
        F.when(u["scheme"].isNull(), "Enter a valid URL")
        .when(~u["scheme"].isin("http", "https"), "URL must start with http:// or https://")
        .when(u["port"] != "", "Custom ports aren't allowed")
        .when(host == "", "Enter a valid hostname")
        .when((host == "localhost") | host.endswith(".localhost"), "localhost URLs aren't allowed")
        .when(host.contains(":"), F.when(forbidden_ipv6(inner), private))
        .when(host.rlike(r"^\d+\.\d+\.\d+\.\d+\z"), F.when(forbidden_ipv4(host), private))
        .when(~host.contains("."), "Enter a full domain (e.g. example.com)")
    )
