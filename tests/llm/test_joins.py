"""The prefix trie, the n-gram join, vector codes and repeated spans against brute force, with the cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sitewright.llm import chunks, codes, ngramjoin, trie

TURNS = "conv_id long, turn long, role string, text string, depth string, digest string, n_convs string"
DOCS = "doc_id long, text string, component_id string, x string, key string, keys string"
VECTORS = "vec_id long, embedding array<double>, label int, codes string, error string, name string, salt string"


def tries(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members, children = {}, Counter()
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    saved = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    children.update(p[:-1] for p in members if p)
    leaves = {p: int(not children[p]) for p in members}
    for p in sorted(members, key=len, reverse=True):
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize(("fan", "run_bits"), [(16, 12), (2, 1)])
def test_trie(spark, monkeypatch, fan, run_bits):
    """Null and tied turns, repeated rows, ids below zero, conversations without turns, long ones that share most, a first turn that all share."""
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "RUN_BITS", run_bits)
    r = random.Random(fan)
    rows = [(c, r.choice([None, t, t, t]), r.choice(["user", None, "a"]), r.choice(["x", "y", "é", None, ""])) for c in [*range(-12, 40), 1000] for t in range(r.choice([1, 2, 5, 9, 20]))]
    rows += [(c, t, "u", "same" if t < 70 else str(c)) for c in range(50, 62) for t in range(40 if c % 5 == 0 else 90)]
    rows += [(c, 0, "u", "z") for c in (71, 72, 73, 74, 76, 77, 78, 79)]  # without those whose turns they share
    rows += [(None, 1, "u", "x"), rows[0], rows[0]]
    df = spark.createDataFrame([(*x, "d", "c", "n") for x in rows], TURNS).repartition(3)
    got = [(x.conv_id, x.depth, -1 if x.parent_conv_id is None else x.parent_conv_id, *x[3:]) for x in trie.digest(df).collect()]
    want = tries(rows)
    assert any(x[1] == 0 and x[7] != hashlib.sha256(b"").hexdigest() for x in want)  # some have no turns
    assert sorted(got) == want


def test_trie_of_nothing(spark):
    assert trie.digest(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.digest(spark.createDataFrame([(None, 1, "a", "b", "", "", "")], TURNS)).count() == 0


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws)} if 0 < len(ws) < 3 else {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)}


def joined(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (i, s) in enumerate(sets):
        for j, n in Counter(j for g in s for j in where.get(g, ())).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                x, y = find(i), find(sets[j][0])
                parent[max(x, y)] = min(x, y)
        for g in s:
            where.setdefault(g, []).append(k)
    return sorted((i, len(s), find(i)) for i, s in sets)


def edited(r, vocabulary, least=1):
    """Originals and copies with some words changed, around the thresholds."""
    rows = []
    for _ in range(30):
        n = r.choice([1, 2, 5, 10, 12, 13, 20, 30, 60, 100, 300, 1000])
        base = [r.choice(vocabulary) for _ in range(n)]
        for k in range(r.choice([1, 5, 30])):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 2, max(1, n // 60), max(1, n // 40), n // 25]) if k else 0):
                words[r.randrange(n)] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(words[r.randrange(3) if r.random() < 0.3 else 0 :])))
    return rows


@pytest.mark.parametrize(("percent", "block", "leaf"), [(90, 2048, 16), (80, 8, 2)])
def test_jaccard_groups(spark, monkeypatch, percent, block, leaf):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "LEAF", leaf)
    rows = edited(random.Random(percent), [f"w{i}" for i in range(2000)])
    rows += [(9000, None), (9001, " \n\t"), (9002, "ONE two"), (9003, "one TWO"), (9004, "one"), (9005, "many words " * 4000), (9006, "Many words " * 4000)]
    df = spark.createDataFrame([(*x, "c", "x", "k", "ks") for x in rows], DOCS).repartition(3)
    assert sorted(map(tuple, ngramjoin.jaccard_groups(df, 3, percent).collect())) == joined(rows, percent)


def test_jaccard_groups_of_odd_ids(spark):
    """Rows without an id are alone; rows that share one are linked through it."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (7, b + " end"), (3, a + " end"), (9, "other words are here"), (None, a), (None, a)]
    got = ngramjoin.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]
    assert [x.component_id for x in got if x.doc_id is None] == [None, None]
    assert ngramjoin.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_and_bounds_lose_no_link(percent):
    """Sets at the threshold share a key, whatever their sizes; the bound on their overlap is not below it."""
    r, ranges = np.random.default_rng(percent), ngramjoin.Ranges(percent)
    for n in [*range(1, 60), 200, 201, 999, 5000]:
        for _ in range(8):
            a = np.unique(r.integers(0, 1 << 64, n, np.uint64))
            added = r.integers(0, n + 1)
            # As many changes as the threshold allows, some by leaving out, some by adding.
            most = max(k for k in range(n + 1) if k <= n and 100 * (n - min(k, n)) >= percent * (n + added - 0) or k == 0)
            b = np.unique(np.concatenate((r.permutation(a)[most:], r.integers(0, 1 << 64, added, np.uint64))))
            inter = len(np.intersect1d(a, b))
            if not np.array_equal(a, b) and 100 * inter >= percent * (len(a) + len(b) - inter):
                assert len(np.intersect1d(ngramjoin.keys(a, ranges), ngramjoin.keys(b, ranges)))
            bound = np.minimum(ngramjoin.counts(a), ngramjoin.counts(b)).sum()
            assert inter <= bound and ngramjoin.counts(a).sum() == len(a)


def test_tree_pairs_are_all_that_the_bound_leaves():
    r = np.random.default_rng(1)
    sizes, points = [], []
    for n, group in [(m, g) for m in (50, 60, 400) for g in range(12)]:
        centre = np.bincount(np.random.default_rng(n + group % 4).integers(0, 64, n), minlength=64)
        points.append(np.maximum(centre + (r.random(64) < 0.05) - (r.random(64) < 0.05), 0))
        sizes.append(points[-1].sum())
    sizes, points = np.array(sizes), np.array(points)
    wanted = lambda i, j: -(-(sizes[i] + sizes[j]) * 80 // 180)
    every = {(i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes)) if np.minimum(points[i], points[j]).sum() >= wanted(i, j)}
    whole = ngramjoin.Tree(sizes, points)
    got = {tuple(sorted(p)) for a, b in ngramjoin.tree_pairs(whole, whole, 80) for p in zip(a.tolist(), b.tolist()) if p[0] != p[1]}
    assert got == every and 20 < len(every) < len(sizes) ** 2 / 4
    left, right = ngramjoin.Tree(sizes[::2], points[::2]), ngramjoin.Tree(sizes[1::2], points[1::2])
    got = {tuple(sorted((2 * i, 2 * j + 1))) for a, b in ngramjoin.tree_pairs(left, right, 80) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {p for p in every if (p[0] + p[1]) % 2}


def coded(rows):
    whole = lambda x: int(x) * 4096 if abs(x) >= 2**53 else math.floor(x * 4096)
    kept = [(i, [whole(x) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) == 16]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[2 * k : 2 * k + 2] for k in range(8)]
    books = [[cut(v)[k] for _, v, _ in kept[:16]] for k in range(8)]
    nearest = lambda v: [min((sum((a - b) ** 2 for a, b in zip(p, e)), j) for j, e in enumerate(books[k])) for k, p in enumerate(cut(v))]
    for _ in range(6):
        found = [nearest(v) for _, v, _ in kept]
        for k in range(8):
            for j in range(len(books[k])):
                mine = [cut(v)[k] for (_, v, _), f in zip(kept, found) if f[k][1] == j]
                if mine:
                    books[k][j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [nearest(v) for _, v, _ in kept]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most, total = 2**63 - 1, Counter()
    errors = [min(most, sum(d for d, _ in f)) for f in found]
    for (_, _, la), e in zip(kept, errors):
        total[la] += e
    return sorted((-1 if i is None else i, "".join(f"{j:02x}" for _, j in f), e, min(most, total[la]), digest) for (i, _, la), f, e in zip(kept, found, errors))


def test_codes(spark):
    """Ties, repeated rows, nulls, what isn't finite, other lengths, null ids and labels, numbers beyond 64 bits."""
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.1, -0.2, 1.0, -3e-5]) for _ in range(16)], r.choice([None, 1, 2])) for i in range(60)]
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 1), (103, [float("-inf")] * 16, 1), (106, [1e306] * 16, 8), (None, [0.5] * 16, 4), (5, [0.5] * 16, 4), rows[5]]
    rows += [(104, [1e9] * 16, 7), (105, [-1e9] * 16, 7), (107, [1.0] * 8, 1), (108, [1.0] * 15, 1), (109, [], 1)]
    df = spark.createDataFrame([(*x, "c", "e", "n", "s") for x in rows], VECTORS).repartition(3)
    assert sorted((-1 if x[0] is None else x[0], *x[1:]) for x in codes.digest(df).collect()) == coded(rows)


@pytest.mark.parametrize("n", [0, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i % 2)] * 16, 1) for i in range(n)]
    df = spark.createDataFrame([(*x, "c", "e", "n", "s") for x in rows], VECTORS)
    assert sorted(map(tuple, codes.digest(df).collect())) == (coded(rows) if n else [])


def test_exponion_search_is_exact_and_reads_less():
    r = np.random.default_rng(2)
    entries = r.integers(-4000, 4000, (16, 8))
    xs = entries[r.integers(0, 16, 4000)] + r.integers(-300, 300, (4000, 8))
    every = ((xs[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for start in (every.argmin(axis=1), r.integers(0, 16, 4000)):
        best, least, seen = codes.nearest(xs, entries, start)
        assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
        assert seen <= 4000 * 16
    assert codes.nearest(xs, entries, every.argmin(axis=1))[2] < 4000 * 4


# ---- repeated spans of texts that share an id -------------------------------------------------------------------


def test_spans_are_those_of_their_text(spark):
    r, ws = random.Random(9), [f"{a}{b}{c}o" for a in "bcdfgklmnprst" for b in "aeiou" for c in "bcdfgklmnprst"]
    make = lambda n: " ".join(r.choice(ws) for _ in range(n))
    passage, long_passage = make(80), make(3000)
    texts = {
        "a": make(30) + " " + passage + " " + make(90), "b": make(150) + " " + passage + " " + make(20), "c": passage, "d": make(200) + " " + long_passage, "e": long_passage + " " + make(10) + " " + passage, "f": make(40) + " " + passage,
    }
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (None, "f")]
    df = spark.createDataFrame([(i, texts[t], "k", "f", "s") for i, t in rows], "doc_id long, text string, key string, first string, span string").repartition(3)
    hashed = {x.row: x.text for x in spark.createDataFrame([(t,) for t in texts.values()], "text string").selectExpr("text", "xxhash64(text) row").collect()}
    got = [(x.doc_id, hashed[x.row], x.start, x.end, x.n_rows) for x in chunks.repeats(df).collect()]
    found = Counter((i, t) for i, t, *_ in got)
    # Each text has its spans once, and each is nearly all of a passage and nothing but it.
    assert found == Counter({(1, texts["a"]): 1, (1, texts["b"]): 1, (2, texts["c"]): 1, (3, texts["d"]): 1, (None, texts["f"]): 1, (None, texts["e"]): 2})
    for i, t, a, b, n in got:
        span = t[a:b].strip()
        whole = passage if span in passage else long_passage
        assert span in whole and len(span) > len(whole) - 120, (i, span)
        assert n == (6 if whole is passage else 2)
