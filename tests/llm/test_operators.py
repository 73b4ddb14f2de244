"""The training-text operators against brute force on small fixtures, with the cases their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from sitewright.llm import audio, chunks, common, langid, lines, mixing, neardup, packing, quality, secrets, shingles, tokens, tokenstore

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, id string, key string"


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghiklmnoprstuvé") for _ in range(r.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    r, ws = random.Random(7), vocabulary(7)
    make = lambda n: " ".join(r.choice(ws) for _ in range(n))
    out = [make(r.choice([3, 12, 40, 200])) + "\n" + make(30) for _ in range(60)]
    base = make(150)
    out += [base, base, base + " end", base.replace(" ", "\n", 3), base.upper()]
    for k in range(20):
        near = base.split()
        near[k * 5] = "changed"
        out.append(" ".join(near))
    out += ["", None, " \n\t ", "one", "one two", "x" * 3000, "spam spam spam spam spam spam " * 20, 'api_key="abcdefghijkl" AKIA' + "B" * 16 + " é " + "0af" * 9 + " token: short secret=" + "Z" * 30]
    out += ["same line here\n" * 5 + make(20), make(5000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "c", "a"][i % 5], len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "a text without an id, which is kept", "en", "a", 3, "", "", "")]
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_empty_tables(empty):
    for run in (secrets.digest, neardup.near_duplicates, quality.digest, langid.digest, audio.digest, lines.digest, mixing.digest, chunks.repeats, tokenstore.digest, packing.digest):
        assert run(empty).count() == 0, run


def test_secrets(docs, texts):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for r in secrets.digest(docs).collect():
        t = (texts[r.doc_id] if r.doc_id is not None else "") or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_secret_digest_scans_unseen_pairs(spark, docs, tmp_path):
    """A digest of all rules evaluates those that one of the base rules did not; a second one evaluates nothing; a new text
    and a new rule version are evaluated where they are unseen."""
    folder = str(tmp_path / "ledger")
    ids = lambda rules: sorted(r.id for r in rules)
    rows = lambda: [(x.blob, sorted(x.rules)) for x in spark.read.parquet(folder).collect()]
    docs = docs.dropDuplicates(["doc_id", "text"])  # rows that repeat both are scanned each
    secrets.digest(docs, secrets.BASE_RULES, folder).collect()
    first = sorted(map(tuple, secrets.digest(docs, folder=folder).collect()), key=repr)
    seen = rows()
    blobs = {b for b, _ in seen}
    assert sorted(seen) == sorted([(b, ids(secrets.BASE_RULES)) for b in blobs] + [(b, ids(secrets.MORE_RULES)) for b in blobs])
    assert first == sorted(map(tuple, secrets.digest(docs).collect()), key=repr)
    assert sorted(map(tuple, secrets.digest(docs, folder=folder).collect()), key=repr) == first and len(rows()) == len(seen)
    more = docs.unionByName(spark.createDataFrame([(-5, "a new text, password = abcdefghijkl1234")], "doc_id long, text string"), allowMissingColumns=True)
    newer = (*secrets.RULES[:-1], secrets.Rule("chat", secrets.RULES[-1].pattern, version=2))
    got = {x.doc_id: x.n_assign for x in secrets.digest(more, newer, folder).collect()}
    added = [x for x in rows() if x not in seen]
    new = {b for b, _ in added} - blobs
    assert got[-5] == 1 and len(new) == 1
    assert [r for b, r in added if b in new] == [ids(newer)]
    assert {b for b, r in added if b in blobs and r == ["chat@2"]} == blobs


def test_secret_ledger(spark, docs, texts, tmp_path):
    folder = str(tmp_path / "ledger")
    first = secrets.update(docs, folder, secrets.BASE_RULES).cache()
    assert first.select("blob").distinct().count() == len({t or "" for t in texts} | {"a text without an id, which is kept"})
    before = first.count()
    assert secrets.scan(docs, first, secrets.BASE_RULES).count() == 0
    # Another rule and a new version of an old one: only these are evaluated, also for new blobs under old rules.
    newer = secrets.Rule("hex", r"[0-9a-f]{20,}", version=2)
    rules = (*secrets.BASE_RULES[:2], newer, secrets.MORE_RULES[0])
    more = spark.createDataFrame([(0, texts[0]), (7000, texts[0]), (7001, "-----BEGIN RSA PRIVATE KEY----- " + "0a" * 9 + " " + "0b" * 10), (7002, "-----BEGIN RSA PRIVATE KEY----- " + "0a" * 9 + " " + "0b" * 10)], "doc_id long, text string")
    todo = {r.blob: r.rules for r in secrets.scan(more, first, rules).collect()}
    assert sorted(map(tuple, todo.values())) == [("assign@1", "access@1", "hex@2", "pem@1"), ("hex@2", "pem@1")]
    ledger = secrets.update(more, folder, rules)
    assert secrets.scan(more, ledger, rules).count() == 0 and ledger.count() == before + 2
    got = {r.doc_id: [(x.kind, x.version) for x in r.found] for r in secrets.join_back(more, ledger, rules).collect()}
    assert got[7001] == got[7002] == [(3, 1), (2, 2)] and got[0] == got[7000]
    # Paths of blobs scanned before have their findings from the ledger.
    old = {r.doc_id: len(r.found) for r in secrets.join_back(docs, ledger, secrets.BASE_RULES).collect()}
    k = next(i for i, t in enumerate(texts) if t and t.startswith("api_key"))
    assert old[k] == 4


def test_secret_kinds(spark):
    text = "-----BEGIN EC PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK é ghp_" + "A1" * 18 + " xoxb-1234567890"
    (r,) = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    spans = [x.split(":") for x in r.spans.split(",")]
    assert [x[0] for x in spans] == ["pem", "jwt", "forge", "chat"] and (r.n_assign, r.n_access, r.n_hex) == (0, 0, 0)
    assert [text[int(a) : int(b)] for _, a, b in spans] == ["-----BEGIN EC PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "ghp_" + "A1" * 18, "xoxb-1234567890"]


def _components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts):
        ws = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()
    expected = _components(sets, percent)
    for r in neardup.near_duplicates(docs, width, percent).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id])
            assert r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_of_one_original(spark):
    """Copies that are each like the original and less like one another: lists are long and few pivots link."""
    r, ws = random.Random(11), vocabulary(11, 4000)
    texts = []
    for size, copies in ((200, 300), (120, 150)):
        original = [r.choice(ws) for _ in range(size)]
        made = [original]
        for _ in range(copies):
            copy = list(original)
            for at in r.sample(range(size), size // 50):
                copy[at] = r.choice(ws)
            made.append(copy)
        texts += [" ".join(m) for m in made]
    order = r.sample(range(len(texts)), len(texts))
    texts = [texts[k] for k in order]
    sets = {}
    for i, t in enumerate(texts):
        x = t.split()
        sets[i] = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    expected = _components(sets, 85)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 85).collect()}
    assert got == expected


def test_near_duplicates_of_a_loose_group(spark, monkeypatch):
    """Copies that reach the threshold with few others of their group, after pivots that link little."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r, ws = random.Random(12), vocabulary(12, 4000)
    original = [r.choice(ws) for _ in range(160)]
    texts = []
    for _ in range(160):
        copy = list(original)
        for at in r.sample(range(160), r.randint(1, 6)):
            copy[at] = r.choice(ws)
        texts.append(" ".join(copy))
    sets = {}
    for i, t in enumerate(texts):
        x = t.split()
        sets[i] = {tuple(x[k : k + 3]) for k in range(len(x) - 2)}
    expected = _components(sets, 85)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(table, 3, 85).collect()}
    assert got == expected
    # The join alone finds every pair.
    members = table.select(F.lit(1).alias("key"), F.col("doc_id").alias("x"), F.col("doc_id").alias("c"))
    found = {(x.p, x.x) for x in neardup._exact(members, table.select(F.col("doc_id").alias("x"), "text"), 3, 85).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked <= found and len(found) < len(sets) * (len(sets) - 1) / 2


def test_quality(docs, texts):
    for r in quality.digest(docs).collect():
        t = (texts[r.doc_id] if r.doc_id is not None else "a text without an id, which is kept") or ""
        ws = WORD.findall(t)
        wins = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        n = Counter(wins)
        repeated = {j for k, w in enumerate(wins) if n[w] > 1 for j in range(k, k + 5)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(ls) - len(set(ls)), len(repeated))
        assert r.base_failed == (len(ws) < 10 or 100 * len(repeated) > 20 * len(ws))
        assert not (r.kept and r.base_failed)


def test_quality_ablations(docs):
    got = {r.rule: r for r in quality.ablations(quality.measure(docs), quality.POLICIES["v2"]).collect()}
    assert set(got) == set(quality.RULES)
    ledger = quality.digest(docs)
    assert got["min_words"].fails == ledger.where("n_words < 10").count()


def test_language_id(spark):
    ws = {k: vocabulary(s, 60) for k, s in (("aa", 1), ("bb", 2))}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(ws[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "123 !", "bb"), (902, "x", None)]
    out = {r.doc_id: r for r in langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:80])
    assert [(out[i].lang_pred, out[i].score) for i in (900, 901)] == [("und", 0.0)] * 2
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)


def test_language_id_equals_brute_force(spark):
    """Profiles, distances, ties and scores by counting in dictionaries; null ids, repeated rows and long texts among them."""
    r, ws = random.Random(4), {k: vocabulary(s, 40) for k, s in (("aa", 1), ("bb", 2), ("cc", 3))}
    rows = [(i, " ".join(r.choice(ws[k]) for _ in range(r.choice([1, 3, 20, 2000]))), k) for i, k in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [rows[3], (None, rows[4][1], "bb"), (600, "Ab1c É\n-x", None), (601, "", "aa"), (602, "漢字 Ωω", "aa")]

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out.update(w)
            edged = "\1" + w + "\1"
            out.update(edged[k : k + 2] for k in range(len(edged) - 1))
            out.update(edged[k : k + 3] for k in range(len(edged) - 2) if edged[k + 1] != "\1")
        return out

    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    ranks = lambda n: sorted(n, key=lambda g: (-n[g], number(g)))[: langid.RANKS]
    learned = {}
    for i, t, k in rows:
        if k and t is not None and (i is None or zlib.crc32(str(i).encode()) % 5):
            learned.setdefault(k, Counter()).update(grams(t))
    profiles = {k: {g: j for j, g in enumerate(ranks(n))} for k, n in learned.items()}
    want = []
    for i, t, _ in rows:
        own = ranks(grams(t))
        far = {k: sum(abs(p[g] - j) if g in p else langid.RANKS for j, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        want.append((i, best, round(1 - far[best] / (langid.RANKS * len(own)), 9)) if own else (i, "und", 0.0))
    got = [(x.doc_id, x.lang_pred, round(x.score, 9)) for x in langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_audio(docs, texts):
    for r in audio.digest(docs).collect():
        t = ((texts[r.doc_id] if r.doc_id is not None else "a text without an id, which is kept") or "").encode()
        p = audio.padded(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert "skipped=0" in r.feature and r.payload_bytes % 64 == 0


def test_audio_resync():
    media = audio.pack(b"\x01" * 6400)
    s = audio.parse(b"\xff\xe0 noise \xff\xfb" + media)
    assert len(s.offsets) == 5 and not s.broken and s.samples == 5 * 1152 and s.table_frames == 5
    at = audio.parse(media).offsets[2]
    hurt = bytearray(media)
    hurt[at + 4] ^= 1
    assert audio.parse(bytes(hurt)).broken == 1
    assert audio.parse(b"no stream").offsets == []


def _frame(version, layer, kbps, hz, mode=3, extension=0, protected=False, body=b""):
    """A frame of zeros but for its header, checksum and ``body``."""
    bits = {1: 3, 2: 2, 2.5: 0}[version] << 19 | {1: 3, 2: 2, 3: 1}[layer] << 17 | (not protected) << 16
    rates = [int(x / version) if version != 2.5 else x // 4 for x in audio._HZ]
    word = 0x7FF << 21 | bits | audio._KBPS[version == 1, layer].index(kbps) << 12 | rates.index(hz) << 10 | mode << 6 | extension << 4
    h = audio.header(word)
    raw = word.to_bytes(4)
    rest = body.ljust(h.size, b"\0")
    return (raw + (audio.crc16(raw[2:] + rest[: h.covered]).to_bytes(2) if protected else b"") + rest)[: h.size], h


def test_audio_layers_versions_and_rates():
    one = [_frame(1, 1, 64, 48000, protected=True, body=b"\x11" * 16), _frame(1, 1, 64, 32000, mode=1, extension=1, protected=True, body=b"\x22" * 20), _frame(1, 2, 64, 44100, protected=True), _frame(2, 3, 64, 22050), _frame(2.5, 3, 64, 8000, mode=0)]
    s = audio.parse(b"".join(f for f, _ in one))
    assert len(s.offsets) == 5 and s.skipped == 0 and (s.checked, s.broken) == (2, 0)
    assert [h.samples for _, h in one] == [384, 384, 1152, 576, 576] and [h.covered for _, h in one[:2]] == [16, 20]
    assert s.duration_us == int(1e6 * (384 / 48000 + 384 / 32000 + 1152 / 44100 + 576 / 22050 + 576 / 8000))
    hurt = bytearray(b"".join(f for f, _ in one))
    hurt[len(one[0][0]) + 6 + 19] ^= 1  # the last byte that the second frame's checksum covers
    assert audio.parse(bytes(hurt)).broken == 1


def test_audio_vbri():
    import struct

    frame, h = _frame(1, 3, 128, 44100, mode=0)
    table = b"VBRI" + bytes(6) + struct.pack(">IIHHH", 5000, 7, 3, 1, 2) + bytes(2) + struct.pack(">HHH", 10, 20, 30)
    first = (frame[: 4 + 32] + table).ljust(h.size, b"\0")
    s = audio.parse(first + frame * 7)
    assert (s.table, s.table_frames, s.table_bytes, s.seek, len(s.offsets)) == ("VBRI", 7, 5000, (10, 20, 30), 7)


def test_audio_broken_store_raises(spark):
    media = bytearray(audio.pack(b"\1" * 640))
    media[audio.parse(bytes(media)).offsets[0] + 8] ^= 1
    with pytest.raises(Exception, match="checksum"):
        audio.features(spark.createDataFrame([(1, 640, media)], "doc_id long, n_bytes long, media binary")).collect()


def test_lines(docs, texts, spark):
    got = {}
    for r in lines.digest(docs).collect():
        got.setdefault(r.doc_id, r)
    k = next(i for i, t in enumerate(texts) if t and t.startswith("same line here"))
    assert got[k].text.count("same line here") == 1 and got[k].n_lines_gone == 4
    assert got[texts.index(None)].text is None
    a = " ".join(vocabulary(3, 120))
    near = spark.createDataFrame([(1, a), (2, "short\n" + a.upper() + "!"), (3, a + "s")], "doc_id long, text string")
    assert {r.doc_id: r.n_lines_gone for r in lines.digest(near).collect()} == {1: 0, 2: 1, 3: 1}


def test_mixing(docs, texts, monkeypatch):
    rows = mixing.digest(docs).collect()
    sizes = Counter()
    for r, s in zip(rows, rows, strict=True):
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    total = sum(r.size for r in rows)
    by = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in by) - total) < 1e-6 * total
    for key in by:
        sizes[key] = sum(r.taken for r in rows if (r.source_size, r.target) == key)
        left = [r.size for r in rows if (r.source_size, r.target) == key and r.size and r.taken == r.size * (min(x.taken // x.size for x in rows if (x.source_size, x.target) == key and x.size))]
        assert abs(sizes[key] - key[1]) <= max(0.01 * key[1], min(left, default=0))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.digest(docs.repartition(7)).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.digest(docs).collect()), key=str)


def test_chunks(spark):
    r, ws = random.Random(5), vocabulary(5, 3000)
    make = lambda n: " ".join(r.choice(ws) for _ in range(n))
    passage = make(60)
    rows = [(i, make(100) + " " + passage + "  " + make(100)) for i in range(20)] + [(100 + i, make(250)) for i in range(30)] + [(200, None), (201, ""), (202, "word")]
    out = chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in out} == set(range(20))
    by = dict(rows)
    assert all(by[x.doc_id][x.start : x.end] in " " + passage + "  " for x in out)
    assert [x.doc_id for x in out if x.is_first] == [0]
    # Rows that share an id are one document.
    same = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (2, rows[25][1])], "doc_id long, text string")
    assert chunks.repeats(same).count() == 0
    mixed = spark.createDataFrame([(1, rows[0][1]), (None, rows[1][1])], "doc_id long, text string")
    assert [(x.doc_id, x.is_first) for x in chunks.repeats(mixed).collect() if x.doc_id is None] == [(None, True)]
    assert chunks.cut_out("abcdef", [(1, 3), (2, 4)]) == "aef"


def test_pieces_are_whole_text_ids():
    path = tokens.default_path()
    t, e = tokenizers.Tokenizer.from_file(path), tokens.Encoder(path)
    r = random.Random(2)
    parts = [" ", "\n", "\t", "a", "B", "1", "'s", "é", " ", "!", "<|endoftext|>", "日", "  ", "\r\n", "😀"]
    many = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    ids, counts = e.batch([x.encode() for x in many])
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert all(g.tolist() == x.ids for g, x in zip(got, t.encode_batch(many, add_special_tokens=False), strict=True))


def test_pieces_that_share_a_hash_keep_their_ids(monkeypatch):
    """Thue-Morse texts, which have one polynomial hash, and short pieces when all hashes are alike."""
    t = tokenizers.Tokenizer.from_file(tokens.default_path())
    letters = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    many = [letters, letters.translate(str.maketrans("ab", "ba")), "one two, three", "four one two " + "five" * 80, letters]
    for k in range(2):
        if k:
            monkeypatch.setattr(tokens, "mix", lambda x: x & np.uint64(1))
        ids, counts = tokens.Encoder(tokens.default_path()).batch([x.encode() for x in many])
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert all(g.tolist() == x.ids for g, x in zip(got, t.encode_batch(many, add_special_tokens=False), strict=True))


def test_forgetting_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    t, e, r = tokenizers.Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path()), random.Random(8)
    ws = vocabulary(8, 300)
    for _ in range(12):
        many = [" ".join(r.choice(ws) + r.choice(["", "", ",", ".x"]) for _ in range(40)) for _ in range(5)]
        ids, counts = e.batch([x.encode() for x in many])
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert all(g.tolist() == x.ids for g, x in zip(got, t.encode_batch(many, add_special_tokens=False), strict=True))


def _ids(texts, end):
    t = tokenizers.Tokenizer.from_file(tokens.default_path())
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for i, x in enumerate(texts)}


def test_token_store(docs, texts):
    ids = _ids(texts, 0)
    rows = sorted(tokenstore.digest(docs.where("doc_id is not null")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens


def test_token_store_round_trip(spark, docs, texts, tmp_path):
    folder = str(tmp_path / "store")
    tokenstore.write(docs, folder)
    ids = _ids(texts, 0)
    assert all(r.ids == ids[r.doc_id].tolist() for r in tokenstore.documents(spark, folder).collect() if r.doc_id is not None)
    stored = spark.read.parquet(folder + "/chunks")
    assert stored.count() == stored.select("digest").distinct().count()
    assert len(tokenstore.store_root(spark, folder)) == 64
    parts, owner = [b"abc", b"", b"defg" * 999, b"", b"x" * 70000, b"yz"], np.array([0, 0, 0, 1, 2, 2])
    joined = tokenstore.crcs_joined(owner, np.array([zlib.crc32(x) for x in parts]), np.array([len(x) for x in parts]))
    assert joined.tolist() == [zlib.crc32(b"".join(x for x, o in zip(parts, owner, strict=True) if o == k)) for k in range(3)]


def test_chunks_of_a_stream_do_not_depend_on_its_neighbours():
    r = np.random.default_rng(1)
    streams = [r.integers(0, 50000, n).astype(np.uint32) for n in (1, 63, 64, 65, 3000, 20000)] + [np.zeros(9000, np.uint32)]
    ends = tokenstore.cut_places(np.concatenate(streams), np.cumsum([len(x) for x in streams]))
    alone, at = [], 0
    for x in streams:
        alone += [at + e for e in tokenstore.cut_places(x, np.array([len(x)]))]
        at += len(x)
    assert ends == alone and max(np.diff([0, *ends])) <= tokenstore.MOST


def test_packing(docs, texts):
    ids = _ids(texts, 2)
    sequences, seen = {}, Counter()
    for r in packing.digest(docs.where("doc_id is not null")).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.piece == 0 or r.length == 1024
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.doc_id] += r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert all(seen[i] == len(x) * (2 if i == 5 else 1) for i, x in ids.items())


def test_plan_is_tight():
    r = random.Random(3)
    counts = Counter(min(1024, max(1, int(r.lognormvariate(5.5, 1.2)))) for _ in range(20000))
    plan = packing.make_plan(dict(counts))
    used = Counter()
    for p, n in plan:
        assert sum(p) <= 1024
        for k in p:
            used[k] += n
    assert used == counts
    assert sum(n for _, n in plan) <= 1.005 * sum(k * v for k, v in counts.items()) / 1024 + 2


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_long_and_wide_shingles():
    a, b = shingles.shingle_sets([b"a b c d", b"A  B\nC D"], 3)
    assert a.tolist() == b.tolist() and len(a) == 2
    letters = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    words = [w.encode() for w in (letters, letters.translate(str.maketrans("ab", "ba")), "a", "a\0", "x" * 16, "x" * 17, "x" * 16 + "\0")]
    assert len({int(h) for w in words for h in shingles.word_hashes([w])[0]}) == len(words)


def test_pipeline(spark, tmp_path, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    ok = {r.doc_id for r in quality.digest(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == ok
    # Each stage on the fixture, with null ids and texts, repeated rows and clashing columns.
    lined = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert len(lined) == len(rows) and {r.doc_id: r.text for r in lined}[texts.index(None)] is None
    k = next(i for i, t in enumerate(texts) if t and t.startswith("same line here"))
    assert {r.doc_id: r.text for r in lined}[k].count("same line here") == 1
    sets = {}
    for i, t in enumerate(texts):
        ws = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    groups = _components(sets, 80)
    near = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {r.doc_id for r in near} == {i for i in groups if groups[i] == i} and len(near) == len({r.doc_id for r in near})
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    taken = {r.doc_id: r.taken // r.size for r in mixing.digest(docs).collect() if r.size}
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in mixed.items() if i in taken}
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(range(len(texts)))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= ok and out.count() > 0


def test_pipeline_of_odd_tables(spark, docs, tmp_path):
    """Null ids, repeated rows and columns whose names the operators use, stage by stage; and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    wide = docs
    for name in ("key", "size", "range", "target", "nearest", "copies", "gap", "s", "x", "n", "level", "blob", "k"):
        wide = wide.withColumn(name, F.lit("clash"))
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mix_sources):
        out = stage(spark, wide, "")
        assert out.columns == corpus_pipeline.COLUMNS
        if stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
            assert out.where("doc_id is null").count() == 1
    kept = mixing.mix(wide, ("doc_id", "text", "size", "key", "range", "target", "nearest", "copies", "gap", "s"))
    assert kept.columns[2:] == ["size", "key", "range", "target", "nearest", "copies", "gap", "s"] and {r.size for r in kept.select("size").distinct().collect()} == {"clash"}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _similar(a, b):
    if max(len(a), len(b)) > lines.WORDWISE:
        a, b = a.split(" "), b.split(" ")
    return _edits(a, b) <= int((1 - lines.SIMILAR) * max(len(a), len(b)) + 1e-9)


def test_line_blocks(spark):
    """Blocks are the parities of the words that are dealt to them."""
    r, ws = random.Random(11), sorted({*vocabulary(11), *vocabulary(12, 1000)})
    texts = [" ".join(r.sample(ws, n)) for n in (3, 8, 19, 20, 21, 23, 26, 28, 200, 511, 700)]
    texts[7] += " " + texts[7]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3, "doc_id long, text string")
    hashed = {x.w: (x.h, x.k) for x in spark.createDataFrame([(w,) for w in ws], "w string").select("w", F.xxhash64("w").alias("h"), F.hash(F.xxhash64("w")).alias("k")).collect()}
    got = {}
    for x in lines.forms(lines.line_table(docs)).collect():
        n_blocks = 5 if x.level <= 0 else 6 if x.level == 1 else round(6 * 1.5 ** (x.level - 2))
        got.setdefault(x.first_at.doc_id, set()).add(x.level)
        words = list(dict.fromkeys(texts[x.first_at.doc_id].split(" ")))
        for b in range(lines.KEPT):
            dealt = [w for i, w in enumerate(words) if (i if x.level == lines.WORDS else hashed[w][1] % n_blocks) == b]
            bits = 0
            for w in dealt:
                bits ^= hashed[w][0]
            assert (x[f"b{b}"], x[f"c{b}"]) == (bits, sum(map(len, dealt)))
    assert got[0] == {-2} and got[1] == {-2, 0} and got[2] == {0, 1} and got[3] == {1} and got[4] == {1} and got[5] == {1, 2} and got[6] == {2} and got[7] == {2} and len(got) == len(texts)


@pytest.mark.parametrize("block", [4, 256])
def test_lines_of_one_list(spark, monkeypatch, block):
    """Components are those of all similar pairs that share a key, also where lists are long and pivots link few."""
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "TWO", 1)
    r, ws = random.Random(5), vocabulary(5, 60)
    rows = []
    for size in (6, 14, 24):
        base = [r.choice(ws) for _ in range(size)]
        for k in range(40):
            line = list(base)
            for _ in range(1 + size // 8 + k % 2):
                at = r.randrange(size)
                line[at] = (line[at] + r.choice("xyz")) if k % 3 else r.choice(ws)
            rows.append(" ".join(line))
    rows = sorted(set(rows))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    known = lines.forms(lines.line_table(docs)).cache()
    text = {x.id: rows[x.first_at.doc_id] for x in known.collect()}
    lists = {}
    for x in lines.keys(known).collect():
        lists.setdefault(x.key, set()).add(x.x)
    tried = {(a, b) for m in lists.values() for a in m for b in m if a < b}
    parent = {i: i for i in text}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in tried:
        if _similar(text[a], text[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in lines.links(known, docs).collect()}
    assert {i: got.get(i, i) for i in text} == {i: find(i) for i in text}
    assert 5 < len(set(map(find, text))) < len(text)


@pytest.mark.parametrize(("n", "changed", "least"), [(5, 0, 0.95), (10, 1, 0.95), (20, 2, 0.95), (50, 5, 0.9), (200, 17, 0.85), (12, 0, 0.99), (30, 1, 0.99), (100, 5, 0.98)])
def test_recall_of_similar_lines(spark, n, changed, least):
    """Lines at an edit similarity of 0.9 or a little more: ``changed`` words are others, or one letter is, if none is."""
    r, ws = random.Random(n + changed), vocabulary(13, 3000)
    rows, pairs = [], 0
    while pairs < 150:
        line = [r.choice(ws) for _ in range(n)]
        other = list(line)
        for at in r.sample(range(n), max(1, changed)):
            other[at] = r.choice(ws) if changed else other[at][:-1] + "q"
        a, b = " ".join(line), " ".join(other)
        if a != b and _similar(a, b):
            rows += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    gone = [x.n_lines_gone for x in sorted(lines.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda x: x.doc_id)]
    assert sum(gone[::2]) == 0
    assert sum(gone[1::2]) >= least * pairs


def test_short_and_blank_lines_stay(spark):
    rows = [(i, "yes\n\n---\na b\n" + "単語" * 10 + "\n" + ("first of all lines", "some other words here", "third line of text")[i]) for i in range(3)]
    got = {x.doc_id: x.text for x in lines.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert got[1] == "yes\n\n---\na b\nsome other words here"


def test_lines_that_share_one_block(spark):
    """in open lists every pair is compared whose lengths fit, also one that shares no other block."""
    r, ws = random.Random(3), vocabulary(13, 3000)
    base = [r.choice(ws) for _ in range(40)]
    rows = []
    for _ in range(12):
        line = list(base)
        for at in r.sample(range(40), 8):
            line[at] = r.choice(ws)
        rows.append(" ".join(line))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    known = lines.forms(lines.line_table(docs)).cache()
    members = lines._listed(lines.keys(known)).withColumn("c", F.col("x")).cache()
    lists, n = {}, {}
    for m in members.collect():
        lists.setdefault(m.key, set()).add(m.x)
        n[m.x] = m.n
    fit = {(a, b) for m in lists.values() for a in m for b in m if a < b and min(n[a], n[b]) >= lines.SIMILAR * max(n[a], n[b])}
    assert {(p.p, p.x) for p in lines._in_full(members, known).collect()} == fit
    assert len(fit) > 4


def test_long_lines_that_differ_in_the_first_blocks(spark):
    """each of the blocks of a long line is a key, not only the first ten."""
    r, ws = random.Random(4), sorted({*vocabulary(13, 3000)})
    block = {x.w: x.k for x in spark.createDataFrame([(w,) for w in ws], "w string").select("w", F.pmod(F.hash(F.xxhash64("w")), F.lit(46)).alias("k")).collect()}
    words = r.sample(ws, 200)
    other = list(words)
    for b in range(lines.KEPT):
        spare = [w for w in ws if block[w] == b and w not in words and w not in other]
        at = next((i for i, w in enumerate(words) if block[w] == b), None)
        if at is not None:
            other[at] = spare[0]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert _similar(" ".join(words), " ".join(other))
    assert [x.n_lines_gone for x in lines.digest(docs).orderBy("doc_id").collect()] == [0, 1]


def test_keys_of_lines_are_moved_once(spark, tmp_path):
    """The line table has the keys of all blocks, as forms have, and lists are found with one exchange of them."""
    r, ws = random.Random(7), sorted({*vocabulary(14, 3000)})
    texts = [" ".join(r.sample(ws, n)) for n in (5, 22, 30, 200)]
    hashed = {x.w: x.k for x in spark.createDataFrame([(w,) for w in ws], "w string").select("w", F.hash(F.xxhash64("w")).alias("k")).collect()}
    lines.line_table(spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")).write.parquet(str(tmp_path / "lines"))
    table = spark.read.parquet(str(tmp_path / "lines"))
    keyed = lines.keys(table)
    got = {(x.key, x.x, x.n) for x in keyed.collect()}
    assert got == {(x.key, x.x, x.n) for x in lines.keys(lines.forms(table)).collect()}
    long = [x.id for x in table.where("doc_id = 3").select("id").distinct().collect()]
    under = Counter()
    for w in texts[3].split(" "):
        under[hashed[w] % 46] += len(w)  # of 200 words, and of the 222 that a line like it may have
    expected = sum(x >= lines.LEAST_ONE for x in under.values())
    assert sum(x in long for _, x, _ in got) == expected > 2 * lines.KEPT
    listed = lines._listed(keyed)
    assert listed.count() == 0 and lines._listed(keyed.unionByName(keyed.withColumn("x", F.lit(0).cast("long")))).count() > 0
    assert listed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
