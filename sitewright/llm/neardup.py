"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each document's set of word shingles gives its size, a digest and its ``K`` least hashes (the sketch).
2. Documents with equal sets are one class; only a class's representative goes on.
3. Inverted lists: the keys are runs of ``RUN`` neighbouring retained values (single values for very small sets). Two
   sets with the wanted similarity share a run but for a chance below 1e-9; small sets share one for certain.
4. In each list of several components a pivot is paired with every other member: first the document with the most
   shared lists, which in a group of edited copies is the text they were made from, then one that it did not reach. The
   union of the two sketches estimates a pair's similarity, and pairs that may reach the threshold are verified on full sets.
5. Members of lists that are still not one component are joined exactly, on their full sets (``_exact``): no pair is
   left out, however long a list is, and lists of texts that are alike but not alike enough aren't paired in full.

Defined results: null texts and texts without words have no shingles and are linked with nothing; fewer words than the
shingle's width are one shingle; a null ``doc_id`` is linked with nothing, has a null component and is kept; rows that
repeat a ``doc_id`` get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, components, extended, let, rows_of, small_batches, stage, text_of, unstage
from .shingles import shingle_sets

K, RUN = 64, 3
#: Estimates from K values have a standard deviation of at most 0.05 at a similarity of 0.8: pairs this far below the
#: threshold, five deviations, are not verified.
MARGIN = 0.25
BATCH = 1 << 20
PIVOTS = 2
#: Longs of a parity sketch: bit k says whether the number of hashes that fall on k is odd.
PARITY = 8
#: Members of a list that one task pairs with all of it.
BLOCK = 1024
#: Rows of a class that meet in one task.
COPIES = 16

_SIG = "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>"
_PAIR = "p bigint, x bigint, linked boolean"


def _mixed_digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of every document; the sketch is sorted."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), t.as_py().encode()) for b in frames for i, t in zip(b.column(0), b.column(1), strict=True))
        for part in batches(rows, lambda r: len(r[1]), BATCH):
            sets = list(shingle_sets([t for _, t in part], width))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_mixed_digest(s) for s in sets], pa.binary()),
                    _lists([s[:K] >> np.uint64(1) for s in sets]),
                ],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, _SIG)


def _keys(small: float, percent: int) -> Column:
    single = F.transform("sketch", lambda v: F.xxhash64(F.lit(1), v))
    runs = F.transform(F.slice("sketch", 1, F.greatest(F.size("sketch") - (RUN - 1), F.lit(0))), lambda v, i: F.xxhash64(v, *(F.get("sketch", i + j) for j in range(1, RUN))))
    none = F.array().cast("array<bigint>")
    return F.concat(
        F.when(F.col("n") * percent <= small * 100, single).otherwise(none),
        F.when(F.col("n") > small, runs).otherwise(none),
    )


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimated similarity may reach the threshold: of the union's K least values, which are among those of
    both sketches, the share that is in both."""
    a, b = sketches.select(F.col("x").alias("p"), F.col("sketch").alias("a")), sketches.select("x", F.col("sketch").alias("b"))
    both = pairs.join(a, "p").join(b, "x")
    union = F.slice(F.array_sort(F.array_union("a", "b")), 1, K)
    estimate = let(union, lambda u: F.size(F.array_intersect(F.array_intersect("a", "b"), u)) / F.size(u))
    return both.where(estimate >= percent / 100 - MARGIN).select("p", "x")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(p, x, linked) of pairs (p, x): 100 * intersection >= percent * union."""
    both = pairs.join(texts.select("x", F.col("text").alias("x_text")), "x")
    both = both.join(texts.select(F.col("x").alias("p"), F.col("text").alias("p_text")), "p")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in frames for r in rows_of(b))
        last, p_set = None, None
        for part in batches(rows, lambda r: len(r[2]), BATCH):
            linked = []
            for (p, _, _, p_text), s in zip(part, shingle_sets([r[2].encode() for r in part], width), strict=True):
                if p != last:
                    last, p_set = p, next(shingle_sets([p_text.encode()], width))
                inter = int(np.isin(s, p_set, assume_unique=True).sum())
                linked.append(100 * inter >= percent * (len(s) + len(p_set) - inter))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array(linked)], ["p", "x", "linked"])

    out = stage(both.select("p", "x", "x_text", "p_text").mapInArrow(run, _PAIR), "verified")
    return out


def _pairs_with(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    both = members.join(pivots, "key").where((F.col("c") != F.col("p_c")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")))
    return both.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x")).distinct()


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of lists of several components, named anew; ``done`` marks those that are with a pivot so far."""
    named = comps.withColumnsRenamed({"node": "x", "component": "now"})
    members = members.join(named, "x", "left").withColumn("c", F.coalesce("now", "x")).drop("now")
    lists = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max_by("c", F.struct("is_pivot", "x")).alias("with"))
    members = members.join(lists.where(F.col("low") < F.col("high")).select("key", "with"), "key")
    return members.select("key", "x", "n", "shared", "c", (F.col("done") | (F.col("c") == F.col("with"))).alias("done"))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(x, n, parity, hashes): the full sets, and the parity sketch, from which a bound on the difference of two sets follows."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), t.as_py().encode()) for b in frames for i, t in zip(b.column(0), b.column(1), strict=True))
        for part in batches(rows, lambda r: len(r[1]) + 16 * 64 * PARITY, BATCH):
            sets = list(shingle_sets([t for _, t in part], width))
            odd = [np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1 for s in sets]
            parity = [np.packbits(o.astype(np.uint8)).view(np.uint64) for o in odd]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in part], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(parity), _lists(sets)],
                ["x", "n", "parity", "hashes"],
            )

    return texts.select("x", "text").mapInArrow(run, "x bigint, n bigint, parity array<bigint>, hashes array<bigint>")


def _exact(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(p, x): pairs of different components, every one among them whose sets reach the threshold.

    Each set stands in the order of its hashes' frequencies, rarest first; hashes that no other set has come first and are
    not joined. Of two sets that reach the threshold the smaller one has one of its first ``index`` hashes among the
    first ``probe`` ones of the other. Texts with more of their own than that have no rows at all. Where the lists of
    common hashes stay long, the place in both orders and the parity sketches rule pairs out within the join.
    """
    listed = members.select("x", "c").distinct()
    sets = stage(_sets(texts.join(listed, "x", "left_semi"), width), "open-sets")
    each = sets.select("x", F.explode("hashes").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    shared = each.join(often, "t").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    n = F.col("n")
    whole = lambda a, b: F.floor((a + b - 1) / b).cast("int")  # noqa: E731  a / b, rounded up
    rows = sets.drop("hashes").join(shared, "x").join(listed, "x")
    rows = rows.select(
        "x", "n", "c", *(F.get("parity", F.lit(k)).alias(f"s{k}") for k in range(PARITY)), (n - F.size("ts")).cast("int").alias("own"), "ts",
        (n - whole(n * percent, F.lit(100)) + 1).cast("int").alias("probe"), (n - whole(n * 2 * percent, F.lit(100 + percent)) + 1).cast("int").alias("index"),
    )
    first = F.slice("ts", 1, F.greatest(F.col("probe") - F.col("own"), F.lit(0)))
    rows = rows.select("*", F.posexplode(first).alias("at", "h")).drop("ts", "probe")
    rows = rows.withColumns({"at": F.col("at") + F.col("own"), "t": F.col("h.t"), "blocks": F.ceil(F.col("h.df") / BLOCK).cast("int")}).drop("h", "own")
    rows = stage(rows, "open-prefixes")
    kept = ["x", "n", "c", "at", *(f"s{k}" for k in range(PARITY))]
    a = rows.where(F.col("at") < F.col("index")).select("t", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), *(F.col(k).alias(f"a_{k}") for k in kept))
    b = rows.select("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(k).alias(f"b_{k}") for k in kept))
    na, nb = F.col("a_n"), F.col("b_n")
    overlap = whole((na + nb) * percent, F.lit(100 + percent))
    differ = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(PARITY)), F.lit(0))
    fits = (
        (F.col("a_c") != F.col("b_c")) & ((na < nb) | ((na == nb) & (F.col("a_x") < F.col("b_x")))) & (100 * na >= percent * nb)
        & (F.least(na - F.col("a_at"), nb - F.col("b_at")) >= overlap) & (differ <= na + nb - 2 * overlap)
    )
    pairs = a.join(b, ["t", "block"]).where(fits).select(F.least("a_x", "b_x").alias("p"), F.greatest("a_x", "b_x").alias("x")).distinct()
    pairs = stage(pairs, "pairs")
    unstage(sets, rows)
    return pairs


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of representatives (x, n, sketch): (node, component), for those linked with another."""
    share = percent / 100
    assert share >= 0.75, "runs of neighbouring values are not certain to be shared below this"
    small = 2 / (3 * share - 2) + 1
    keyed = reps.where(F.col("n") > 0).select(F.explode(_keys(small, percent)).alias("key"), "x", "n")
    several = keyed.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high")).where(F.col("low") < F.col("high"))
    listed = stage(keyed.join(several.select("key"), "key"), "lists")
    # Texts and sketches of the documents that are in lists, moved once.
    central = stage(listed.groupBy("x").agg(F.count("*").alias("shared")), "listed")
    ids = central.select("x")
    texts = docs.select(F.col("doc_id").cast("long").alias("x"), text_of().alias("text")).join(ids, "x", "left_semi")
    texts = stage(texts.dropDuplicates(["x"]), "listed-texts")
    sketches = stage(reps.select("x", "sketch").join(ids, "x", "left_semi"), "listed-sketches")
    members = stage(listed.join(central, "x").select("key", "x", "n", "shared", F.col("x").alias("c"), F.lit(False).alias("done")), "lists")
    unstage(listed)
    comps = None
    for _ in range(PIVOTS):
        order = F.struct((~F.col("done")).alias("new"), "shared", (-F.col("x")).alias("least"))
        pivots = members.groupBy("key").agg(F.max_by(F.struct(F.col("x").alias("p"), F.col("n").alias("p_n"), F.col("c").alias("p_c")), order).alias("pivot"))
        pivots = stage(pivots.select("key", "pivot.*"), "pivots")
        pairs = stage(_pairs_with(members, pivots, percent), "pairs")
        found = _verify(_likely(pairs, sketches, percent), texts, width, percent).where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
        comps = stage(components(found) if comps is None else extended(comps, found), "components")
        with_pivot = members.join(pivots.select("key", "p"), "key").withColumn("is_pivot", F.col("x") == F.col("p")).drop("p")
        after = stage(_open(with_pivot, comps), "lists")
        unstage(pairs, pivots, members)
        members = after
    if members.isEmpty():
        return comps
    pairs = _exact(members, texts, width, percent)
    found = _verify(pairs, texts, width, percent).where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
    out = stage(extended(comps, found), "components")
    unstage(members, pairs, sketches)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; ``kept`` marks each component's least id."""
    sig = stage(signatures(docs, width), "sketches")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = sig.where(linkable).groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes.select("digest", F.col("rep.doc_id").alias("rep"), F.col("rep.n_shingles").alias("n"), "rep.sketch", "copies"), "classes")
    reps = classes.select(F.col("rep").alias("x"), "n", "sketch").dropDuplicates(["x"])
    comps = links(docs, reps, width, percent)
    # Documents of a class of their own that are linked with nothing need no name; the copies of one text meet in COPIES places.
    named = classes.join(comps, classes["rep"] == comps["node"], "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    named = named.select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("class_id"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("s"))
    rows = sig.select("doc_id", "n_shingles", F.when(linkable, F.col("digest")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int").alias("salt"))
    out = rows.join(named, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    component = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
