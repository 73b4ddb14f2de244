"""N-gram Jaccard join through count vectors and R-trees.

1. A document's set of word shingles is a point: its hashes fall into ``GROUPS`` groups of equal width, and the counts of the
   groups are the coordinates. The overlap of two sets is at most the sum of the lesser of their counts.
2. Documents with equal sets are one class; only a class's representative goes on.
3. The index is parted without loss. Within a range of sizes two sets that reach the threshold differ in at most D hashes, so
   cut into more than D finer groups they have a group in common, hash by hash (pigeonhole). The digests of these groups are
   the keys; a set close to the next range has the keys of both. Groups without a hash are no keys: there are as many
   groups more as a set may have empty ones, and a set with more has keys for these too.
4. In each part of several components one point, then another one, is the query: those of the others whose bound on the overlap
   reaches what the threshold asks for are verified on the full sets. A group of copies so costs two pairs a member.
5. Parts that are still not one component get an R-tree: points are cut in halves at the median of the widest coordinate down
   to leaves of ``LEAF``, nodes have the least and most of each coordinate, and two trees are gone through from their roots.
   Two nodes are left where the sum of the lesser of their most counts is below the overlap that their least sizes ask
   for; of leaves that stay, the points are compared by the same bound, and what remains is verified on the full sets.
   Large parts are several trees of up to ``BLOCK`` points of like sizes, each pair of which is a task's.

Every bound is exact, so no link is lost, however long a part is. Trees alone would not do for many unlike texts, since in a
space of many dimensions their nodes overlap: therefore the parts.

Defined results: null texts and texts without words have no shingles and are linked with nothing; fewer words than the
shingle's width are one shingle; a null ``doc_id`` is linked with nothing and has a null component; rows that repeat a
``doc_id`` get the component that its texts have together; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, components, extended, small_batches, stage, text_of, unstage
from .neardup import _lists, _open, _verify
from .shingles import mix, shingle_sets

GROUPS = 64
#: Ratio of the bounds of a range of sizes.
RANGE = 1.25
LEAF, BLOCK = 16, 2048
#: Quantiles of the sizes in a part of several trees.
STEPS = 64
PIVOTS = 2
#: Places where the rows of a class meet.
COPIES = 16
BATCH = 1 << 20

_SIG = "doc_id bigint, row bigint, n_shingles bigint, digest binary, counts array<int>, keys array<bigint>"


class Ranges:
    """The ranges of set sizes, and how many groups a set of each is cut into, for a similarity in percent."""

    def __init__(self, percent: int) -> None:
        self.percent, self.bounds = percent, [1]
        self.cuts: list[tuple[int, int]] = []

    def _until(self, n: int) -> None:
        while self.bounds[-1] <= n:
            low = self.bounds[-1]
            # No less than the ratio that two linked sets' sizes may have, so that they are in neighbouring ranges.
            high = max(low + 1, math.ceil(low * max(RANGE, 100 / self.percent)))
            differ = 2 * (high - 1) * (100 - self.percent) // (100 + self.percent)
            spare = 2 + differ // 64
            self.cuts.append((differ + 1 + spare if differ else 0, spare))
            self.bounds.append(high)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(range, groups, spare) of the ranges that a set of n hashes has keys of; none where only equal sets are linked."""
        if not n:
            return []
        most = 100 * n // self.percent
        self._until(most)
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        last = int(np.searchsorted(self.bounds, most, side="right")) - 1
        return [(k, *self.cuts[k]) for k in range(own, last + 1) if self.cuts[k][0]]


def _edges(groups: int) -> np.ndarray:
    """The least hashes of groups 1 and on: hashes are dealt by their high 32 bits."""
    return (((np.arange(1, groups, dtype=np.uint64) << np.uint64(32)) + np.uint64(groups - 1)) // np.uint64(groups)) << np.uint64(32)


def counts(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many of a sorted set's hashes fall into each group."""
    return np.diff(np.concatenate(([0], np.searchsorted(s, _edges(groups)), [len(s)])))


def keys(s: np.ndarray, ranges: Ranges) -> np.ndarray:
    """The digests of a set's groups: sets of linked documents have one in common."""
    out = []
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    for k, groups, spare in ranges.of(len(s)):
        ends = np.concatenate(([0], np.searchsorted(s, _edges(groups)), [len(s)]))
        names = mix(total[ends[1:]] - total[ends[:-1]]) + np.uint64(k << 32) + np.arange(groups, dtype=np.uint64)
        some = np.diff(ends) > 0
        out.append(mix(names[some] if groups - some.sum() <= spare else names))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, digest, counts, keys) of every row; ``row`` names its text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(percent)
        rows = ((i.as_py(), r.as_py(), t.as_py().encode()) for b in frames for i, r, t in zip(*b.columns, strict=True))
        for part in batches(rows, lambda r: len(r[2]), BATCH):
            sets = list(shingle_sets([r[2] for r in part], width))
            points = np.stack([counts(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.int64()),
                    pa.array([r[1] for r in part], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, GROUPS, dtype=np.int32)), pa.array(points.ravel())),
                    _lists([keys(s, ranges) for s in sets]),
                ],
                ["doc_id", "row", "n_shingles", "digest", "counts", "keys"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("row"), text_of().alias("text")).mapInArrow(run, _SIG)


def _wanted(total: Column, percent: int) -> Column:
    """The least overlap of two sets of so many hashes together that reach the threshold."""
    return F.floor((total * percent + (99 + percent)) / F.lit(100 + percent))


def _near(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Of pairs (p, x), those whose bound on the overlap reaches what the threshold asks for."""
    a = points.select(F.col("x").alias("p"), F.col("n").alias("p_n"), F.col("counts").alias("p_counts"))
    both = pairs.join(a, "p").join(points.select("x", "n", "counts"), "x")
    bound = F.aggregate(F.zip_with("counts", "p_counts", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.where(bound >= _wanted(F.col("n") + F.col("p_n"), percent)).select("p", "x")


class Tree:
    """A static R-tree over count vectors: nodes by level from the root, each with the most count of every coordinate, its
    least and most size, and its children; leaves have runs of ``order``."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        self.sizes, self.points = sizes, points
        self.order = np.arange(len(sizes))
        self.most: list[np.ndarray] = []
        self.least_size: list[int] = []
        self.children: list[tuple[int, ...]] = []
        self.runs: list[tuple[int, int]] = []
        self._grow(0, len(sizes))

    def _grow(self, a: int, b: int) -> int:
        rows = self.order[a:b]
        inside = self.points[rows]
        me = len(self.most)
        self.most.append(inside.max(axis=0))
        self.least_size.append(int(self.sizes[rows].min()))
        self.children.append(())
        self.runs.append((a, b))
        if b - a > LEAF:
            by = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
            self.order[a:b] = rows[np.argsort(inside[:, by], kind="stable")]
            mid = (a + b) // 2
            self.children[me] = (self._grow(a, mid), self._grow(mid, b))
        return me


def tree_pairs(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` that may reach the threshold, by the coordinates' lesser counts; of a tree and itself each pair
    of leaves once."""
    wanted = lambda total: -(-total * percent // (100 + percent))
    todo, same = [(0, 0)], a is b
    while todo:
        i, j = todo.pop()
        if same and a.runs[i][0] > b.runs[j][0]:
            continue
        if int(np.minimum(a.most[i], b.most[j]).sum()) < wanted(a.least_size[i] + b.least_size[j]):
            continue
        left, right = a.children[i], b.children[j]
        if left or right:
            todo += [(x, y) for x in left or (i,) for y in right or (j,)]
            continue
        rows, cols = a.order[slice(*a.runs[i])], b.order[slice(*b.runs[j])]
        overlap = np.minimum(a.points[rows][:, None, :], b.points[cols][None, :, :]).sum(axis=2)
        r, c = np.nonzero(overlap >= wanted(a.sizes[rows][:, None] + b.sizes[cols][None, :]))
        yield rows[r], cols[c]


def _trees(members: DataFrame, points: DataFrame) -> DataFrame:
    """(key, tree, x, c, n, counts): the points of each part, a large one's in trees of about BLOCK by the quantiles of their sizes,
    equal sizes by hash."""
    sized = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("trees"))
    rows = members.select("key", "x", "c").join(sized, "key").join(points.select("x", "n", "counts"), "x")
    rows = stage(rows.withColumn("at", F.col("n") + F.pmod(F.xxhash64("x"), F.lit(1 << 20)) / float(1 << 20)), "open-parts")
    steps = F.array(*(F.lit(k / STEPS) for k in range(1, STEPS)))
    cuts = rows.where(F.col("trees") > 1).groupBy(F.col("key").alias("of")).agg(F.percentile_approx("at", steps, 2000).alias("cuts"))
    step = F.size(F.filter("cuts", lambda q: q < F.col("at")))
    more = F.ceil(F.col("trees") / STEPS).cast("int")
    tree = F.when(F.col("trees") <= STEPS, F.floor(step * F.col("trees") / STEPS).cast("int")).otherwise(step * more + F.pmod(F.xxhash64(F.col("x") + 1), more).cast("int"))
    rows = rows.join(cuts, F.col("key") == F.col("of"), "left").withColumn("tree", F.when(F.col("trees") > 1, tree).otherwise(0))
    return stage(rows.select("key", "tree", "x", "c", "n", "counts"), "tree-points")


def _tree_join(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(p, x): pairs of different components within a part that its trees leave."""
    rows = _trees(members, points)
    ranges = rows.groupBy("key", "tree").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = (ranges.select("key", *(F.col(k).alias(f"{s}_{k}") for k in ("tree", "low", "high"))) for s in "ab")
    fit = (F.col("a_tree") <= F.col("b_tree")) & (100 * F.least("a_high", "b_high") >= percent * F.greatest("a_low", "b_low"))
    sides = a.join(b, "key").where(fit).select("key", "a_tree", "b_tree", F.explode(F.array_distinct(F.array("a_tree", "b_tree"))).alias("tree"))
    dealt = rows.join(sides, ["key", "tree"]).select(F.xxhash64("key", "a_tree", "b_tree").alias("job"), "key", "a_tree", "b_tree", "tree", "x", "c", "n", "counts")

    def joined(job: tuple, side: np.ndarray, x: np.ndarray, c: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
        at = [np.flatnonzero(side == t) for t in dict.fromkeys(job[1:])]
        trees = [Tree(n[i], flat[i]) for i in at]
        found = [np.zeros((2, 0), np.int64)]
        for r, k in tree_pairs(trees[0], trees[-1], percent):
            p, q = at[0][r], at[-1][k]
            apart = c[p] != c[q]
            found.append(np.stack((np.minimum(x[p], x[q])[apart], np.maximum(x[p], x[q])[apart])))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        whole = lambda: [np.concatenate(parts) for parts in zip(*held)]
        batch = lambda found: pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["p", "x"])
        for frame in frames:
            if not frame.num_rows:
                continue
            key, left, right, *rest = (frame.column(k).to_numpy() for k in ("key", "a_tree", "b_tree", "tree", "x", "c", "n"))
            rest.append(frame.column("counts").flatten().to_numpy().reshape(-1, GROUPS))
            starts = np.flatnonzero((np.diff(key) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)) + 1
            for i, k in zip([0, *starts], [*starts, len(key)], strict=True):
                job = (key[i], left[i], right[i])
                if job != last:
                    if held:
                        yield batch(joined(last, *whole()))
                    last, held = job, []
                held.append([r[i:k] for r in rest])
        if held:
            yield batch(joined(last, *whole()))

    one = dealt.repartition("job").sortWithinPartitions("job", "key", "a_tree", "b_tree").drop("job")
    pairs = stage(one.mapInArrow(run, "p bigint, x bigint").distinct(), "pairs")
    unstage(rows)
    return pairs


def links(texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of representatives (x, doc_id, row, n, counts, keys): (node, component), for those linked with another.
    ``texts`` is (doc_id, row, text)."""
    keyed = reps.where(F.col("n") > 0).select(F.explode("keys").alias("key"), "x", "n")
    several = keyed.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high")).where(F.col("low") < F.col("high"))
    listed = stage(keyed.join(several.select("key"), "key"), "parts")
    central = stage(listed.groupBy("x").agg(F.count("*").alias("shared")), "listed")
    points = stage(reps.select("x", "n", "counts", "doc_id", "row").join(central.select("x"), "x", "left_semi"), "points")
    texts = stage(texts.join(points.select("x", "doc_id", "row"), ["doc_id", "row"]).select("x", "text").dropDuplicates(["x"]), "listed-texts")
    members = stage(listed.join(central, "x").select("key", "x", "n", "shared", F.col("x").alias("c"), F.lit(False).alias("done")), "parts")
    unstage(listed)
    comps = None
    for _ in range(PIVOTS):
        order = F.struct((~F.col("done")).alias("new"), "shared", (-F.col("x")).alias("least"))
        pivots = members.groupBy("key").agg(F.max_by(F.struct(F.col("x").alias("p"), F.col("n").alias("p_n"), F.col("c").alias("p_c")), order).alias("pivot"))
        pivots = stage(pivots.select("key", "pivot.*"), "pivots")
        fit = (F.col("c") != F.col("p_c")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n"))
        pairs = members.join(pivots, "key").where(fit).select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x")).distinct()
        pairs = stage(_near(pairs, points, percent), "pairs")
        found = _verify(pairs, texts, width, percent).where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
        comps = stage(components(found) if comps is None else extended(comps, found), "components")
        with_pivot = members.join(pivots.select("key", "p"), "key").withColumn("is_pivot", F.col("x") == F.col("p")).drop("p")
        after = stage(_open(with_pivot, comps), "parts")
        unstage(pairs, pivots, members)
        members = after
    if not members.isEmpty():
        pairs = _tree_join(members, points, percent)
        found = _verify(pairs, texts, width, percent).where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
        comps = stage(extended(comps, found), "components")
        unstage(pairs)
    unstage(members, points)
    return comps


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sig = stage(signatures(docs, width, percent), "points")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = sig.where(linkable).groupBy("digest").agg(F.min(F.struct("doc_id", "row", "n_shingles", "counts", "keys")).alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes.select("digest", F.xxhash64("digest").alias("x"), "rep.doc_id", "rep.row", F.col("rep.n_shingles").alias("n"), "rep.counts", "rep.keys", "copies"), "classes")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    comps = links(texts, classes, width, percent)
    # An id that several texts have makes one document of them.
    of_id = sig.where(linkable).select("doc_id", F.xxhash64("digest").alias("x")).groupBy("doc_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    twice = stage(of_id.where(F.col("a") < F.col("b")).select("doc_id", "a"), "repeated-ids")
    if not twice.isEmpty():
        more = sig.where(linkable).select("doc_id", F.xxhash64("digest").alias("b")).join(twice, "doc_id").select("a", "b").where(F.col("a") < F.col("b"))
        comps = stage(extended(comps, more), "components")
    named = classes.select("digest", "x", "doc_id", "copies").join(comps.withColumnsRenamed({"node": "x"}), "x", "left")
    least = named.where(F.col("component").isNotNull()).groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("least"))
    named = named.join(least, F.col("component") == F.col("of"), "left").where((F.col("copies") > 1) | F.col("least").isNotNull())
    named = named.select(F.col("digest").alias("d"), F.coalesce("least", "doc_id").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("s"))
    rows = sig.select("doc_id", "n_shingles", F.when(linkable, F.col("digest")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int").alias("salt"))
    out = rows.join(named, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
