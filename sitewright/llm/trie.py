"""Conversation prefix trie from chained digests.

1. Each turn becomes a digest of its role and text and the bytes of its text; only these are moved from here on.
2. The turns of a conversation, in order, go through one task as a stream. The digest of a prefix is the digest of the
   shorter prefix and the turn, so equal digests are equal sequences. A row leaves for every prefix, the empty one
   included; in memory are the digests of the last ``FAN`` places of each level.
3. Prefixes are grouped by (depth, digest): the nodes, with their members' number and least id.
4. Subtree sums: each node is exploded to its ancestors, and an ancestor sums what it gets. Depths are cut into blocks of
   ``FAN``, whose tops are cut into blocks again: a node goes to the ancestors of its own block, a block's top to those of
   the block above with the sum of all below it. So a conversation of n turns makes no more than about 2 * FAN * n rows
   and not n * n / 2, with the same sums.
5. The ids of the conversations that end at a node are joined within ranges of ``RUN`` ids first, and a stream of these
   runs is hashed: what many conversations end in is no list in memory.

Defined results: null roles and texts are empty; turns with a null ``turn`` come first, those with equal ones are in the
order of their digests, and repeated rows are turns of their own; rows without a ``conv_id`` belong to no conversation
and make none; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salt, shared_keys, stage, text_of, unstage

#: Ancestors of one level that a node is exploded to at most.
FAN = 16
#: Ids of one run: consecutive multiples of it bound the ranges.
RUN_BITS = 12
#: Bytes of a digest.
DIGEST = 16
#: How conversations are rebuilt: ids that share the turns of the first of so many, and the most turns shared.
SIBLINGS, SHARED = 5, 8

_PREFIXES = "conv_id bigint, depth bigint, digest binary, parent binary, n_bytes bigint, last boolean, up array<array<binary>>"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_digest, n_bytes): the turns in order, counted from 1."""
    role, text = text_of("role"), text_of("text")
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", F.substring(F.unhex(F.sha2(framed, 256)), 1, DIGEST).alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "turn_digest", "n_bytes")


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % (SHARED + 1)


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, part, pos, turn_digest, n_bytes): the first turns of the conversation that comes first among its siblings, then
    its own turns behind as many. A row of part 0 without a digest stands for each conversation, whether it has turns or not."""
    c = F.col("conv_id")
    named = rows.where(F.col("pos") == 1).select("conv_id", (c - c % SIBLINGS).alias("base"), shared_turns(c).alias("h"))
    here = named.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_bytes"))
    first = rows.where((c % SIBLINGS == 0) & (F.col("pos") <= SHARED)).withColumnRenamed("conv_id", "base")
    first = first.join(named.where(F.col("h") > 0), "base").where(F.col("pos") <= F.col("h"))
    own = rows.where(F.col("pos") > shared_turns(c))
    columns = lambda part: ("conv_id", F.lit(part).alias("part"), "pos", "turn_digest", "n_bytes")
    return here.unionByName(first.select(*columns(1))).unionByName(own.select(*columns(2)))


class _Path:
    """The digests of a conversation's prefix that its next ones may name as ancestors: of each level the last FAN."""

    def __init__(self) -> None:
        self.depth, self.digest, self.levels = 0, bytes(DIGEST), [[bytes(DIGEST)]]

    def step(self, turn: bytes) -> tuple[bytes, bytes, list[list[bytes]]]:
        """Add a turn; the digest, the one before it, and for each level that the new depth is a place of the ancestors between
        it and the last top below it, that one included."""
        before, self.depth = self.digest, self.depth + 1
        self.digest = hashlib.sha256(before + turn).digest()[:DIGEST]
        up, at, k = [], self.depth, 0
        while True:
            level = self.levels[k]
            up.append(list(level))
            if at % FAN:
                level.append(self.digest)
                return before, self.digest, up
            self.levels[k] = [self.digest]
            at, k = at // FAN, k + 1
            if k == len(self.levels):
                self.levels.append([bytes(DIGEST)])


def prefixes(turns_of: DataFrame) -> DataFrame:
    """A row for every prefix of every conversation of ``rebuilt``; ``up`` has its ancestors by level, ``last`` marks the whole."""
    names = ["conv_id", "depth", "digest", "parent", "n_bytes", "last", "up"]
    kinds = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()), ("last", pa.bool_()), ("up", pa.list_(pa.list_(pa.binary())))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, path, out = None, None, []
        for frame in frames:
            for conv_id, turn, n_bytes in zip(*(frame.column(k).to_pylist() for k in ("conv_id", "turn_digest", "n_bytes")), strict=True):
                if turn is None:
                    if held:
                        out.append((*held, True, held_up))
                    path, held, held_up = _Path(), (conv_id, 0, bytes(DIGEST), None, 0), []
                    continue
                out.append((*held, False, held_up))
                before, digest, held_up = path.step(turn)
                held = (conv_id, path.depth, digest, before, n_bytes)
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], names)
                    out = []
        if held:
            out.append((*held, True, held_up))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], names)

    one = turns_of.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return one.select("conv_id", "turn_digest", "n_bytes").mapInArrow(run, _PREFIXES)


def ends(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the hash of the ids that end at each node, ascending and joined by commas."""
    runs = members.where("last").groupBy("digest", F.shiftright("conv_id", RUN_BITS).alias("run"))
    runs = runs.agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "ends_sha256"]
        last, h = None, None
        for frame in frames:
            done = []
            for digest, ids in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if digest == last:
                    h.update(b",")
                else:
                    if last is not None:
                        done.append((last, h.hexdigest()))
                    last, h = digest, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([h.hexdigest()])], names)

    one = runs.repartition("digest").sortWithinPartitions("digest", "run")
    return one.select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


def _level(k: int) -> Column:
    """Whether a node is one of level k: its depth a multiple of so many."""
    return F.col("depth") % FAN**k == 0


def subtree_sums(nodes: DataFrame, *values: str) -> DataFrame:
    """(digest, values): each value of staged nodes (digest, depth, up, values) summed over the node and all below it."""
    totals = lambda: [F.sum(v).alias(v) for v in values]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own, inside = nodes.select("digest", "depth", "up", *values), []
    k = 0
    while True:  # up: sums within the blocks of each level
        ancestors = F.when(F.col("depth") % FAN ** (k + 1) == 0, F.array("digest")).otherwise(F.concat(F.array("digest"), F.coalesce(F.get("up", F.lit(k)), F.array().cast("array<binary>"))))
        sums = own.select(F.explode(ancestors).alias("digest"), *values).groupBy("digest").agg(*totals())
        inside.append(stage(sums, "block-sums"))
        if deepest < FAN ** (k + 1):
            break
        k += 1
        own = nodes.where(_level(k)).select("digest", "depth", "up").join(inside[-1], "digest")
    whole = inside.pop()
    while k:  # down: what is below a block, by way of the tops that follow it
        k -= 1
        tops = nodes.where(_level(k + 1) & (F.col("depth") > 0)).select("digest", "depth", "up").join(whole, "digest")
        below = tops.select(F.explode(F.get("up", F.lit(k))).alias("digest"), *values)
        more = stage(inside.pop().unionByName(below).groupBy("digest").agg(*totals()), "block-sums")
        unstage(whole)
        whole = more
    return whole


def trie(conversations: DataFrame) -> DataFrame:
    """(digest, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    members = stage(prefixes(rebuilt(stage(turns(conversations), "turns"))), "prefixes")
    nodes = members.groupBy("depth", "digest").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"), F.first("up").alias("up")
    )
    nodes = stage(nodes, "nodes")
    # What children ask of a parent, many of one parent in several places.
    asked = stage(shared_keys(nodes.where(F.col("parent").isNotNull()), "parent", "digest", F.count("*").alias("n")), "children")
    families = asked.groupBy("parent").agg(F.sum("n").alias("n_children"))
    nodes = nodes.join(families.withColumnRenamed("parent", "of"), F.col("digest") == F.col("of"), "left").drop("of")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = stage(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "nodes")
    below = subtree_sums(nodes, "n_leaves", "saved_tokens")
    parents = asked.select("parent", "salt").join(nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    out = nodes.drop("n_leaves", "saved_tokens", "up", "n_bytes").withColumn("salt", salt("digest")).join(parents, ["parent", "salt"], "left").drop("salt")
    out = out.join(below, "digest").join(ends(members), "digest", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def digest(conversations: DataFrame) -> DataFrame:
    return trie(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
