"""Best-fit packing by patterns of document lengths and non-negative least squares.

Texts become ids with an end id; longer ones are cut into pieces of ``CAPACITY`` ids, the first of which may be shorter. Patterns
of one to four lengths that nearly fill a sequence are enumerated, repeat counts are fitted to the histogram of lengths
by non-negative least squares and rounded down, and what remains is packed best-fit decreasing, on counts as well.

The plan is made from the histogram, which has CAPACITY entries however many documents there are; it says for each
length which ranks go to which sequences and offsets. Ranks within a length come from counts per salted block, as many
blocks as pieces ask for, so a length that a third of all rows have is not sorted in one task.

Defined results: a null or empty text is a piece with the end id alone; a null ``doc_id`` is kept; rows that repeat a
``doc_id`` are packed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, small_batches, stage, text_of
from .tokens import BATCH, default_path, encoder

CAPACITY, END_ID = 1024, 2
#: Least number of blocks that a length's pieces are dealt to, and pieces a block.
SALT, BLOCK = 64, 200_000
SWEEPS = 12


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""
    path = path or default_path()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        rows = ((i.as_py(), t.as_py().encode()) for b in frames for i, t in zip(b.column(0), b.column(1), strict=True))
        for part in batches(rows, lambda r: len(r[1]), BATCH):
            flat, counts = tok.batch([t for _, t in part])
            out = []
            for (doc_id, _), ids in zip(part, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                for k, end in enumerate(range(head, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if k else 0
                    out.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end])))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, kinds)


# ---- the plan, from counts of lengths ---------------------------------------------------------------------------


def patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Combinations of one to four of the lengths in descending order, each filled up with the longest that fits."""
    found = set()

    def longest(room: int) -> int | None:
        k = bisect_left(lengths, room + 1)
        return lengths[k - 1] if k else None

    def fill(have: tuple[int, ...], more: int) -> None:
        room = capacity - sum(have)
        best = longest(room)
        if best is None:
            found.add(tuple(sorted(have, reverse=True)))
            return
        found.add(tuple(sorted((*have, best), reverse=True)))
        if more:
            fits = lengths[: bisect_left(lengths, room + 1)]
            for b in fits[:: max(1, len(fits) // 6)]:
                fill((*have, b), more - 1)

    for a in lengths:
        fill((a,), 2)
    return sorted(p for p in found if sum(p) >= capacity - 8 or len(p) > 1)


def fit(ps: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Repeat counts x >= 0 that make the patterns' lengths come near to the counts in least squares, by coordinate
    descent; patterns that fill a sequence better are fitted first."""
    left = {k: float(v) for k, v in counts.items()}
    uses = [[(n, p.count(n)) for n in dict.fromkeys(p)] for p in ps]
    norms = [sum(c * c for _, c in u) for u in uses]
    x = [0.0] * len(ps)
    order = sorted(range(len(ps)), key=lambda j: (-sum(ps[j]), len(ps[j]), ps[j]))
    for _ in range(sweeps):
        moved = 0.0
        for j in order:
            step = max(-x[j], sum(c * left[n] for n, c in uses[j]) / norms[j])
            if step:
                x[j] += step
                moved += abs(step)
                for n, c in uses[j]:
                    left[n] -= c * step
        if moved < 1:
            break
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal bins are filled together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, p: tuple[int, ...], n: int) -> None:
        if n:
            if room not in bins:
                bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            bins[room].append((p, n))

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                each = capacity // n
                put(capacity - each * n, (n,) * each, c // each)
                put(capacity - c % each * n, (n,) * (c % each), int(c % each > 0))
                break
            room = rooms[k]
            p, m = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(k)
            each = room // n
            full = min(m, c // each)
            put(room - each * n, p + (n,) * each, full)
            c -= full * each
            if full < m and c:
                rest = min(c, each)
                put(room - rest * n, p + (n,) * rest, 1)
                put(room, p, m - full - 1)
                c -= rest
            else:
                put(room, p, m - full)
    return [x for group in bins.values() for x in group]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold each length as often as it counts."""
    left = {k: v for k, v in counts.items() if v}
    ps = patterns(sorted(left), capacity)
    out = []
    for p, x in zip(ps, fit(ps, left), strict=True):
        n = min([int(x), *(left[k] // p.count(k) for k in set(p))])
        # A pattern that leaves room waits for the rest, which may fill it.
        if n > 0 and sum(p) >= capacity - 2:
            out.append((p, n))
            for k in p:
                left[k] -= n
    return out + best_fit({k: v for k, v in left.items() if v}, capacity)


def places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from the first on, up to the next row of the
    length, go to sequences from the first on."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for p, n in plan:
        offset = 0
        for length in p:
            rows.append((length, ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# ---- placing ---------------------------------------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a staged table of pieces."""
    salt = max(SALT, cut.count() // BLOCK)  # a length that all pieces have is ranked in blocks of BLOCK
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt)).alias("block")
    salted = cut.select("*", block)
    held = salted.groupBy("length", "block").agg(F.count("*").alias("n"))
    by_block = Window.partitionBy("length").orderBy("block")
    bases = stage(held.select("length", "block", "n", (F.sum("n").over(by_block) - F.col("n")).alias("base")), "piece-counts")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(make_plan(counts, capacity))
    keys = table[:, 0] << 44 | table[:, 1]
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1)
    b = bases.select(F.col("length").alias("l"), F.col("block").alias("b"), "base")
    ranked = ranked.join(b, (F.col("length") == F.col("l")) & (F.col("block") == F.col("b")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within")).alias("rank"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            length, rank = f.column(3).to_numpy(zero_copy_only=False), f.column(5).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1] if len(length) else table[:0]
            yield pa.RecordBatch.from_arrays(
                [*f.columns[:5], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, kinds)


def digest(docs: DataFrame) -> DataFrame:
    return pack(stage(pieces(docs), "pieces"))
