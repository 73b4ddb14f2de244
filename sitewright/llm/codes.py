"""Vector code compression: product quantisation whose nearest entries are found by exponion search.

A vector's components become integers, ``floor(SCALE * x)``, and it is cut into ``PARTS`` equal parts. Each part position has a
codebook of up to ``ENTRIES`` entries, first those of the vectors with the least ids. A round gives every part its nearest entry and
every entry the floor of its parts' mean; after ``ROUNDS`` of them parts are given entries once more.

The search begins at the entry p that a part had before. An entry that is as near as p lies within twice the part's distance
to p of p (triangle inequality), so p's list of the other entries, nearest first, is gone through to that radius and no
further: squared, to 4 * d(x, p)**2, in exact integers; equal distances go to the lower index.

Spark deals out the rows. What passes through the driver are the codebooks (PARTS * ENTRIES entries, whatever the input) and
their sums, one row an entry, added up in tasks first. Each round's table is written with its codes and replaces the one
before, so lost executors cost a rerun of tasks.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are those whose length is
no multiple of PARTS or another one than that of the kept vector with the least id; of rows with equal ids the lesser
vector comes first among the first entries; null ids come last; with fewer vectors than ENTRIES the codebooks are as many entries
long; an error above the range of a long is its end; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salt, shared_keys, stage, unstage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers of less are squared and summed in 64 bits: 4 * EXACT**2 * length must stay below 2**63.
EXACT = 1 << 26
_LONGEST = 512
_MOST = (1 << 63) - 1

#: The codebooks: by part position the entries, as rows of integers.
Codebooks = list[np.ndarray]


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as 64-bit integers where sums of squares fit, as Python's integers elsewhere."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if not scaled.size or (np.abs(scaled).max() < EXACT and scaled.shape[1] // PARTS <= _LONGEST):
        return scaled.astype(np.int64)
    exact = [[int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in row] for row in vectors.tolist()]
    return np.array(exact, object).reshape(scaled.shape)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to the rows, or the row, ``b``."""
    if a.dtype != b.dtype:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(xs: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, by the lower index of equal ones, its squared distance, and how many distances were
    computed; ``start`` is an entry of each row to begin at."""
    best, least, seen = start.copy(), squares(xs, entries[start]) if len(xs) else np.zeros(0, np.int64), len(xs)
    for p in np.unique(start).tolist():
        rows = np.flatnonzero(start == p)
        between = squares(entries, entries[p])
        others = sorted((d, j) for j, d in enumerate(between.tolist()) if j != p)
        radius = 4 * least[rows]
        order = np.argsort(radius, kind="stable")
        rows, radius = rows[order], radius[order]
        for d, j in others:
            at = np.searchsorted(radius, d)  # rows whose radius reaches this entry
            if at == len(rows):
                break
            near = rows[at:]
            to = squares(xs[near], entries[j])
            seen += len(near)
            closer = (to < least[near]) | ((to == least[near]) & (j < best[near]))
            best[near[closer]], least[near[closer]] = j, to[closer]
    return best, least, seen


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def kept(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, xs): the rows that are not dropped; ``xs`` as doubles."""
    xs = F.col("embedding").cast("array<double>")
    fine = xs.isNotNull() & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(xs) % PARTS == 0)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), xs.alias("xs")).where(fine & F.col("xs").isNotNull())
    first = rows.select("vec_id", "xs").orderBy(F.col("vec_id").asc_nulls_last(), "xs").limit(1).select(F.size("xs")).first()
    return rows.where(F.size("xs") == (first[0] if first else 0))


def first_codebooks(rows: DataFrame) -> Codebooks:
    """The parts of the ENTRIES vectors with the least ids."""
    first = rows.select("vec_id", "xs").orderBy(F.col("vec_id").asc_nulls_last(), "xs").limit(ENTRIES).collect()
    if not first:
        return []
    return np.split(integers(np.array([r.xs for r in first], np.float64).reshape(len(first), -1)), PARTS, axis=1)


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, xs, codes, error): each row's entries by part, its search begun at its ``codes``, if it has some."""
    has_codes = "codes" in rows.columns

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            vec_id, label, column, *codes = frame.columns
            parts = np.split(integers(_matrix(column)), PARTS, axis=1)
            start = _matrix(codes[0]) if codes else np.zeros((frame.num_rows, PARTS), np.int64)
            found = [nearest(parts[k], books[k], start[:, k]) for k in range(PARTS)] if frame.num_rows else []
            out = np.stack([f[0] for f in found], axis=1) if found else np.zeros((0, PARTS), np.int64)
            error = [min(sum(map(int, e)), _MOST) for e in zip(*(f[1].tolist() for f in found), strict=True)]
            ends = pa.array(np.arange(0, PARTS * frame.num_rows + 1, PARTS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [vec_id, label, column, pa.ListArray.from_arrays(ends, pa.array(out.ravel())), pa.array(error, pa.int64())], ["vec_id", "label", "xs", "codes", "error"]
            )

    shown = rows.select("vec_id", "label", "xs", *(["codes"] if has_codes else []))
    return shown.mapInArrow(run, "vec_id bigint, label bigint, xs array<double>, codes array<bigint>, error bigint")


def updated(coded: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks with each used entry at the floor of its parts' mean."""
    kinds = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.string()), ("n", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for frame in frames:
            parts, codes = np.split(integers(_matrix(frame.column(0))), PARTS, axis=1), _matrix(frame.column(1))
            for k in range(PARTS if frame.num_rows else 0):
                for j in np.unique(codes[:, k]).tolist():
                    mine = parts[k][codes[:, k] == j]
                    have = sums.setdefault((k, j), [[0] * mine.shape[1], 0])
                    have[0], have[1] = [a + int(b) for a, b in zip(have[0], mine.sum(axis=0))], have[1] + len(mine)
        rows = [(k, j, i, str(x), n) for (k, j), (total, n) in sums.items() for i, x in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], kinds.names)

    sums = coded.select("xs", "codes").mapInArrow(run, "part int, entry int, at int, total string, n bigint")
    # Sums of integers of any size: those of up to 18 digits are added as decimals, longer ones once they are here.
    small = F.length("total") <= 18
    added = sums.groupBy("part", "entry", "at", F.when(~small, F.col("total")).alias("long_total")).agg(
        F.sum(F.when(small, F.col("total")).otherwise(F.lit("0")).cast("decimal(18,0)")).alias("total"), F.sum("n").alias("n"), F.count("*").alias("times")
    )
    out = [list(map(list, b.tolist())) for b in books]
    have: dict[tuple[int, int, int], list[int]] = {}
    for r in added.collect():
        x = have.setdefault((r.part, r.entry, r.at), [0, 0])
        x[0] += int(r.total) + (int(r.long_total) * r.times if r.long_total is not None else 0)
        x[1] += r.n
    for (k, j, i), (total, n) in have.items():
        out[k][j][i] = total // n
    return [_packed(b, books[k].shape) for k, b in enumerate(out)]


def _packed(rows: Sequence[Sequence[int]], shape: tuple[int, int]) -> np.ndarray:
    small = all(abs(x) < EXACT for row in rows for x in row) and shape[1] <= _LONGEST
    return np.array(rows, np.int64 if small else object).reshape(shape)


def encode(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, error) of the kept rows, staged, and the final codebooks."""
    rows = stage(kept(embeddings), "vectors")
    books = first_codebooks(rows)
    for _ in range(rounds if books else 0):
        coded = stage(assigned(rows, books), "coded-vectors")
        unstage(rows)
        rows, books = coded, updated(coded, books)
    final = stage(assigned(rows, books).drop("xs"), "codes")
    unstage(rows)
    return final, books


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def digest(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    coded, books = encode(embeddings)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    # A label that many rows have is joined in several places, each with the sum over all of them.
    named = coded.select("vec_id", code.alias("code"), "error", F.to_json(F.struct("label")).alias("name"))
    dealt = shared_keys(named, "name", "vec_id", F.sum(F.col("error").cast("decimal(38,0)")).alias("part"))
    total = F.least(F.sum("part"), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    totals = dealt.groupBy("name").agg(total.alias("label_error"), F.array_sort(F.collect_set("salt")).alias("salts"))
    totals = totals.select("name", "label_error", F.explode("salts").alias("salt"))
    out = named.withColumn("salt", salt("vec_id")).join(totals, ["name", "salt"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
