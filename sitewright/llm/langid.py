"""Language identification by rank-order profiles.

A profile is a language's ``RANKS`` most frequent n-grams (one to three characters within a word, with its edges) in
rank order. A text's own most frequent n-grams are compared to every profile: each adds the distance between its two
ranks, or ``RANKS`` if the profile lacks it. The profile with the least sum wins (of equal ones the first by name).

Counts are taken over all labelled rows; only profiles (``RANKS`` rows a language) reach the driver and the tasks.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was
learned; a null ``lang`` is not learned from; repeated rows count each time; other columns are ignored; an empty
table gives an empty result. The score is 1 less the share of the greatest possible distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches

RANKS = 400
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 300_000
BATCH = 1 << 20
UNKNOWN = "und"
_GAP = 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(texts: list[str]) -> Iterator[np.ndarray]:
    """The n-grams of each text, with repeats, as numbers of 21 bits a character; word edges are a gap."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    there = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, int)
    letter = np.zeros(int(points.max(initial=0)) + 1, bool)
    letter[[c for c in there.tolist() if chr(c).isalpha()]] = True
    at = 0
    for t in lowered:
        cs = points[at : at + len(t) + 1]
        at += len(t) + 1
        is_letter = letter[cs]
        cs = np.where(is_letter, cs, _GAP)
        cs = np.concatenate(([_GAP], cs[is_letter | np.concatenate(([False], is_letter[:-1]))]))
        one = cs[cs != _GAP]
        if not len(one):
            yield one
            continue
        two = (cs[:-1] << 21) | cs[1:]
        three = ((cs[:-2] << 42) | (cs[1:-1] << 21) | cs[2:])[cs[1:-1] != _GAP]
        yield np.concatenate((one, two, three))


def _counted(gs: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        s = np.sort(gs)
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        return s[edge[:-1]], np.diff(edge)
    order = np.argsort(gs, kind="stable")
    s, w = gs[order], weights[order]
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[edge], np.add.reduceat(w, edge)


def ranked(gs: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, in rank order; ties go to the smaller number."""
    ids, counts = _counted(gs)
    return ids[np.lexsort((ids, -counts))[:most]]


def learn(labelled: DataFrame, most: int = RANKS) -> DataFrame:
    """(lang, gram, rank) of (text, lang) rows."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            langs = [k for k, (ids, _) in held.items() for _ in range(len(ids))]
            out = pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate([v[0] for v in held.values()])), pa.array(np.concatenate([v[1] for v in held.values()]))],
                ["lang", "gram", "n"],
            )
            held.clear()
            return out

        rows = ((t.as_py(), k.as_py()) for b in frames for t, k in zip(b.column(0), b.column(1), strict=True))
        for part in batches(rows, lambda r: len(r[0]), BATCH):
            new: dict[str, list[np.ndarray]] = {}
            for (_, lang), gs in zip(part, grams([t for t, _ in part]), strict=True):
                new.setdefault(lang, []).append(gs)
            for lang, many in new.items():
                got = _counted(np.concatenate(many))
                if not len(got[0]):
                    continue
                if lang in held:
                    got = _counted(*(np.concatenate(x) for x in zip(held[lang], got, strict=True)))
                held[lang] = got
            if sum(len(v[0]) for v in held.values()) > HELD:
                yield flush()
        if held:
            yield flush()

    counts = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = counts.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= most).select("lang", "gram", "rank")


def profiles_of(table: DataFrame) -> dict[str, np.ndarray]:
    """Profiles as rank-ordered arrays: RANKS numbers for each learned language, whatever the size of the corpus."""
    rows = table.orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    names = sorted(profiles)
    every = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
    ranks = np.full((len(names), len(every) + 1), -1, np.int64)
    for i, k in enumerate(names):
        ranks[i, np.searchsorted(every, profiles[k])] = np.arange(len(profiles[k]))

    def judge(gs: np.ndarray) -> tuple[str, float]:
        if not len(gs) or not names:
            return UNKNOWN, 0.0
        own = ranked(gs)
        at = np.searchsorted(every, own)
        at[at == len(every)] = len(every) - 1
        theirs = np.where(every[at] == own, ranks[:, at], -1)
        far = np.where(theirs < 0, RANKS, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return names[best], float(1 - far[best] / (RANKS * len(own)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), t.as_py() or "") for b in frames for i, t in zip(b.column(0), b.column(1), strict=True))
        for part in batches(rows, lambda r: len(r[1]), BATCH):
            said = [judge(gs) for gs in grams([t for _, t in part])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in part], pa.int64()), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    profiles = profiles_of(learn(docs.where(~held_out(F.col("doc_id")))))
    return predict(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
