"""Substring dedup by content-defined chunks of a gear rolling hash.

A text, as UTF-8 with runs of white space as one space and A-Z in lower case, is cut where the gear hash of the last
``WINDOW`` bytes has ``BITS`` zero bits on top and no other such place lies in the ``GAP`` bytes before. So cuts move with the
content, and an insertion changes only the chunks around it. What is compared is the digest of two neighbouring
chunks: single ones may be a word or two and repeat by chance. Chunks have at most ``MOST`` bytes, below the length from
which texts can be made that a polynomial hash of 64 bits confuses. Pairs that two or more documents hold are repeats (by their ids);
overlapping and touching repeats of a text are one span, and spans of ``LEAST_WORDS`` words or more are reported.

Digests are counted with map-side combining and joined back by an equi-join that Spark may split, so a passage that a
third of all rows hold is never gathered in one task. Digests have 64 bits; a span needs several equal ones.

Defined results: null, blank and short texts have no spans; passages that only one document repeats are not reported;
rows that share a ``doc_id`` are one document, null ids included, but spans are told for each of its texts; rows that repeat
an id and a text get equal spans, told once; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, small_batches, text_of
from .shingles import _BYTES, _IS_WS, _LOWER, _R, _R_INVERSE, _power, mix

WINDOW, BITS, GAP, MOST = 16, 4, 10, 512
LEAST_WORDS = 12
BATCH = 1 << 20
_GEAR = (mix(np.arange(300, 556, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _cuts(data: np.ndarray) -> np.ndarray:
    h = _GEAR[data]
    width = 1
    while width < WINDOW:  # the hash of twice the window from two of half
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    ends = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    return ends[np.diff(ends, prepend=-GAP) >= GAP]


def chunk_pairs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first, key, start, end, word_start, word_end) of all pairs of neighbouring chunks; a text of one chunk has
    that one. ``first`` marks a key's first place in its text; offsets are code points, ends exclusive."""
    gap = b"\0" * WINDOW  # each text begins after the same bytes, whatever stands before it in the batch
    buf = np.frombuffer((gap + gap.join([*texts, b""])).translate(_LOWER), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = WINDOW + np.cumsum(sizes + WINDOW) - (sizes + WINDOW)
    ws = _IS_WS[buf]
    kept = np.flatnonzero(~(ws & np.concatenate(([False], ws[:-1]))))
    data, gone = buf[kept].copy(), ws[kept]
    data[gone] = 0x20
    low, high = np.searchsorted(kept, begin), np.searchsorted(kept, begin + sizes)
    ends = np.unique(np.concatenate((_cuts(data), low, high)))
    far = np.flatnonzero(np.diff(ends) > MOST)
    if len(far):  # where the content gives no cut, from the last one on
        ends = np.unique(np.concatenate([ends, *(np.arange(ends[i] + MOST, ends[i + 1], MOST) for i in far)]))
    a, b = ends[:-1], ends[1:]
    owner = np.searchsorted(low, a, side="right") - 1
    inside = (owner >= 0) & (a < high[owner])
    a, b, owner = a[inside], b[inside], owner[inside]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_R, len(data)), out=sums[1:])
    one = mix((sums[b] - sums[a]) * _power(_R_INVERSE, len(data))[a])
    paired = np.concatenate((owner[1:] == owner[:-1], [False])) if len(owner) else np.zeros(0, bool)
    alone = ~paired & (np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else paired)
    i = np.flatnonzero(paired | alone)
    j = np.where(paired[i], i + 1, i)
    key = mix(one[i] * np.uint64(0xD6E8FEB86659FD93) + one[j])
    point = np.cumsum((buf & 0xC0) != 0x80) - 1
    word = np.cumsum(~gone & np.concatenate(([True], gone[:-1])))
    text = owner[i]
    base = point[begin[text]] if len(text) else text
    # A chunk's last byte is kept[b - 1]; the code point after it starts right behind.
    start, end = point[kept[a[i]]] - base, point[kept[b[j] - 1]] + 1 - base
    first = np.zeros(len(i), bool)
    first[np.unique(np.stack((text.astype(np.uint64), key)), axis=1, return_index=True)[1]] = True
    before = word[a[i]] - 1 + gone[a[i]]
    return text, first, key.view(np.int64), start, end, before, word[b[j] - 1]


def pair_table(docs: DataFrame) -> DataFrame:
    names = ["doc_id", "row", "first", "key", "start", "end", "word_start", "word_end"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), r.as_py(), t.as_py().encode()) for b in frames for i, r, t in zip(*b.columns, strict=True))
        for part in batches((r for r in rows if r[2]), lambda r: len(r[2]), BATCH):
            text, first, key, *rest = chunk_pairs([r[2] for r in part])
            ids, of_row = (pa.array([r[k] for r in part], pa.int64()).take(pa.array(text)) for k in range(2))
            yield pa.RecordBatch.from_arrays([ids, of_row, pa.array(first.astype(np.int64)), pa.array(key), *(pa.array(x.astype(np.int32)) for x in rest)], names)

    kinds = "doc_id bigint, row bigint, first bigint, key bigint, start int, end int, word_start int, word_end int"
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("row"), text_of().alias("text")).mapInArrow(run, kinds)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, start, end, n_words, n_rows, first_doc_id, is_first): a row for each repeated span of each text; ``row`` is the
    hash of the text that start and end belong to, ``n_rows`` counts rows of the table that hold the span, and a document without
    an id comes first. Cutting out the spans that are not first leaves those of one document."""
    table = pair_table(docs)
    ids = (F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    shared = table.groupBy("key").agg(F.sum("first").alias("n_rows"), *ids)
    # Rows that share an id are one document: two ids are two of them, and so are an id and none.
    shared = shared.where((F.col("first_doc_id") < F.col("last_doc_id")) | ((F.col("unnamed") > 0) & F.col("first_doc_id").isNotNull()))
    shared = shared.withColumn("first_doc_id", F.when(F.col("unnamed") == 0, F.col("first_doc_id"))).drop("last_doc_id", "unnamed")
    hits = table.drop("first").join(shared, "key")
    of_doc = Window.partitionBy("doc_id", "row").orderBy("start", "end")
    reach = F.max("end").over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("is_first", F.col("first_doc_id").eqNullSafe(F.col("doc_id")))
    breaks = F.coalesce(F.col("start") > reach, F.lit(True)) | (F.col("is_first") != F.lag("is_first").over(of_doc))
    hits = hits.withColumn("new", breaks.cast("int"))
    spans = hits.withColumn("span", F.sum("new").over(of_doc.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "row", "span")
    out = spans.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word_end") - F.min("word_start")).alias("n_words"),
        F.max("n_rows").alias("n_rows"), F.min("first_doc_id").alias("first_doc_id"), F.first("is_first").alias("is_first"),
    )
    return out.where(F.col("n_words") >= least_words).drop("span")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the spans; these may overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join(out) + text[at:]
