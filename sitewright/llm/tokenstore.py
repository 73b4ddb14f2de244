"""Token ids in a content-addressed store.

A rolling hash over the last ids cuts each document's stream into chunks, a chunk is named by its digest and stored once,
and a document's recipe lists its chunks. A store is a folder of four Parquet tables:

  chunks     digest, n, data        unique chunks; ids as little-endian unsigned integers of ``ID_BYTES`` bytes
  recipes    part, doc_id, start, n_tokens, root, digests    in ascending doc_id order (null first), by file and in files
  manifest   part, first_id, last_id, n_docs, n_tokens, root    Merkle roots of the recipes' roots, part by part
  (root)     the Merkle root over the manifest's roots, from ``store_root``

Reading checks every chunk against its name, every recipe against its root and every root against the manifest.

Defined results: a null or empty text is the end id alone; rows that repeat an id are documents of their own, ordered by
their roots; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import batches, shared_dir, small_batches, stage, text_of, unstage
from .shingles import mix
from .tokens import BATCH, default_path, encoder

END_ID = 0
ID_BYTES = 2
SPAN, CUT_BITS, LEAST, MOST = 8, 8, 64, 4096


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def cut_places(flat: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Where the chunks of streams end that lie one behind the other in ``flat``, the k-th up to ``bounds[k]``: behind ids where
    the hash of the last SPAN ids has its top bits zero, at least LEAST and at most MOST ids apart. As LEAST exceeds SPAN,
    no hash that decides reaches into the stream before."""
    h = (mix(flat.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    width = 1
    while width < SPAN:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(4 * width)
        h, width = longer, 2 * width
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    upto = np.searchsorted(marks, bounds).tolist()
    marks = marks.tolist()
    ends, last, k = [], 0, 0
    for bound, high in zip(bounds.tolist(), upto, strict=True):
        for e in [*marks[k:high], bound]:
            while e - last > MOST:
                last += MOST
                ends.append(last)
            if e == bound or e - last >= LEAST:
                ends.append(e)
                last = e
        k = high + (high < len(marks) and marks[high] == bound)
    return ends


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """A row for each chunk: digest, n, data; and on a document's first chunk doc_id and recipe."""
    kinds = "digest binary, n int, data binary, is_first boolean, doc_id bigint, recipe array<binary>, n_tokens bigint"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        assert len(tok.bytes) <= 1 << 8 * ID_BYTES
        rows = ((i.as_py(), t.as_py().encode()) for b in frames for i, t in zip(b.column(0), b.column(1), strict=True))
        for part in batches(rows, lambda r: len(r[1]), BATCH):
            flat, counts = tok.batch([t for _, t in part])
            flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
            counts = counts + 1
            bounds = np.cumsum(counts)
            ends = np.array(cut_places(flat, bounds), np.int64)
            offsets = np.concatenate(([0], ends))
            data = flat.astype(f"<u{ID_BYTES}").tobytes()
            view = memoryview(data)
            at = (offsets * ID_BYTES).tolist()
            names = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at, at[1:])])
            digests = _binary(np.arange(len(ends) + 1) * 16, names)
            firsts = np.searchsorted(offsets, np.concatenate(([0], bounds[:-1])))
            is_first = np.zeros(len(ends), bool)
            is_first[firsts] = True
            # A document's recipe is at its first chunk, the other rows have none.
            document = np.cumsum(is_first) - 1
            recipe_ends = np.append(firsts[1:], len(ends))[document]
            recipes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], recipe_ends)).astype(np.int32)), digests)
            ids = pa.array([i for i, _ in part], pa.int64()).take(pa.array(document))
            yield pa.RecordBatch.from_arrays(
                [digests, pa.array(np.diff(offsets).astype(np.int32)), _binary(offsets * ID_BYTES, data), pa.array(is_first), ids, recipes, pa.array(counts[document])],
                ["digest", "n", "data", "is_first", "doc_id", "recipe", "n_tokens"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, kinds)


def _root(digests: str) -> Column:
    return F.sha2(F.concat_ws("", F.transform(digests, F.hex)).cast("binary"), 256)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    rows = stage(encode(docs, path or default_path(), end_id), "token-chunks")
    unique = rows.select("digest", "n", "data").dropDuplicates(["digest"])
    unique.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    recipes = rows.where("is_first").select("doc_id", "n_tokens", F.col("recipe").alias("digests")).withColumn("root", _root("digests"))
    # Ranges of ids; the partition's number is written down, so what follows does not depend on being dealt alike again.
    ranged = stage(recipes.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "recipes")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    bases = sums.select(F.col("part").alias("p"), (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    upto = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(bases, F.col("part") == F.col("p"))
    placed = placed.select("part", "doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "root", "digests")
    placed.repartition("part").sortWithinPartitions("part", "start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    spark = docs.sparkSession
    _manifest(spark.read.parquet(f"{folder}/recipes")).write.option("compression", "zstd").parquet(f"{folder}/manifest")
    unstage(rows, ranged)
    common.free(spark)


def _manifest(recipes: DataFrame) -> DataFrame:
    """Roots of 4096 recipes each, then of those: no task hashes more than a part's share at once."""
    block = F.col("start").cast("long")
    leaves = recipes.groupBy("part", F.shiftright(block, 21).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("start", "root"))).alias("rs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
    )
    leaves = leaves.withColumn("leaf", F.sha2(F.array_join("rs.root", "").cast("binary"), 256))
    return leaves.groupBy("part").agg(
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("block", "leaf")))["leaf"], "").cast("binary"), 256).alias("root"),
    )


def store_root(spark: SparkSession, folder: str) -> str:
    """The root over all parts. The manifest has a row for each part of the store."""
    rows = spark.read.parquet(f"{folder}/manifest").orderBy("part").select("root").collect()
    return hashlib.sha256("".join(r["root"] for r in rows).encode()).hexdigest()


# ---- reading --------------------------------------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, bits reflected."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(np.broadcast(a, b).shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


def crcs_joined(owner: np.ndarray, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each owner's bytes from the CRCs and sizes of their parts, which stand in order, owner by owner: the
    exclusive or of the parts' CRCs, each times x to the power of the number of bits behind the part."""
    n = int(owner[-1]) + 1 if len(owner) else 0
    upto = np.cumsum(sizes)
    total = upto[np.searchsorted(owner, np.arange(n), side="right") - 1] if n else upto
    behind = total[owner] - upto
    out, power = crcs.astype(np.uint32), np.array([1 << 23], np.uint32)  # x to the 8
    while behind.any():
        odd = np.flatnonzero(behind & 1)
        out[odd] = _times(out[odd], power)
        power, behind = _times(power, power), behind >> 1
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.bitwise_xor.reduceat(out, starts) if n else out


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, crc) of the stored chunks; crc is of ids as unsigned 32-bit integers. A chunk that isn't what its name
    says raises an error."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            crcs = []
            for name, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if _digest(data) != name or len(data) != n * ID_BYTES:
                    raise ValueError("a chunk differs from its digest")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{ID_BYTES}").astype("<u4")))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), b.column(1), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return spark.read.parquet(f"{folder}/chunks").select("digest", "n", "data").mapInArrow(run, "digest binary, n int, crc bigint")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the stored documents, verified down to the chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    stored = spark.read.parquet(f"{folder}/manifest").select(F.col("part").alias("p"), F.col("root").alias("r"))
    broken = _manifest(recipes).join(stored, F.col("part") == F.col("p"), "full").where(~F.col("root").eqNullSafe(F.col("r")))
    if not broken.isEmpty():
        raise ValueError("recipes differ from the manifest")
    refs = recipes.withColumn("sound", F.col("root") == _root("digests")).select("doc_id", "start", "n_tokens", "sound", F.posexplode("digests").alias("at", "digest"))
    parts = refs.join(read_chunks(spark, folder).withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    docs = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.min("sound").alias("sound"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("cs"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if not b.num_rows:
                continue
            parts = b.column(4).flatten()
            owner = np.repeat(np.arange(b.num_rows), b.column(4).value_lengths().to_numpy(zero_copy_only=False))
            n = parts.field("n").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.bincount(owner, n, b.num_rows).astype(np.int64)
            sound = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if not sound.all() or (n < 0).any() or (found != b.column(2).to_numpy(zero_copy_only=False)).any():
                raise ValueError("a recipe cannot be followed")
            crcs = crcs_joined(owner, parts.field("crc").to_numpy(zero_copy_only=False), 4 * n)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(crcs.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.select("start", "doc_id", "n_tokens", "sound", "cs").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): the documents' ids, put together from their chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    both = recipes.join(spark.read.parquet(f"{folder}/chunks"), "digest")
    docs = both.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "data"))).alias("cs"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            ids = [np.frombuffer(b"".join(c["data"] for c in cs), f"<u{ID_BYTES}").tolist() for cs in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return docs.select("start", "doc_id", "cs").mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def digest(docs: DataFrame) -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
    common._STAGED.append((docs.sparkSession, folder))
    write(docs, folder)
    return read(docs.sparkSession, folder)
