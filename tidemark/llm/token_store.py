"""Token-id output as a content-addressed store.

A document's ids are cut where a rolling hash of the last WINDOW ids ends in zero bits, so equal passages give equal
chunks whatever stands before them. The store is a folder of Parquet files:

* ``objects/kind=chunk``: key (SHA-256 of the payload), n ids, data (ids, little-endian, 2 or 4 bytes each), stored once;
* ``objects/kind=recipe``: key (Merkle root), n ids, data (the chunks' keys in order), stored once;
* ``manifest``: one row per document in ascending doc_id order: part, doc_id, root, n_tokens, copies.

Reading checks every payload against its key and every recipe against its Merkle root. CRC-32 can be joined, so reading
moves a few bytes per chunk, not the payloads.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.word_cache import WordEncoder

WINDOW, LEAST, MOST, CUT_BITS = 32, 64, 4096, 9
POLY = np.uint32(0xEDB88320)


def merkle_root(keys: list[bytes], n: int) -> bytes:
    """Pairs of keys are hashed level by level, an odd one moves up; the top is hashed with the number of ids."""
    level = keys
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return hashlib.sha256(b"\2" + n.to_bytes(8, "little") + b"".join(level)).digest()


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a 32-bit hash of the last WINDOW ids: every id's hash, shifted by its distance."""
    x = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    reach = 1
    while reach < WINDOW:
        shifted = np.zeros_like(x)
        shifted[reach:] = x[:-reach] << np.uint32(reach)
        x = x + shifted
        reach *= 2
    return x


def cuts(marks: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of a document's chunks: at marks, LEAST to MOST ids long (the last may be shorter)."""
    out, at = [], begin
    for m in marks:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST and m < end:
            at = int(m)
            out.append(at)
    while end - at > MOST:
        at += MOST
        out.append(at)
    return [*out, end] if at < end else out


def gf_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo CRC-32's, bits reflected."""
    a, b = a.astype(np.uint32).copy(), b.astype(np.uint32).copy()
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), POLY, np.uint32(0))
    return out


def x_power(bits: np.ndarray) -> np.ndarray:
    """x to these powers."""
    out, square, bits = np.full(len(bits), 1 << 31, np.uint32), np.array([1 << 30], np.uint32), bits.astype(np.int64).copy()
    while len(bits) and bits.max() > 0:
        out = np.where(bits & 1, gf_mul(out, np.broadcast_to(square, out.shape)), out)
        square, bits = gf_mul(square, square), bits >> 1
    return out


def crc32_joined(crcs: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """CRC-32 of joined byte strings from the parts' CRC-32 and sizes; firsts: where each string's parts begin."""
    ends = np.cumsum(sizes)
    last = np.append(firsts[1:], len(sizes)) - 1
    after = np.repeat(ends[last], last - firsts + 1) - ends
    return np.bitwise_xor.reduceat(gf_mul(x_power(8 * after), crcs), firsts)


def write_store(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1) -> None:
    """Encode docs (doc_id, text; null text counts as empty) and write the store.

    Repeated rows are one row of the manifest, with their number as copies, and stand one behind the other when read; rows
    without a doc_id come first. An empty table makes an empty store. A long text is encoded in one piece, so a task's
    memory follows its longest text.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))  # one file of fixed size

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(model.value)
        width = encoder.width
        end = np.array([end_id], width).tobytes()
        for batch in common.slices(batches, "text"):
            streams = [encoder.encode(t or "") + end for t in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(streams), width)
            ends = np.cumsum([len(x) // width.itemsize for x in streams])
            marks = np.flatnonzero((rolling(ids) >> np.uint32(32 - CUT_BITS)) == 0) + 1
            whole, rows, seen = ids.tobytes(), [], set()
            for doc_id, begin, stop in zip(batch.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                lo, hi = np.searchsorted(marks, (begin + LEAST, stop))
                keys, at = [], int(begin)
                for cut in cuts(marks[lo:hi], int(begin), int(stop)):
                    data = whole[at * width.itemsize : cut * width.itemsize]
                    keys.append(key := hashlib.sha256(data).digest())
                    if key not in seen:
                        seen.add(key)
                        rows.append(("chunk", key, None, cut - at, data))
                    at = cut
                n = int(stop - begin)
                root = merkle_root(keys, n)
                if root not in seen:
                    seen.add(root)
                    rows.append(("recipe", root, None, n, b"".join(keys)))
                rows.append(("doc", root, doc_id, n, None))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "key", "doc_id", "n", "data"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(objects, "kind string, key binary, doc_id long, n long, data binary")
    stored = rows.groupBy("kind", "key", "doc_id", "n").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    stored.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/objects")
    made = spark.read.schema("key binary, doc_id long, n long, data binary, copies long, kind string").parquet(f"{folder}/objects")
    found = made.where("kind = 'doc'").select("doc_id", F.col("key").alias("root"), F.col("n").alias("n_tokens"), "copies")
    ordered = found.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root")
    ordered.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "zstd").parquet(f"{folder}/manifest")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, merkle_root, n_chunks, all from the files, all checked.

    Repeated documents give a row each; an empty store gives none.
    """
    made = spark.read.schema("key binary, doc_id long, n long, data binary, copies long, kind string").parquet(f"{folder}/objects")
    manifest = spark.read.schema("part int, doc_id long, root binary, n_tokens long, copies long").parquet(f"{folder}/manifest")

    def chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for key, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.sha256(data).digest() != key:
                    raise ValueError("a chunk's bytes don't match its key")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["chunk", "n", "crc"])

    def recipe_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, places, keys = [], [], []
            for root, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [data[i : i + 32] for i in range(0, len(data), 32)]
                if merkle_root(own, n) != root:
                    raise ValueError("a recipe doesn't match its Merkle root")
                roots += [root] * len(own)
                places += range(len(own))
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(places, pa.int32()), pa.array(keys, pa.binary())], ["root", "pos", "chunk"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            sizes = np.array([4 * p["n"] for x in parts for p in x], np.int64)
            crcs = np.array([p["crc"] for x in parts for p in x], np.uint32)
            firsts = np.cumsum([0, *(len(x) for x in parts)])[:-1]
            if len(parts):
                out = crc32_joined(crcs, sizes, firsts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.add.reduceat(sizes, firsts) // 4), pa.array(out.astype(np.int64)), pa.array([len(x) for x in parts], pa.int64())], ["root", "n_ids", "ids_crc32", "n_chunks"])

    chunks = made.where("kind = 'chunk'").select("key", "n", "data").mapInArrow(chunk_sums, "chunk binary, n long, crc long")
    uses = made.where("kind = 'recipe'").select("key", "n", "data").mapInArrow(recipe_keys, "root binary, pos int, chunk binary")
    found = uses.join(chunks, "chunk", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    sums = found.mapInArrow(joined, "root binary, n_ids long, ids_crc32 long, n_chunks long")

    totals = manifest.groupBy("part").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("ids"))
    before = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per file part
    here = F.sum(F.col("n_tokens") * F.col("copies")).over(Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("here", F.coalesce(here, F.lit(0))).join(F.broadcast(before), "part")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.join(sums, "root", "left").select(
        "doc_id",
        (F.col("before") + F.col("here") + F.col("copy") * F.col("n_tokens")).alias("start"),
        F.when(F.col("n_ids") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's ids are not all there"))).cast("long").alias("n_tokens"),
        "ids_crc32",
        F.lower(F.hex("root")).alias("merkle_root"),
        "n_chunks",
    )
