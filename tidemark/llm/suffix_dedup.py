"""Repeated byte strings by bucket-pointer refinement of a sampled suffix array.

A suffix's bucket is named by a 64-bit identifier of its first bytes. A deeper one is named by its buckets at the suffix and
at later offsets: depth 2q by depth q there and q bytes on, down to eight bytes, which a name holds whole. All suffixes are
named to GRAM, only those asked for to LENGTH. Names depend on content alone, so every task gives the same ones; only which buckets have several members is global.

1. Sampled suffixes: each LENGTH-byte string points to the least GRAM-byte bucket in its first half, its anchor, so equal
   strings point to equal anchors at equal distances. Anchors are sorted into these buckets; one alone in its bucket ends there.
2. Buckets of two or more are refined by the bucket GRAM bytes on, so to LENGTH / 2 bytes, and again by the anchor's class:
   its run of starts with all bytes that they cover. Starts of a class that occurs twice in a bucket repeat.
3. What is left lies near the ends of repeated passages: a class that occurs once, in a bucket of several classes. Only
   its starts, and those of one member of each other class of the bucket, are refined to LENGTH and counted one by one.

Exact but for collisions: classes are compared by 64 bits inside a bucket of 128, single starts by 96 bits.

Long texts are worked on in pieces of PIECE starts, so memory follows PIECE rather than the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

LENGTH, PIECE, HELD = 400, 1 << 16, 1 << 16
GRAM, HALF = LENGTH // 4, LENGTH // 2
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)
#: Bytes that a name of 64 bits holds whole.
_WHOLE = 8


def _refined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * _K1
    y = x >> np.uint64(32)
    x ^= y
    x += b
    x *= _K2
    np.right_shift(x, np.uint64(29), out=y)
    x ^= y
    return x


def buckets(data: np.ndarray, depth: int) -> np.ndarray:
    """Names at this depth, _WHOLE at least, of all suffixes of data that long."""
    n = len(data) - depth + 1
    if depth == _WHOLE:
        x = np.empty(n, np.uint64)
        for i in range(min(_WHOLE, n)):
            x[i::_WHOLE] = np.frombuffer(data, "<u8", (n - i + _WHOLE - 1) // _WHOLE, i)
        x *= _K1
        x ^= x >> np.uint64(32)
        return x
    half = max(_WHOLE, (depth + 1) // 2)
    inner = buckets(data, half)
    return _refined(inner[:n], inner[depth - half : depth - half + n])


def string_names(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names at depth LENGTH of some suffixes, by those at depth GRAM of all."""
    return _refined(_refined(grams[starts], grams[starts + GRAM]), _refined(grams[starts + HALF], grams[starts + HALF + GRAM]))


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class Anchors:
    """Of joined pieces of texts: per anchor its text, its ids, class, and shape: how far it and its last start are behind its first.

    pieces: (number of a text, bytes). Anchors of a text come in the order of its starts, and every start has one.
    """

    def __init__(self, pieces: list[tuple[int, bytes]]):
        sizes = np.array([len(t) for _, t in pieces], np.int64)
        data, end = np.frombuffer(b"".join(t for _, t in pieces), np.uint8), np.cumsum(sizes)
        begin, end = end - sizes, end - LENGTH + 1
        grams = buckets(data, GRAM)
        keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # of equal ones the leftmost
        least = window_least(keys, LENGTH - HALF + 1)
        cuts = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begin, end]))
        piece = np.searchsorted(begin, cuts, "right") - 1
        at = np.flatnonzero(cuts < end[piece])
        first, last = cuts[at], cuts[at + 1] - 1
        place = (least[first] & _LOW).astype(np.int64)
        self.owner = np.array([i for i, _ in pieces])[piece[at]]
        self.shape = np.stack([place - first, last - first], 1).astype(np.uint8)
        self.near, self.next = grams[place], grams[place + GRAM]
        ends_name = _refined(string_names(grams, first), string_names(grams, last))
        self.kind = _refined(ends_name, ((place - first) * (LENGTH + 1) + last - first).astype(np.uint64))


def anchors_of(texts: list[bytes]) -> Iterator[Anchors]:
    """Anchors of all texts, in their order, pieces of HELD bytes at a time, so that arrays stay in a core's cache. A run that a piece's end cuts is two classes."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for begin in range(0, len(text) - LENGTH + 1, PIECE):
            piece = text[begin : begin + PIECE + LENGTH - 1]
            if held and size + len(piece) > HELD:
                yield Anchors(held)
                held, size = [], 0
            held.append((number, piece))
            size += len(piece)
    if held:
        yield Anchors(held)


def runs_of(shapes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, anchor and last start of a text's anchors, by their shapes."""
    to_place, to_last = np.frombuffer(shapes, np.uint8).reshape(-1, 2).T.astype(np.int64)
    first = np.cumsum(to_last + 1) - to_last - 1
    return first, first + to_place, first + to_last


def _long(text: bytes | None) -> bytes:
    return text if text is not None and len(text) >= LENGTH else b""


def _key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def anchored(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_bytes, sha256 (of the text), near, next, kinds, shapes (two bytes an anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            texts = [t or b"" for t in common.raw(batch, "text")]
            found = [(a.owner, a.near, a.next, a.kind, a.shape) for a in anchors_of([_long(t) for t in texts])]
            owner, *ids, shapes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.array([], np.int64)] * 5
            offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.view(np.int64))) for x in ids]
            lists.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets * 2), pa.py_buffer(shapes.tobytes())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_key(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), *lists], ["doc_id", "key", "n_bytes", "sha256", "near", "next", "kinds", "shapes"])

    return docs.mapInArrow(run, "doc_id long, key binary, n_bytes long, sha256 string, near array<long>, next array<long>, kinds array<long>, shapes binary")


def packed(docs: DataFrame) -> DataFrame:
    """key, packed: compressed texts of LENGTH bytes or more, for dealing out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t for t in common.raw(batch, "text") if _long(t)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(t) for t in texts], pa.binary()), pa.array([pack.compress(t) for t in texts], pa.binary())], ["key", "packed"])

    return docs.mapInArrow(run, "key binary, packed binary")


def _asked_pieces(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """(bytes, where in its text it begins, row or None, first starts, anchors, last starts in it) of pieces, HELD bytes at a time.

    rows: (row, text, shapes, open, shown: places in the list of anchors).
    """
    held, size = [], 0
    for row, text, shapes, opened, shown in rows:
        runs = runs_of(shapes)
        for own, asked in ((row, opened), (None, shown)):
            picked = np.array(sorted(asked or ()), np.int64)
            pieces = runs[0][picked] // PIECE
            for begin in (np.unique(pieces) * PIECE).tolist():
                piece = text[begin : begin + PIECE + LENGTH - 1]
                if held and size + len(piece) > HELD:
                    yield held
                    held, size = [], 0
                held.append((piece, begin, own, *(x[picked[pieces == begin // PIECE]] - begin for x in runs)))
                size += len(piece)
    if held:
        yield held


def starts_of(held: list[tuple]) -> pa.RecordBatch:
    """name, more, row, start of all starts of some _asked_pieces."""
    offset = np.cumsum([0, *(len(p[0]) for p in held)])
    grams = buckets(np.frombuffer(b"".join(p[0] for p in held), np.uint8), GRAM)
    first, place, last = (np.concatenate([p[i] + at for p, at in zip(held, offset, strict=False)]) for i in (3, 4, 5))
    more = (_refined(grams[place + GRAM], grams[place]) >> np.uint64(32)).astype(np.uint32).view(np.int32)  # to go with the names of its starts
    runs, anchors = last - first + 1, [len(p[3]) for p in held]
    starts = np.arange(runs.sum()) + np.repeat(first - np.cumsum(runs) + runs, runs)
    shift = np.repeat(np.array([p[1] for p in held]) - offset[:-1], anchors)
    row = np.repeat(np.array([p[2] or 0 for p in held], np.int64), anchors)
    unseen = np.repeat(np.array([p[2] is None for p in held]), anchors)
    columns = [string_names(grams, starts).view(np.int64), np.repeat(more, runs), pa.array(np.repeat(row, runs), mask=np.repeat(unseen, runs)), (starts + np.repeat(shift, runs)).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "more", "row", "start"])


def open_starts(rows: DataFrame) -> DataFrame:
    """name, more, row, start of rows (row, packed, shapes, open, shown: places in the row's list of anchors); row is null for shown ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        asked = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("row", "packed", "shapes", "open", "shown")), strict=True))
        for held in _asked_pieces((row, unpack.decompress(data), *more) for row, data, *more in asked):
            yield starts_of(held)

    return rows.mapInArrow(run, "name long, more int, row long, start int")


def cut(text: bytes, shapes: bytes, whole: list[int] | None, starts: list[int] | None) -> tuple[int, int, str, bytes, list[dict]]:
    """n_removed, n_spans, kept_sha256, kept, spans of a text whose repeated strings begin at all starts of anchors and at single ones."""
    first, _, last = runs_of(shapes)
    picked, starts = np.array(whole or [], np.int64), np.array(starts or [], np.int64)
    edge = np.zeros(len(text) + 2, np.int32)
    np.add.at(edge, np.concatenate([first[picked], starts]), 1)
    np.add.at(edge, np.concatenate([last[picked], starts]) + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept, cuts = np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes(), np.flatnonzero(gone[1:] != gone[:-1]) + 1
    if gone[0]:
        cuts = np.append(0, cuts)
    begins, ends = cuts[::2].tolist(), cuts[1::2].tolist()
    return int(gone.sum()), len(begins), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in zip(begins, ends, strict=True)]


def removed(rows: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256, kept, spans of rows (key, packed, shapes, whole: places of anchors, starts)."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["key", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for batch in batches:
            out, size = [], 0
            for key, data, *told in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "shapes", "whole", "starts")), strict=True):
                out.append((key, *cut(unpack.decompress(data), *told)))
                size += len(out[-1][4])
                if size > 1 << 20:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    return rows.mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")


def removals(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_bytes, sha256 of each row of docs; what is removed from each text that loses bytes, by key)."""
    found = common.written(anchored(docs).select(F.monotonically_increasing_id().alias("row"), "*"), f"{folder}/anchors")

    each = found.select("row", F.posexplode(F.arrays_zip("near", "next", "kinds"))).select("row", F.col("pos").alias("place"), "col.near", "col.next", F.col("col.kinds").alias("kind"))
    # what is joined on is a written table each time: a join of plain exchanges is one whose hot keys are split at run time
    repeated = common.written(each.groupBy("near").count().where("count > 1").select("near"), f"{folder}/repeated")
    live = common.written(each.join(repeated, "near", "left_semi"), f"{folder}/live")
    bucket = ["near", "next"]
    kinds = common.written(live.groupBy(*bucket, "kind").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")), f"{folder}/kinds")
    mixed = kinds.groupBy(*bucket).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select(*bucket)
    mixed = common.written(mixed, f"{folder}/mixed")
    whole = live.join(kinds.where("n > 1").select(*bucket, "kind"), [*bucket, "kind"], "left_semi").select("row", "place", F.lit("whole").alias("what"))
    closer = kinds.join(mixed, bucket, "left_semi").select("one.row", "one.place", F.when(F.col("n") == 1, "open").otherwise("shown").alias("what"))
    places = lambda what: F.collect_list(F.when(F.col("what") == what, F.col("place"))).alias(what)
    told = common.written(whole.union(closer).groupBy("row").agg(places("whole"), places("open"), places("shown")).join(found.select("row", "key", "shapes"), "row"), f"{folder}/told")

    texts = packed(docs)
    asked = told.where(F.size("open") + F.size("shown") > 0).select("row", "key", "shapes", "open", "shown")
    starts = common.written(open_starts(texts.dropDuplicates(["key"]).join(asked, "key").select("row", "packed", "shapes", "open", "shown")), f"{folder}/starts")
    twice = common.written(starts.groupBy("name", "more").count().where("count > 1").select("name", "more"), f"{folder}/twice")
    more = starts.where("row IS NOT NULL").join(twice, ["name", "more"], "left_semi").groupBy("row").agg(F.collect_list("start").alias("starts"))
    spans = told.select("row", "key", "shapes", "whole").join(more, "row", "left").where("size(whole) > 0 OR starts IS NOT NULL")
    one = spans.groupBy("key").agg(F.first("shapes").alias("shapes"), F.max_by("whole", F.size("whole")).alias("whole"), F.max_by("starts", F.coalesce(F.size("starts"), F.lit(0))).alias("starts"))
    return found.select("doc_id", "key", "n_bytes", "sha256"), removed(texts.dropDuplicates(["key"]).join(one, "key"))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes, null where all stay), spans (removed, as byte offsets) per row of docs (doc_id, text)."""
    rows, cut = removals(_prepared(docs), common.scratch(docs.sparkSession, "suffixes"))
    return rows.join(cut, "key", "left").select("doc_id", "kept", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs (doc_id, text).

    A byte goes if a LENGTH-byte string that covers it also starts elsewhere, in the same text or another; matches stay
    inside a text. Null text is empty; repeated rows repeat each other; an empty table gives no rows.
    """
    rows, cut = removals(_prepared(docs), common.scratch(docs.sparkSession, "suffixes"))
    none = F.lit(0).cast("long")
    return rows.join(cut.drop("kept", "spans"), "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
