"""Repeated passages of WINDOW words by super-k-mer partitioning.

A window's minimiser is the least hash among its runs of GRAM words. Consecutive windows with the same one are a super-k-mer:
their words travel as one packed string to the minimiser's bucket, where windows are sorted and equal ones stand together.
As a minimiser depends on its window's words alone, equal windows always meet in one bucket.

1. Of each document only its minimisers' hashes are dealt out, in blocks. One that a single row has can't hold a shared window,
   so only super-k-mers of the others are packed. What several rows of a block share is known there, and one of them is sent.
   Equal texts meet by their words: all but the first id's lose every window.
2. Packed strings are aggregated to distinct ones, by their hashes, with the least doc_id of each. Where a bucket has one, all
   its windows have that; else its distinct strings go to the bucket, where windows are sorted and each gets the least
   doc_id that has it. A window goes where that is smaller than the document's.
3. A bucket of over LARGE distinct strings (one passage in many surroundings) is dealt out again, window by window, and
   aggregated, so no task holds it.

Strings and texts are told apart by 128 bits of hashes; inside a bucket windows are compared word for word. A text is worked
on in one piece, so a task's memory follows its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.suffix_dedup import window_least

WINDOW, GRAM, LARGE, SHARD_BYTES, SHARD_ROWS = 13, 7, 20_000, 4 << 20, 1 << 20
#: Odd factors of the words of a run, by place.
_FACTORS = np.random.default_rng(13).integers(0, 1 << 63, GRAM, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


class _Hashes(dict):
    """Words' hashes; some are kept, as many as fit 50 MB or so."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def super_kmers(texts: list[list[bytes]], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimiser) of each super-k-mer, in order; a text of fewer words than WINDOW has none."""
    sizes = np.array([*map(len, texts)], np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return (np.array([], np.int64),) * 4
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), np.uint64, total)
    grams = np.zeros(total - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams += h[i : i + len(grams)] * _FACTORS[i]
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # of equal ones the leftmost
    least = (window_least(keys, WINDOW - GRAM + 1) & _LOW).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[: len(least)] == owner[WINDOW - 1 :]  # windows inside one text
    new = (np.diff(least, prepend=-1) != 0) | (np.diff(owner[: len(least)], prepend=-1) != 0)
    at = np.flatnonzero(whole & new)
    text, begins = owner[at], np.cumsum(sizes) - sizes
    first = at - begins[text]
    follows = np.append(text[1:] == text[:-1], False) if len(at) else np.array([], bool)
    n = np.where(follows, np.append(first[1:], 0)[: len(at)], sizes[text] - WINDOW + 1) - first
    return text, first, n, grams[least[at]].view(np.int64)


def windows_of(string: bytes) -> list[bytes]:
    words = string.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the words), n_words, sha256 (of all words, joined), minimisers of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for batch in common.slices(iter([whole]), "text"):
                texts = [(t or b"").split() for t in common.raw(batch, "text")]
                with_id = [w if i is not None else [] for w, i in zip(texts, batch.column("doc_id").to_pylist(), strict=True)]
                owner, *_, kinds = super_kmers(with_id, hashes)
                kinds = np.split(kinds, np.searchsorted(owner, np.arange(1, len(texts))))
                columns = [pa.array([_key(w) for w in texts], pa.binary()), pa.array([len(w) for w in texts], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in texts], pa.string()), pa.array(kinds, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "key", "n_words", "sha256", "minimisers"])

    return docs.mapInArrow(run, "doc_id long, key binary, n_words long, sha256 string, minimisers array<long>")


def compressed(docs: DataFrame) -> DataFrame:
    """key, words (joined and compressed) of texts of WINDOW words or more, for dealing out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in common.slices(batches, "text"):
            texts = [w for t in common.raw(batch, "text") if t and len(w := t.split()) >= WINDOW]
            yield pa.RecordBatch.from_arrays([pa.array([_key(w) for w in texts], pa.binary()), pa.array([pack.compress(b" ".join(w)) for w in texts], pa.binary())], ["key", "words"])

    return docs.mapInArrow(run, "key binary, words binary")


def _shared(kinds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by minimiser and row, whether each in that order has a minimiser that several rows have)."""
    order = np.lexsort((rows, kinds))
    kinds, rows = kinds[order], rows[order]
    first = np.flatnonzero(np.diff(kinds, prepend=kinds[0] - 1 if len(kinds) else 0) != 0) if len(kinds) else np.array([], np.int64)
    last = np.append(first[1:], len(kinds)) - 1
    return order, np.repeat(rows[first] != rows[last], last - first + 1)


def _block(kinds: np.ndarray, rows: np.ndarray, places: np.ndarray) -> bytes:
    """Entries as compressed bytes: rows as steps, so that they pack well. Rows ascend."""
    steps = np.diff(rows, prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(kinds.tobytes() + steps.tobytes() + places.astype(np.int32).tobytes())


def _entries(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = len(data) // 20
    return np.frombuffer(data, np.int64, n), np.cumsum(np.frombuffer(data, np.int64, n, 8 * n)), np.frombuffer(data, np.int32, n, 16 * n)


def shared_places(found: DataFrame) -> DataFrame:
    """row, place: of super-k-mers whose minimiser other rows have as well; found: a written table of row, minimisers. Some come twice."""
    total = found.agg(F.coalesce(F.sum(F.size("minimisers")), F.lit(0))).first()[0]
    shards = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("minimisers")
            sizes = np.diff(np.asarray(lists.offsets))
            kinds, rows = lists.flatten().to_numpy(), np.repeat(batch.column("row").to_numpy(), sizes)
            places = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if not len(kinds):
                continue
            order, live = _shared(kinds, rows)
            kinds, rows, places = kinds[order], rows[order], places[order]
            first = np.diff(kinds, prepend=kinds[0] - 1) != 0
            sent = ~live | first
            shard = (kinds.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)
            out = []
            for known, pick in ((False, sent), (True, live)):
                at = np.flatnonzero(pick)
                at = at[np.lexsort((rows[at], shard[at]))]
                for part in np.split(at, np.flatnonzero(np.diff(shard[at])) + 1) if len(at) else ():
                    out.append((int(shard[part[0]]), known, _block(kinds[part], rows[part], places[part])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["shard", "known", "block"])

    def met(table: pa.Table) -> pa.Table:
        parts = {k: [_entries(b) for b, known in zip(table.column("block").to_pylist(), table.column("known").to_pylist(), strict=True) if known == k] for k in (False, True)}
        out = [(rows, places) for _, rows, places in parts[True]]
        if parts[False]:
            kinds, rows, places = (np.concatenate(x) for x in zip(*parts[False], strict=True))
            order, live = _shared(kinds, rows)
            out.append((rows[order][live], places[order][live]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["row", "place"])

    dealt = found.select("row", "minimisers").where(F.size("minimisers") > 0).mapInArrow(blocks, "shard long, known boolean, block binary")
    return dealt.groupBy("shard").applyInArrow(lambda t: met(t.select(["known", "block"])), "row long, place int")


def strings_of(held: DataFrame) -> DataFrame:
    """row, doc, start (first window), n (windows), minimiser, packed of rows (row, doc, places: of super-k-mers, words: compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, hashes = zstandard.ZstdDecompressor(), _Hashes()
        for whole in batches:
            for batch in common.slices(iter([whole]), "words", 1 << 20):
                texts = [unpack.decompress(x).split(b" ") for x in batch.column("words").to_pylist()]
                owner, first, n, kinds = super_kmers(texts, hashes)
                begins = np.searchsorted(owner, np.arange(len(texts)))
                lists = batch.column("places")
                sizes = np.diff(np.asarray(lists.offsets))
                at = np.repeat(begins, sizes) + lists.flatten().to_numpy()
                row, doc = (pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("row", "doc"))
                strings = [b" ".join(texts[t][a:b]) for t, a, b in zip(owner[at].tolist(), first[at].tolist(), (first[at] + n[at] + WINDOW - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([row, doc, *(pa.array(x[at]) for x in (first, n, kinds)), pa.array(strings, pa.binary())], ["row", "doc", "start", "n", "minimiser", "packed"])

    return held.mapInArrow(run, "row long, doc long, start long, n long, minimiser long, packed binary")


def sorted_windows(table: pa.Table) -> pa.Table:
    """k0, k1, leasts (the least doc_id of each window) of a shard's strings (k0, k1, packed, least, most), where one is below most."""
    table = table.combine_chunks()
    own = [windows_of(s) for s in table.column("packed").to_pylist()]
    sizes = np.array([len(x) for x in own], np.int64)
    windows, least = pa.array([w for x in own for w in x], pa.large_binary()), np.repeat(table.column("least").to_numpy(), sizes)
    order = pc.sort_indices(windows)
    in_order = windows.take(order)
    begins = np.concatenate([[0], np.flatnonzero(pc.not_equal(in_order[1:], in_order[:-1]).to_numpy(zero_copy_only=False)) + 1])
    at = order.to_numpy()
    runs = np.diff(begins, append=len(at))
    lowest = np.empty(len(at), np.int64)
    lowest[at] = np.repeat(np.minimum.reduceat(least[at], begins), runs)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(lowest))
    some = pa.array(np.minimum.reduceat(lowest, begin[:-1]) < table.column("most").to_numpy())
    return pa.table({"k0": table.column("k0"), "k1": table.column("k1"), "leasts": lists}).filter(some)


def single_windows(strings: DataFrame) -> DataFrame:
    """k0, k1, most, least, at, win: every window of strings (k0, k1, packed, least, most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [windows_of(s) for s in batch.column("packed").to_pylist()]
            sizes = np.array([len(x) for x in own], np.int64)
            repeated = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("k0", "k1", "most", "least")]
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([*repeated, pa.array(at), pa.array([w for x in own for w in x], pa.binary())], ["k0", "k1", "most", "least", "at", "win"])

    return strings.select("k0", "k1", "most", "least", "packed").mapInArrow(run, "k0 long, k1 long, most long, least long, at long, win binary")


def removed(rows: DataFrame) -> DataFrame:
    """row, n_removed, kept_sha256, kept, spans (of removed words) of rows (row, words: compressed, starts: of windows that go)."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in common.slices(iter([whole]), "words", 1 << 20):
                out = []
                for row, data, starts in zip(*(batch.column(c).to_pylist() for c in ("row", "words", "starts")), strict=True):
                    words = unpack.decompress(data).split(b" ")
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.array(starts, np.int64), 1)
                    np.add.at(edge, np.array(starts, np.int64) + WINDOW, -1)
                    gone = np.cumsum(edge) > 0
                    kept = b" ".join(compress(words, (~gone).tolist()))
                    cuts = np.flatnonzero(np.diff(gone, prepend=False)).tolist()
                    out.append((row, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary(), spans), strict=True)], ["row", "n_removed", "kept_sha256", "kept", "spans"])

    return rows.select("row", "words", "starts").mapInArrow(run, "row long, n_removed long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")


def least_ids(distinct: DataFrame, strings: DataFrame, folder: str) -> DataFrame:
    """k0, k1, leasts of distinct strings (minimiser, k0, k1, least, most, n, row, start: of one that is so), those with a window to go.

    strings: row, start, packed. Both are written tables.
    """
    spark = distinct.sparkSession
    buckets = distinct.groupBy("minimiser").agg(F.count("*").alias("size"))
    several = common.written(buckets.where("size > 1"), f"{folder}/several")
    alone = distinct.where("least < most").join(several, "minimiser", "left_anti").select("k0", "k1", F.array_repeat("least", F.col("n").cast("int")).alias("leasts"))
    met = distinct.join(several, "minimiser").join(strings.select("row", "start", "packed"), ["row", "start"]).select("minimiser", "size", "k0", "k1", "packed", "least", "most")
    met = common.written(met, f"{folder}/met")
    size = met.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = met.where(f"size <= {LARGE}").select(F.pmod(F.xxhash64("minimiser"), F.lit(shards)).alias("shard"), "k0", "k1", "packed", "least", "most")
    columns = ["k0", "k1", "packed", "least", "most"]
    found = dealt.groupBy("shard").applyInArrow(lambda t: sorted_windows(t.select(columns)), "k0 long, k1 long, leasts array<long>")
    crowded = met.where(f"size > {LARGE}")
    if not several.where(f"size > {LARGE}").isEmpty():
        each = common.written(single_windows(crowded), f"{folder}/windows")
        lowest = common.written(each.groupBy("win").agg(F.min("least").alias("lowest")), f"{folder}/lowest")
        more = each.join(lowest, "win").groupBy("k0", "k1", "most").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lowest"))), lambda x: x["lowest"]).alias("leasts"))
        found = found.unionByName(more.where(F.exists("leasts", lambda x: x < F.col("most"))).drop("most"))
    return found.unionByName(alone)


def removals(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words, sha256 of each row of docs; key, first (its least doc_id), n_removed, kept_sha256, kept, spans of first's text)."""
    found = common.written(marked(docs).select(F.monotonically_increasing_id().alias("row"), "*"), f"{folder}/marked")
    able = found.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    firsts = able.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.max("doc_id").alias("last"))
    firsts = common.written(firsts.select("key", F.col("f.doc_id").alias("first"), F.col("f.row").alias("row"), "last"), f"{folder}/firsts")

    # what is joined on is a written table each time: a join of plain exchanges is one whose hot keys are split at run time
    asked = shared_places(found).groupBy("row").agg(F.collect_set("place").alias("places"))
    asked = asked.join(firsts.select("row", "key", F.col("first").alias("doc")), "row")
    asked = common.written(asked.withColumn("h", F.xxhash64("key")), f"{folder}/asked")
    texts = common.sifted(compressed(docs).withColumn("h", F.xxhash64("key")), "h", common.sieve(asked, "h", f"{folder}/sieve"), True).drop("h")
    held = common.written(texts.dropDuplicates(["key"]).join(asked, "key").select("row", "doc", "places", "words"), f"{folder}/held")

    strings = common.written(strings_of(held).withColumns({"k0": F.xxhash64("packed"), "k1": F.xxhash64(F.lit(7), "packed")}), f"{folder}/strings")
    one = F.min(F.struct("doc", "row", "start")).alias("one")
    distinct = strings.groupBy("minimiser", "k0", "k1").agg(one, F.max("doc").alias("most"), F.first("n").alias("n"))
    distinct = common.written(distinct.select("minimiser", "k0", "k1", F.col("one.doc").alias("least"), "most", "n", "one.row", "one.start"), f"{folder}/distinct")
    told = common.written(least_ids(distinct, strings, folder), f"{folder}/told")
    starts = F.filter(F.transform("leasts", lambda x, i: F.when(x < F.col("doc"), F.col("start") + i)), lambda x: x.isNotNull())
    gone = strings.select("row", "doc", "start", "k0", "k1").join(told, ["k0", "k1"]).select("row", starts.alias("starts")).where(F.size("starts") > 0)
    gone = common.written(gone.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts")), f"{folder}/gone")
    cut = removed(held.select("row", "words").join(gone, "row"))
    facts = firsts.join(cut, "row", "left").where("last > first OR n_removed IS NOT NULL").drop("row", "last")
    return found.select("doc_id", "key", "n_words", "sha256"), facts


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept (remaining words joined by a space, null where all stay), spans (removed, in words) per row of docs (doc_id, text).

    Nulls, repeated rows and empty tables as in dedup().
    """
    rows, facts = removals(_prepared(docs), common.scratch(docs.sparkSession, "super-kmers"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    later, same = F.col("doc_id") > F.col("first"), F.col("doc_id") == F.col("first")
    found = rows.join(facts, "key", "left")
    return found.select("doc_id", F.when(later, F.lit("")).when(same, F.col("kept").cast("string")).alias("kept"), F.when(later, all_).when(same, F.coalesce("spans", none)).otherwise(none).alias("spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of docs (doc_id, text).

    A word goes if a window of WINDOW words that covers it also starts in a document with a smaller doc_id; rows of one doc_id
    don't take from each other. A null text has no words; without a doc_id a row keeps all and takes nothing. Words are split
    at ASCII white space. An empty table gives no rows.
    """
    rows, facts = removals(_prepared(docs), common.scratch(docs.sparkSession, "super-kmers"))
    later, same, zero = F.col("doc_id") > F.col("first"), F.col("doc_id") == F.col("first"), F.lit(0).cast("long")
    found = rows.join(facts.drop("kept", "spans"), "key", "left")
    n = F.when(later, F.col("n_words")).when(same, F.coalesce("n_removed", zero)).otherwise(zero)
    sha = F.when(later, F.sha2(F.lit(""), 256)).when(same, F.coalesce("kept_sha256", "sha256")).otherwise(F.col("sha256"))
    return found.select("doc_id", "n_words", n.alias("n_removed"), sha.alias("kept_sha256"))
