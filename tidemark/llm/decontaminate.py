"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is WINDOW consecutive words of an item; its tokens are its shingles of SHINGLE words (of all words, if fewer),
each a 64-bit hash. Tokens are ordered by rarity, which is counted over all documents. As the whole window must occur, its
necessary prefix is its one rarest token, and a window with a token that no document has is left out. Documents list the
places of prefix tokens with the words around, and are joined with the windows' prefixes on the token; its offset in the
window gives the only place where the window can begin, which must lie inside the document (positional and length bounds),
and there the words are compared. So hashes only choose candidates, and the result is exact.

Tasks first look tokens up in a filter of FILTER_BITS bits, whatever the number of windows; it lets all of them through and a
few others, which the joins then drop. So the benchmark itself never passes through the driver or a task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

WINDOW, SHINGLE, FILTER_BITS = 10, 3, 1 << 26
#: A-Z lower-cased, 0-9, a-z and bytes from 0x80 on kept, all else a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Odd factors of the words of a token, by place.
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class _Hashes(dict):
    """Words' hashes; some are kept, as many as fit 35 MB or so."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def tokens_of(words: list[bytes], hashes: _Hashes, size: int) -> np.ndarray:
    """The hash of the shingle of size words that begins at each place."""
    n = len(words) - size + 1
    if n <= 0:
        return np.array([], np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i : i + n] * _FACTORS[i]
    return out.view(np.int64)


def windows_of(benchmark: DataFrame) -> DataFrame:
    """item, win (words), tokens of every window; an item of fewer words than WINDOW, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for batch in common.slices(iter([whole]), "text"):
                items, wins, tokens = [], [], []
                for item, text in zip(batch.column(0).to_pylist(), common.raw(batch, "text"), strict=True):
                    words = words_of(text)
                    size = min(SHINGLE, len(words))
                    own = tokens_of(words, hashes, size) if words else None
                    for i in range(max(1, len(words) - WINDOW + 1)) if words else ():
                        win = words[i : i + WINDOW]
                        items.append(item)
                        wins.append(win)
                        tokens.append(own[i : i + len(win) - size + 1])
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(wins, pa.list_(pa.binary())), pa.array(tokens, pa.list_(pa.int64()))], ["item", "win", "tokens"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, win array<binary>, tokens array<long>").distinct()


def token_filter(tokens: DataFrame) -> Broadcast:
    """Bits of the hashes in the column token, as words of 64."""
    at = F.pmod("token", F.lit(FILTER_BITS))
    words = tokens.select((at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    rows = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return tokens.sparkSession.sparkContext.broadcast(bits)


def _passing(own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the tokens that the filter lets through."""
    at = own.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))


def frequencies(docs: DataFrame, known: Broadcast, sizes: list[int]) -> DataFrame:
    """token, n: in how many documents (text) each token that the filter lets through occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = known.value, _Hashes()
        for whole in batches:
            for batch in common.slices(iter([whole]), "text"):
                met = [np.array([], np.int64)]
                for text in common.raw(batch, "text"):
                    words = words_of(text)
                    for size in sizes:
                        own = tokens_of(words, hashes, size)
                        met.append(np.unique(own[_passing(own, bits)]))
                tokens, n = np.unique(np.concatenate(met), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n)], ["token", "n"])

    return docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def places(rows: DataFrame, known: Broadcast, sizes: list[int]) -> DataFrame:
    """rows without text, plus n_words and met: struct<token, at, offset, around>, where tokens that the filter lets through begin.

    around are the words that a window with the token there can reach, at their offset.
    """
    kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("offset", pa.int32()), ("around", pa.list_(pa.binary()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = known.value, _Hashes()
        for whole in batches:
            for batch in common.slices(iter([whole]), "text"):
                sums, out = [], []
                for text in common.raw(batch, "text"):
                    words, met = words_of(text), []
                    for size in sizes:
                        own = tokens_of(words, hashes, size)
                        for at in _passing(own, bits).tolist():
                            first = max(0, at - WINDOW + 1)
                            met.append({"token": int(own[at]), "at": at, "offset": at - first, "around": words[first : at + WINDOW]})
                    sums.append(len(words))
                    out.append(met)
                kept = batch.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sums, pa.int64()), pa.array(out, kind)], [*kept.schema.names, "n_words", "met"])

    return rows.mapInArrow(run, common.schema_plus(rows.drop("text"), n_words="long", met="array<struct<token:bigint,at:int,offset:int,around:array<binary>>>"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """token, place, win: each window's rarest token and where it stands in it; windows with a token that no document has are left out."""
    each = windows.select("win", F.posexplode("tokens").alias("place", "token")).distinct().join(counts, "token", "left")
    best = each.groupBy("win").agg(F.min(F.struct("n", "token", "place")).alias("b"), F.count_if(F.col("n").isNull()).alias("absent"))
    return best.where("absent = 0").select("b.token", "b.place", "win")


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, then n_words, n_hit, n_items, items_sha256, contaminated, for every row of docs.

    Null texts have no words; repeated rows are rows of their own. Repeated items count once; an item without an id is
    found but not listed. Without items or windows nothing is hit; an empty table gives no rows.
    """
    folder = common.scratch(docs.sparkSession, "decontaminate")
    windows = common.written(windows_of(benchmark), f"{folder}/windows")
    sizes = [r[0] for r in windows.select(F.least(F.size("win"), F.lit(SHINGLE)).alias("size")).distinct().collect()]  # SHINGLE values at most
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = frequencies(texts, token_filter(windows.select(F.explode("tokens").alias("token"))), sizes)
    wanted = common.written(prefixes(windows, counts), f"{folder}/prefixes")

    rows = docs.select(*(F.col(c).alias(f"__kept_{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = common.written(places(rows, token_filter(wanted.select("token")), sizes), f"{folder}/places")
    met = found.select("row", F.explode("met").alias("m")).select("row", "m.*")
    begin = F.col("offset") - F.col("place")
    fits = (begin >= 0) & (begin + F.size("win") <= F.size("around"))
    same = F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.size("win")) == F.col("win")
    hits = common.written(met.join(wanted, "token").where(fits).where(same).select("row", (F.col("at") - F.col("place")).alias("begin"), "win"), f"{folder}/hits")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("begin", F.size("win").alias("n"))), lambda s: F.sequence(s["begin"], s["begin"] + s["n"] - 1))))
    n_hit = hits.groupBy("row").agg(F.size(covered).cast("long").alias("n_hit"))
    items = hits.select("row", "win").distinct().join(windows.select("win", "item"), "win").where("item IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    facts = n_hit.join(items, "row", "left")
    none = F.lit(0).cast("long")
    return found.join(facts, "row", "left").select(
        *(F.col(f"__kept_{i}").alias(c) for i, c in enumerate(keep)),
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
