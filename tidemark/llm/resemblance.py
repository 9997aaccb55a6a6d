"""Near-duplicates by resemblance: components of texts whose sets of SHINGLE-word shingles have Jaccard similarity 0.8 or more.

They are retrieved by SimHash. The SimHash operator's 64 bits and its radius of 3 find near copies only: at 0.8 about 15 % of
the bits differ, which no block of a short fingerprint survives for sure. So fingerprints have WORDS * 64 bits, and each of
TABLES tables is a choice of KEY of them, under which texts meet: a pair at 0.8 agrees on one with probability (1 - 0.15)^16 =
0.07, so in one table or more with probability 0.9999 (0.999, as tables share bits), closer ones more surely.

1. Inside a table's bucket BK-trees over FILTER words of the fingerprints find pairs within NEAR bits (at 0.8, all but one in
   10^5; unrelated ones one in 10^5 as well). Texts that such pairs link inside a bucket are a band. A band's rows then get
   their whole fingerprints and are linked anew within FAR of all bits, which unlinks what is only alike in the few.
2. Each text is compared with the text that comes first in most of its bands, exactly. So a group of copies costs one
   comparison a text.
3. Texts that share bands, directly or over others, form a group. Where a group isn't one component yet, its texts meet in
   a task: those of different components within FAR bits are counted against each other, and what may reach 0.8 is compared
   exactly. A group over LARGE texts, or BYTES of them, is dealt out as pairs of blocks of its texts, so a task's texts are
   bounded and no pair is lost: a text is dealt once a block, however many bands it is in. Groups of over WHOLE blocks are
   dealt out by single bands instead where that is fewer rows.

Only texts that share a band are dealt out, compressed: a sieve of fixed size tells most others apart where they are read.
Texts and sets of shingles are told apart by 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.graph import components, local_roots
from tidemark.llm.simhash import BkForest, bits_of, shingle_hashes

SHINGLE, LARGE, BYTES, WHOLE = 5, 1000, 8 << 20, 16
#: Words of a fingerprint, those that trees search, bits in which they may differ, tables, bits of a table's key.
WORDS, FILTER, NEAR, TABLES, KEY = 8, 2, 38, 144, 16
#: Bits of whole fingerprints in which similar texts may differ: at 0.8 they differ in 78 (one in 10^10 in more than this), 4 of 5 shingles in 96 (one in 50,000).
FAR = 132
#: A bucket of more rows is dealt out as pairs of blocks; so many rows go to a task.
CROWD, SHARD = 20_000, 100_000
_RNG = np.random.default_rng(7)
#: Odd factors: each turns the hashes into another word's.
_FACTORS = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits of each table's key.
_CHOICES = np.array([_RNG.choice(64 * WORDS, KEY, replace=False) for _ in range(TABLES)])
#: Places in the table where a text's shingles are marked.
MARKS = 1 << 20
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes) -> np.ndarray:
    """The set of hashes of shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of hashes, a row of WORDS words."""
    out = np.empty((len(sets), WORDS), np.uint64)
    for word, factor in enumerate(_FACTORS):
        mixed = []
        for own in sets:
            x = own * factor
            x ^= x >> np.uint64(32)
            x *= _MIX
            x ^= x >> np.uint64(29)
            mixed.append(x)
        out[:, word] = bits_of(mixed)
    return out


def halves(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles; 0, 0 without words."""
    digest = xxhash.xxh128_intdigest(own.tobytes()) if len(own) else 0
    return digest >> 64, digest & (1 << 64) - 1


def text_hashes() -> dict[str, Column]:
    """h0, h1: 128 bits of the text; null has its own."""
    text = F.col("text").cast("string")
    return {"h0": F.xxhash64(text), "h1": F.xxhash64(F.lit(7), text)}


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h0, h1, s0, s1 (digest of the set of shingles), bits (the fingerprint; null without words) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1 << 20):
            sets = [shingles(t or b"") for t in common.raw(batch, "text")]
            digests = np.array([halves(own) for own in sets], np.uint64).reshape(-1, 2).view(np.int64)
            bits = [row.tobytes() if len(own) else None for row, own in zip(fingerprints(sets), sets, strict=True)]
            columns = [*(pa.array(digests[:, i].copy()) for i in (0, 1)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h0", "h1")), *columns], ["doc_id", "h0", "h1", "s0", "s1", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(v.alias(k) for k, v in text_hashes().items()), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h0 long, h1 long, s0 long, s1 long, bits binary")


def tabled(rows: DataFrame) -> DataFrame:
    """bucket (table and key), fp, w0, w1 (words that trees search) of rows (fp, bits): a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
                keys = np.packbits(np.unpackbits(bits, axis=1, bitorder="little")[:, _CHOICES], axis=2).view(f"u{KEY // 8}").reshape(-1, TABLES)
                buckets = (keys.astype(np.int64) + (np.arange(TABLES) << KEY)).astype(np.int32).ravel()
                words = bits.view(np.int64)
                each = [batch.column("fp").to_numpy(), *(words[:, i] for i in range(FILTER))]
                yield pa.RecordBatch.from_arrays([pa.array(buckets), *(pa.array(np.repeat(x, TABLES)) for x in each)], ["bucket", "fp", "w0", "w1"])

    return rows.mapInArrow(run, "bucket int, fp long, w0 long, w1 long")


def bands_of(table: pa.Table, near: int | None = None) -> pa.Table:
    """fp, band, first (the least fp of the band) of a shard's rows (key, fp, w0, w1 or more words): those that are linked within near bits (by default NEAR) inside a key.

    In large keys the star of one of three texts, if it is large, is linked first, and only other texts search: so a crowd of
    near copies isn't expanded into its pairs, and no link is lost, as any that is left has an end outside the star.
    """
    near = NEAR if near is None else near
    key, fp, *words = (table.column(c).to_numpy() for c in ("key", "fp", *(c for c in table.column_names if c not in ("key", "fp"))))
    order = np.lexsort((fp, key))
    key, starts = key[order], np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]))
    sizes = np.diff(np.append(starts, len(key)))
    order, fp = order[np.repeat(sizes > 1, sizes)], fp[order][np.repeat(sizes > 1, sizes)]
    key, sizes = key[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    forest = BkForest(key, np.stack(words, axis=1)[order].view(np.uint64))
    n, starts = len(fp), np.cumsum(sizes) - sizes
    root, asks = np.arange(n), np.ones(n, bool)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own = np.arange(start, start + size)
        stars = [(own[forest.distance(own, np.full(size, start + size * i // 4)) <= near], start + size * i // 4) for i in (1, 2, 3)]
        star, centre = max(stars, key=lambda s: len(s[0]))
        root[star] = star[0]
        asks[star[star != centre]] = False
    asked = np.flatnonzero(asks)
    for begin in range(0, len(asked), 4096):
        a, b = forest.links(asked[begin : begin + 4096], near, later=True)
        if len(a):
            root = local_roots(n, np.concatenate([np.arange(n), root[a]]), np.concatenate([root, root[b]]))
    many = np.bincount(root, minlength=n)[root] > 1
    first = fp[root[many]]
    band = key[many].view(np.uint64) * _MIX
    band = (band ^ band >> np.uint64(31)) * _FACTORS[0] + first.view(np.uint64) * _FACTORS[1]
    return pa.table({"fp": fp[many], "band": band.view(np.int64), "first": first})


def banded(each: DataFrame, folder: str) -> DataFrame:
    """fp, band, first of each (fp, bits): the bands of a text, as far as others are in them."""
    spark, rows = each.sparkSession, each.select("fp", "bits").where("bits IS NOT NULL")
    met = tabled(rows).withColumn("key", F.col("bucket").cast("long"))
    # a sixteenth of the texts tells which buckets are crowded; all rows are dealt out either way
    some = tabled(rows.where(F.pmod(F.xxhash64("fp"), F.lit(16)) == 0)).groupBy("bucket").agg((16 * F.count("*")).alias("n")).where(F.col("n") > CROWD)
    some = common.written(some.select("bucket", F.ceil(2 * F.col("n") / CROWD).cast("int").alias("blocks")), f"{folder}/crowded")
    if not some.isEmpty():
        crowded = met.join(some, "bucket").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = crowded.withColumn("key", F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j"))).select(met.columns)
        met = met.join(some, "bucket", "left_anti").select(met.columns).unionByName(pairs)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-TABLES * each.count() // SHARD))
    dealt = met.select("key", "fp", "w0", "w1", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(lambda t: bands_of(t.select(["key", "fp", "w0", "w1"])), "fp long, band long, first long")


def tightened(shared: DataFrame, each: DataFrame) -> DataFrame:
    """fp, band, first of shared (the same), with bands cut into what whole fingerprints of each (fp, bits) link within FAR bits."""

    def run(table: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.int64).reshape(-1, WORDS)
        return bands_of(pa.table({"key": table.column("band"), "fp": table.column("fp"), **{f"w{i}": bits[:, i].copy() for i in range(WORDS)}}), FAR)

    shards = max(int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shared.count() // SHARD))
    rows = shared.select("fp", "band").join(each.select("fp", "bits"), "fp").withColumn("shard", F.pmod(F.xxhash64("band"), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(lambda t: run(t.select(["band", "fp", "bits"])), "fp long, band long, first long")


def packed(rows: DataFrame) -> DataFrame:
    """h0, h1, text (compressed) of rows (h0, h1, text), for dealing out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("h0"), batch.column("h1"), pa.array([pack.compress(t or b"") for t in common.raw(batch, "text")], pa.binary())], ["h0", "h1", "text"])

    return rows.mapInArrow(run, "h0 long, h1 long, text binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (ascending) have a Jaccard similarity of 4/5 or more."""
    small, big = sorted((len(a), len(b)))
    return 5 * small >= 4 * big and 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (small + big)


def first_links(pairs: DataFrame) -> DataFrame:
    """Of rows (a, text_a, b, text_b: compressed texts) the similar ones' (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            last, other, keep = None, None, []
            for mine, t in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if t != last:
                    last, other = t, shingles(unpack.decompress(t))
                keep.append(similar(shingles(unpack.decompress(mine)), other))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def shard_links(table: pa.Table) -> pa.Table:
    """A shard's links (a, b) between the components (root) that they join: rows (key, root, text)."""
    table = table.sort_by("key")
    keys, known = (table.column(c).to_numpy() for c in ("key", "root"))
    unpack = zstandard.ZstdDecompressor()
    sets = [shingles(unpack.decompress(t)) for t in table.column("text").to_pylist()]
    bits, sizes = fingerprints(sets), np.array([len(own) for own in sets], np.int64)
    nodes, of = np.unique(known, return_inverse=True)
    top, linked = np.arange(len(nodes)), []
    # shingles meet in places of a table: what two texts share there is never less than what they share
    places = np.concatenate(sets).astype(np.uint32) & np.uint32(MARKS - 1) if sets else np.array([], np.uint32)
    begins, marks = np.cumsum(sizes) - sizes, np.zeros(MARKS, np.uint8)
    first = np.searchsorted(keys, keys)
    for i, low in enumerate(first.tolist()):
        far = np.zeros(i - low, np.int64)
        for word in range(WORDS):
            far += np.bitwise_count(bits[low:i, word] ^ bits[i, word])
        small, big = np.minimum(sizes[low:i], sizes[i]), np.maximum(sizes[low:i], sizes[i])
        asked = low + np.flatnonzero((far <= FAR) & (5 * small >= 4 * big) & (top[of[low:i]] != top[of[i]]))
        if len(asked) > 8:
            own = places[begins[i] : begins[i] + sizes[i]]
            marks[own] = 1
            # that many of the other's shingles are marked, places of its own that meet counted each
            both = np.add.reduceat(marks[places[begins[low] : begins[i]]], begins[low:i] - begins[low], dtype=np.int64)
            marks[own] = 0
            asked = asked[9 * both[asked - low] >= 4 * (sizes[asked] + sizes[i])]
        for j in asked.tolist():
            a, b = top[of[i]], top[of[j]]
            if a != b and similar(sets[i], sets[j]):
                top[top == a] = b
                linked.append((known[i], known[j]))
    return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})


def blocks_of(n: Column, size: Column) -> Column:
    """Blocks of at most LARGE texts and BYTES, about, that so many texts of that size in all make."""
    return F.greatest(F.lit(1), F.ceil(n / LARGE), F.ceil(size / BYTES)).cast("int")


def dealt(members: DataFrame) -> DataFrame:
    """members (key, fp, root, size, blocks: of the key) with keys of one block as they are, larger ones as pairs of blocks."""
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    each = members.select("key", "fp", "root", "size", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    return each.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp", "root", "size")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, h0, h1 (of the text), component of each row of docs (doc_id, text): equal for texts that similarities link.

    Texts without words are alike; null counts as empty. Repeated rows give rows of their own, an empty table gives none.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession, "resemblance")
    marked = common.written(sketches(docs).select(F.monotonically_increasing_id().alias("row"), "*"), f"{folder}/sketches")
    # a set of shingles goes by its first row's number: fp
    each = common.written(marked.groupBy("s0", "s1").agg(F.min("row").alias("fp"), F.first("bits").alias("bits"), F.min(F.struct("h0", "h1")).alias("h")), f"{folder}/distinct")
    shared = common.written(tightened(common.written(banded(each, folder), f"{folder}/loose"), each), f"{folder}/shared")
    groups = common.written(components(shared.select(F.col("fp").alias("a"), F.col("first").alias("b")), f"{folder}/groups").withColumnsRenamed({"node": "fp", "root": "group"}), f"{folder}/group")

    chosen = common.written(each.select("fp", "h.h0", "h.h1").join(groups.select("fp"), "fp"), f"{folder}/chosen")
    near = common.sifted(docs.select(*(v.alias(k) for k, v in text_hashes().items()), F.col("text").cast("string").alias("text")), "h0", common.sieve(chosen, "h0", f"{folder}/sieve"), True)
    texts = packed(near).join(chosen, ["h0", "h1"]).groupBy("fp").agg(F.min("text").alias("text"))
    texts = common.written(texts.withColumn("size", F.octet_length("text").cast("long")), f"{folder}/texts")
    votes = shared.where("fp <> first").groupBy(F.col("fp").alias("a"), "first").agg(F.count("*").alias("votes"))
    pairs = votes.groupBy("a").agg(F.max(F.struct("votes", "first")).alias("most")).select("a", F.col("most.first").alias("b"))
    pairs = common.written(pairs, f"{folder}/pairs").join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    links = common.written(first_links(pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b").select("a", "text_a", "b", "text_b")), f"{folder}/first")
    roots = common.written(components(links, f"{folder}/first-components"), f"{folder}/first-roots")

    members = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "group", F.coalesce("root", "fp").alias("root")).join(texts.select("fp", "size"), "fp")
    members = common.written(members, f"{folder}/members")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), blocks_of(F.count("*"), F.sum("size")).alias("blocks"), F.min("root").alias("least"), F.max("root").alias("most"))
    open_ = common.written(sizes.where("least <> most").select("group", "n", "blocks"), f"{folder}/open")
    keyed = members.join(open_.select("group", "blocks"), "group").select("group", F.col("group").alias("key"), "fp", "root", "size", "blocks")
    vast = open_.where(F.col("blocks") > WHOLE)
    if not vast.isEmpty():
        hot = members.join(vast.select("group"), "group", "left_semi").select("group", "fp", "root", "size")
        hot = common.written(shared.select("fp", "band").join(hot, "fp"), f"{folder}/hot")
        bands = hot.groupBy("group", "band").agg(F.count("*").alias("n"), blocks_of(F.count("*"), F.sum("size")).alias("blocks"), F.min("root").alias("least"), F.max("root").alias("most"))
        bands = common.written(bands.where("least <> most").select("group", "band", "n", "blocks"), f"{folder}/crowds")
        whole = vast.select("group", (F.col("n") * F.col("blocks")).alias("rows"))
        split = bands.groupBy("group").agg(F.sum(F.col("n") * F.col("blocks")).alias("by_band")).join(whole, "group").where("by_band < rows").select("group")
        split = common.written(split, f"{folder}/split")
        by_band = hot.join(split, "group", "left_semi").join(bands.select("band", "blocks"), "band").select("group", F.col("band").alias("key"), "fp", "root", "size", "blocks")
        keyed = keyed.join(split, "group", "left_anti").union(by_band)
    keyed = common.written(dealt(keyed), f"{folder}/keyed")
    rows = keyed.drop("size").join(texts.select("fp", "text"), "fp")
    size = keyed.agg(F.sum("size")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 20)))
    more = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(lambda t: shard_links(t.select(["key", "root", "text"])), "a long, b long")
    more = common.written(more, f"{folder}/more")
    of = members.select("fp", "root")
    if not more.isEmpty():
        higher = common.written(components(more, f"{folder}/components"), f"{folder}/roots").withColumnsRenamed({"root": "above"})
        of = of.join(higher, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("above", "root").alias("root"))
    of_set = common.written(each.select("s0", "s1", "fp").join(of, "fp", "left").select("s0", "s1", F.coalesce("root", "fp").alias("component")), f"{folder}/of-sets")
    return marked.select("doc_id", "h0", "h1", "s0", "s1").join(of_set, ["s0", "s1"]).select("doc_id", "h0", "h1", "component")
