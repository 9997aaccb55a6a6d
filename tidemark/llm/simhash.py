"""SimHash near-duplicates: fingerprints, and links at RADIUS or fewer differing bits by BK-trees.

Two fingerprints that differ in at most 3 bits agree in one of four 16-bit blocks. Every distinct fingerprint goes to its
four (block, value) groups; a group too large for one tree is split again by blocks of the remaining bits, and what is too
large still, by pairs of blocks of fingerprints. Each group is
a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows only edges within RADIUS of
the query's distance. Trees travel with their shard of groups rather than being broadcast, as fingerprints have no bound.
A shard returns a spanning forest of its links, so its output is no larger than its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.graph import components, local_roots

SHINGLE, SEED, RADIUS, BLOCKS, LARGE = 3, 42, 3, 4, 20_000
#: A byte's bits, each in a byte of its own.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of the text's shingles of size words, with repeats. A-Z are lower-cased; words are split at ASCII white space."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    begins = [0, *accumulate(len(w) + 1 for w in words)]
    return [digest(joined[a : b - 1], SEED) for a, b in zip(begins, begins[size:], strict=False)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """A bit is 1 if set in over half of the shingles' hashes; 0 without words."""
    return bits_of([np.array(shingle_hashes(t), np.uint64) for t in texts])


def bits_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    if not sizes.sum():
        return out
    lanes = _SPREAD[np.concatenate(hashes).view(np.uint8).reshape(-1, 8)]
    ends = np.cumsum(sizes)
    cuts = [np.arange(end - n, end, 255) for end, n in zip(ends, sizes, strict=True)]  # 255 ones fit a lane
    owner = np.repeat(np.arange(len(hashes)), [len(c) for c in cuts])
    sums = np.add.reduceat(lanes, np.concatenate(cuts), axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    counts = np.add.reduceat(sums, firsts, axis=0)
    bits = (2 * counts > sizes[owner[firsts]][:, None]).astype(np.uint8)
    out[owner[firsts]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of docs (doc_id, text); null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = fingerprints_of([t or b"" for t in common.raw(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BkForest:
    """BK-trees over values (64 bits each, or rows of several such words), one for each group; built and searched level by level for all at once."""

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        self.values = values = values if values.ndim > 1 else values[:, None]
        self.span = 64 * values.shape[1] + 1
        _, spot = np.unique(groups, return_inverse=True)
        self.root_of, items, base = spot, np.argsort(spot, kind="stable"), 0
        spot, nodes, edges = spot[items], [], []
        keys = np.arange(spot.max() + 1 if len(spot) else 0)
        while len(items):
            first = np.flatnonzero(np.diff(spot, prepend=-1))  # a group's first item is its node
            nodes.append(items[first])
            edges.append(keys)
            rest = np.ones(len(items), bool)
            rest[first] = False
            at, items = spot[rest], items[rest]
            key = (base + at) * self.span + self.distance(items, nodes[-1][at])
            order = np.argsort(key, kind="stable")
            items, (keys, spot) = items[order], np.unique(key[order], return_inverse=True)
            base += len(first)
        self.node_item = np.concatenate(nodes) if nodes else np.array([], np.int64)
        self.child_keys = np.concatenate(edges[1:]) if len(edges) > 1 else np.array([], np.int64)  # parent * span + distance, ascending
        self.first_child = len(edges[0]) if edges else 0

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which items a and b differ."""
        return sum(np.bitwise_count(self.values[a, i] ^ self.values[b, i]).astype(np.int64) for i in range(self.values.shape[1]))

    def links(self, queries: np.ndarray, radius: int = RADIUS, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query item, earlier item of its group, or later ones too) at radius or fewer bits."""
        q, node, left, right = queries, self.root_of[queries], [], []
        while len(q):
            item = self.node_item[node]
            d = self.distance(q, item)
            hit = (d <= radius) & ((item != q) if later else (item < q))
            left.append(q[hit])
            right.append(item[hit])
            if not len(self.child_keys):
                break
            lo = np.searchsorted(self.child_keys, node * self.span + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.child_keys, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            node = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()) + self.first_child
        return (np.concatenate(left), np.concatenate(right)) if left else (np.array([], np.int64),) * 2


def forest_links(table: pa.Table) -> pa.Table:
    """A shard's links (a, b) between fingerprints, reduced to a spanning forest."""
    keys, values = table.column("bucket").to_numpy(), table.column("fp").to_numpy()
    forest, nodes = BkForest(keys, values.view(np.uint64)), np.unique(values)
    at, root = np.searchsorted(nodes, values), np.arange(len(nodes))
    for begin in range(0, len(values), 4096):
        a, b = forest.links(np.arange(begin, min(begin + 4096, len(values))))
        a, b = root[at[a]], root[at[b]]
        if len(a):
            root = local_roots(len(nodes), np.concatenate([np.arange(len(nodes)), a]), np.concatenate([root, b]))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": nodes[moved], "b": nodes[root[moved]]})


def halved(rows: DataFrame) -> DataFrame:
    """rows (fp, block, value, bucket) with buckets of over LARGE as pairs of blocks of theirs, so that each is a bounded task and no pair is lost."""
    sizes = rows.groupBy("bucket").count().where(f"count > {LARGE}")
    parts = F.ceil(2 * F.col("count") / LARGE).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts)
    crowded = rows.join(sizes, "bucket").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    crowded = crowded.select("fp", "block", "value", F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"))
    return rows.join(sizes, "bucket", "left_anti").select("fp", "block", "value", "bucket").unionByName(crowded)


def linked(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all of fps (distinct fp) at RADIUS or fewer bits."""
    spark, width = fps.sparkSession, 64 // BLOCKS
    key = lambda at: F.struct(F.lit(at).alias("block"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
    rows = fps.select("fp", F.explode(F.array(*(key(width * i) for i in range(BLOCKS)))).alias("g")).select("fp", "g.block", "g.value", F.xxhash64("g.block", "g.value").alias("bucket"))
    large = rows.groupBy("block", "value").count().where(f"count > {LARGE}").select("block", "value")
    if not large.isEmpty():  # split by four runs of the other 48 bits: within 3 bits, one run agrees
        hot = rows.join(large, ["block", "value"], "left_semi")
        others = lambda b: [(b + width + i * 12) % 64 for i in range(4)]
        rotated = lambda at: F.shiftrightunsigned("fp", at).bitwiseOR(F.shiftleft("fp", 64 - at) if at else F.lit(0)).bitwiseAND(F.lit(4095))
        split = None
        for b in range(0, 64, width):
            part = hot.where(F.col("block") == b).select("fp", "block", "value", F.explode(F.array(*(F.xxhash64("block", "value", F.lit(i), rotated(at)) for i, at in enumerate(others(b))))).alias("bucket"))
            split = part if split is None else split.unionByName(part)
        rows = rows.join(large, ["block", "value"], "left_anti").unionByName(halved(split))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-BLOCKS * fps.count() // 100_000))
    return rows.select("fp", "bucket", F.pmod("bucket", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(lambda t: forest_links(t.select(["bucket", "fp"])), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links, itself included.

    Repeated rows and equal texts share a fingerprint; documents without words have fingerprint zero. A component without
    any non-null doc_id has a null component_id. An empty table gives no rows.
    """
    folder = common.scratch(docs.sparkSession, "simhash")
    marked = common.written(fingerprints(docs), f"{folder}/fingerprints")
    fps = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    edges = common.written(linked(fps.select("fp")), f"{folder}/edges")
    roots = components(edges, f"{folder}/components")
    members = roots.join(fps, roots["node"] == fps["fp"]).select("fp", "root", "least")
    groups = members.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = fps.join(members.join(groups, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    of_fp = common.written(of_fp, f"{folder}/components-of-fingerprints")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
