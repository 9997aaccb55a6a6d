"""Exact top-k search by inner product: dual-tree search over cover trees.

Vectors are grouped by the nearest of some points of a bounded sample, one for each ROWS vectors and CENTRES at most; groups
are cut into blocks of at most about ROWS rows and QUERIES queries, each with a cover tree, made once and written. Query blocks
are sent to each group's data blocks, and each task descends a pair of trees together. A pair of blocks or of nodes is dropped
when the most that any of its inner products can be (from centres, covering radii and norms) is below the worst k-th score of
the queries there. Those start from scores against the sample, and grow by a first pass over the pairs of the same group,
before all other pairs. Every row is indexed and every answer is exact; ties go to the smaller vec_id.

A cover tree's node of level l covers its points within 2^l; its children are points of it, itself among them, more than
2^(l-1) apart, and cover it within that. It goes down to leaves of LEAF points or fewer, or of equal points. Where points
are all about as far apart, as random ones of many components are, one level parts them all, and bounds drop next to nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

LEAF, QUERIES, ROWS, SAMPLE, CENTRES = 32, 4096, 16_384, 2048, 256
#: Queries that are searched side by side; data points that are scored before what is left is judged again.
SIDE, STEP = 128, 1024
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(64 * x) of each component, a whole number as a double; vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    whole = lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * 64).cast("double")).otherwise(c * 64)  # noqa: E731  (beyond, all are whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def net(real: np.ndarray, first: int, radius: float) -> tuple[list[int], np.ndarray]:
    """Centres, first one of them, more than radius apart that cover all points within it, and each point's. Points are taken in their order."""
    squares, owner, centres = (real * real).sum(axis=1), np.full(len(real), -1), []
    open_ = np.concatenate([[first], np.delete(np.arange(len(real)), first)])
    while len(open_):
        some = open_[:64]
        near = squares[open_, None] - 2 * (real[open_] @ real[some].T) + squares[some] <= radius * radius
        free = np.ones(len(open_), bool)
        for k in range(len(some)):
            if free[k]:
                mine = free & near[:, k]
                mine[k] = True
                owner[open_[mine]] = len(centres)
                centres.append(int(some[k]))
                free &= ~mine
        open_ = open_[free]
    return centres, owner


class CoverTree:
    """Points in node order; of each node its run of points (begin, end), level, centre (place of a point of it), covering radius, run of children.

    Points are whole numbers as doubles.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        begin, end, level, centre, radius, children = [], [], [], [], [], []
        todo, at = [(0, len(ids), 0, None)] if len(ids) else [], 0
        while at < len(todo):
            lo, hi, middle, lev = todo[at]  # middle: the centre's place in points
            at += 1
            mine = points[order[lo:hi]]
            reach = float(np.sqrt(((mine - points[middle]) ** 2).sum(axis=1).max())) if hi - lo > 1 else 0.0
            lev = lev if lev is not None else int(np.ceil(np.log2(reach))) if reach else 0
            own = [len(todo), len(todo)]
            if hi - lo > LEAF and reach:
                below = min(lev, int(np.ceil(np.log2(reach)))) - 1
                start = int(np.flatnonzero(order[lo:hi] == middle)[0])
                while len((found := net(mine, start, 2.0**below))[0]) == 1:
                    below -= 1  # levels between have this node only
                lev = below + 1
                centres, owner = found
                places = order[lo:hi][centres]
                order[lo:hi] = order[lo:hi][np.argsort(owner, kind="stable")]
                ends = lo + np.cumsum(np.bincount(owner))
                todo += [(int(x), int(y), int(p), below) for x, y, p in zip([lo, *ends[:-1]], ends, places, strict=True)]
                own[1] = len(todo)
            for held, x in ((begin, lo), (end, hi), (level, lev), (centre, middle), (radius, reach), (children, own)):
                held.append(x)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.points = ids[order], points[order]
        self.begin, self.end, self.level = (np.array(x, np.int64) for x in (begin, end, level))
        self.centre, self.radius, self.children = place[centre] if len(ids) else np.array([], np.int64), np.array(radius), np.array(children, np.int64).reshape(-1, 2)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes' children, and those of them that have none."""
        first, n = self.children[nodes, 0], self.children[nodes, 1] - self.children[nodes, 0]
        opened = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.concatenate([opened, nodes[n == 0]])

    def leaves(self, nodes: np.ndarray) -> np.ndarray:
        return self.children[nodes, 0] == self.children[nodes, 1]


class Best:
    """Each query's k best (score, id) so far, and the least score that can still matter."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.score, self.id, self.floor, self.scored = k, np.full((n, k), NONE), np.full((n, k), NONE), floor.copy(), 0

    def add(self, rows: slice, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(own[:, None] == ids[None, :], NONE, scores)
        some = np.flatnonzero((scores >= self.floor[rows, None]).any(axis=1))
        if not len(some):
            return
        at = some + rows.start
        keep = np.flatnonzero((scores[some] >= self.floor[at].min()).any(axis=0))
        s = np.concatenate([self.score[at], scores[some][:, keep]], axis=1)
        i = np.concatenate([self.id[at], np.broadcast_to(ids[keep], (len(some), len(keep)))], axis=1)
        by = np.argsort(i, axis=1, kind="stable")
        s, i = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        by = np.argsort(~s, axis=1, kind="stable")[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        self.floor[at] = np.maximum(self.floor[at], self.score[at, -1])


def scores_of(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole numbers; those that don't fit 64 bits are the nearest that does."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < 1 << 52:
        return (queries @ data.T).astype(np.int64)
    if most < 1 << 62:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.vectorize(lambda x: min(MOST, max(NONE + 1, x)), otypes=[np.int64])(whole(queries) @ whole(data).T)


def search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Descend both trees together; then queries side by side, each with its own bounds, the most promising data first."""
    if not len(queries.ids) or not len(data.ids):
        return
    centres, norms = data.points[data.centre], np.sqrt((data.points[data.centre] ** 2).sum(axis=1))
    own_centres = queries.points[queries.centre]
    own_norms = np.sqrt((own_centres**2).sum(axis=1))
    sizes = np.sqrt((queries.points**2).sum(axis=1))

    def bounds(points: np.ndarray, size: np.ndarray, reach: float, nodes: np.ndarray) -> np.ndarray:
        """The most that inner products of points, or of what lies within reach of them, can be."""
        top = points @ centres[nodes].T
        spread = size[:, None] * data.radius[nodes] + reach * (norms[nodes] + data.radius[nodes])
        return top + spread + 1e-6 * (1 + np.abs(top) + (size[:, None] + reach) * (norms[nodes] + data.radius[nodes]))

    def side_by_side(lo: int, hi: int, nodes: np.ndarray) -> None:
        rows = slice(lo, hi)
        while True:
            tops = bounds(queries.points[rows], sizes[rows], 0.0, nodes)
            alive = (tops >= best.floor[rows, None]).any(axis=0)
            nodes, tops = nodes[alive], tops[:, alive]
            if data.leaves(nodes).all():
                break
            nodes = data.below(nodes)
        by = np.argsort(-(tops.max(axis=0) if len(nodes) else np.array([])), kind="stable")
        nodes, tops = nodes[by], tops[:, by]
        while len(nodes):
            n = data.end[nodes] - data.begin[nodes]
            now = max(1, int(np.searchsorted(np.cumsum(n), STEP, side="right")))
            part = np.repeat(data.begin[nodes[:now]] - np.cumsum(n[:now]) + n[:now], n[:now]) + np.arange(n[:now].sum())
            best.add(rows, queries.ids[rows], data.ids[part], scores_of(queries.points[rows], data.points[part]))
            best.scored += (hi - lo) * len(part)
            alive = (tops[:, now:] >= best.floor[rows, None]).any(axis=0)
            nodes, tops = nodes[now:][alive], tops[:, now:][:, alive]

    def descend(q: int, nodes: np.ndarray) -> None:
        lo, hi = int(queries.begin[q]), int(queries.end[q])
        top = bounds(own_centres[q : q + 1], own_norms[q : q + 1], float(queries.radius[q]), nodes)[0]
        nodes = nodes[top >= best.floor[lo:hi].min()]
        if not len(nodes):
            return
        first, last = queries.children[q]
        if first == last or hi - lo <= SIDE:
            side_by_side(lo, hi, nodes)
            return
        opened, child = data.below(nodes), int(first)
        while child < last:
            large = child
            while large < last and queries.end[large] - queries.begin[child] <= SIDE:
                large += 1
            if large - child <= 1:
                descend(child, opened)
                child += 1
            else:  # small children go together
                side_by_side(int(queries.begin[child]), int(queries.end[large - 1]), opened)
                child = large

    descend(0, np.array([0]))


def _points(lists: pa.ListArray, width: int) -> np.ndarray:
    """A matrix of vectors; shorter ones are padded with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    for i, (a, b) in enumerate(zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def grouped(rows: DataFrame, sample: np.ndarray, n: int) -> DataFrame:
    """rows plus group: the nearest of n points of the sample, picked farthest first."""
    real = sample
    nearest, picked = np.full(len(real), np.inf), [0]
    while len(picked) < min(n, len(real)):
        nearest = np.minimum(nearest, ((real - real[picked[-1]]) ** 2).sum(axis=1))
        picked.append(int(nearest.argmax()))
    centres = real[picked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch.column("v"), centres.shape[1])
            group = ((centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group.astype(np.int32))], [*batch.schema.names, "group"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, group int")


def blocks(rows: DataFrame, size: int, k: int, sample: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """block, group, centre, radius, norm, floor, tree: rows of a group in blocks of about size. With a sample, they are queries."""
    counts = rows.groupBy("group").agg(F.ceil(F.count("*") / size).alias("parts"))  # CENTRES rows
    dealt = rows.join(F.broadcast(counts), "group").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("v").chunk(0)
        ids, width = table.column("vec_id").to_numpy(), int(np.diff(np.asarray(lists.offsets)).max())
        tree = CoverTree(ids, _points(lists, max(width, sample[1].shape[1]) if sample else width))
        best = Best(len(ids), k, np.full(len(ids), NONE))
        if sample:
            search(tree, CoverTree(*sample), best)
        out = {"block": [f"{table.column('group')[0]}-{table.column('part')[0]}"], "group": [table.column("group")[0].as_py()], "centre": [tree.points[tree.centre[0]].tolist()], "radius": [float(tree.radius[0])], "norm": [float(np.sqrt((tree.points[tree.centre[0]] ** 2).sum()))], "floor": [int(best.floor.min())], "tree": [pickle.dumps((tree, best.floor))]}
        return pa.table(out, schema=pa.schema([("block", pa.string()), ("group", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64()), ("floor", pa.int64()), ("tree", pa.binary())]))

    return dealt.select("group", "part", "vec_id", "v").groupBy("group", "part").applyInArrow(pack, "block string, group int, centre array<double>, radius double, norm double, floor long, tree binary")


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best of each pair of blocks (queries, floors, data); floors: struct<query_id, floor>, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (queries, floor), (data, _) = (pickle.loads(batch.column(c)[i].as_py()) for c in ("queries", "data"))
                if known := batch.column("floors")[i].as_py():
                    better = {x["query_id"]: x["floor"] for x in known}
                    floor = np.maximum(floor, [better.get(q, NONE) for q in queries.ids.tolist()])
                best = Best(len(queries.ids), k, floor)
                search(queries, data, best)
                q, at = np.nonzero(best.score != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(best.id[q, at]), pa.array(best.score[q, at])], ["query_id", "vec_id", "score"])

    return pairs.select("queries", "floors", "data").mapInArrow(run, "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k best other rows.

    Shorter vectors count as padded with zeros. Repeated vec_ids are rows of their own, except that a row is never a
    candidate of a query with its own vec_id, and of repeated query ids the smallest vector asks. Scores are exact 64-bit
    integers; one that doesn't fit is the nearest that does, and ranks as that. A table without vectors or without queries
    gives no rows.
    """
    spark, folder = vectors.sparkSession, common.scratch(vectors.sparkSession, "topk")
    rows = common.written(quantised(vectors), f"{folder}/rows")
    width, n = rows.agg(F.max(F.size("v")), F.count("*")).collect()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    picked = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()  # SAMPLE vectors
    sample = picked.column("vec_id").to_numpy(), _points(picked.column("v").chunk(0), width)
    rows = common.written(grouped(rows, sample[1], min(CENTRES, -(-n // ROWS))), f"{folder}/grouped")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "group")).alias("x")).select("vec_id", "x.*")
    data = common.written(blocks(rows, ROWS, k, None), f"{folder}/data")
    queries = common.written(blocks(asked, QUERIES, k, sample), f"{folder}/queries")

    # query blocks are sent to each group, and there to its data blocks: by a key of up to CENTRES values, whatever the blocks
    groups = data.select("group").distinct()
    numbered = queries.select("block", "group", "centre", "radius", "norm", "floor", F.explode(F.lit([r[0] for r in groups.collect()])).alias("data_group"))  # CENTRES numbers
    known = data.select(F.col("block").alias("data_block"), F.col("group").alias("data_group"), F.col("centre").alias("c"), F.col("radius").alias("r"), F.col("norm").alias("n"))
    pairs = common.written(numbered, f"{folder}/sent").join(known, "data_group")
    dot = F.aggregate(F.zip_with("centre", "c", lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    spread = F.col("norm") * F.col("r") + F.col("radius") * (F.col("n") + F.col("r"))
    most = dot + spread + 1e-6 * (1 + F.abs(dot) + spread)
    pairs = common.written(pairs.select("block", "data_block", "floor", most.alias("most"), (F.col("group") == F.col("data_group")).alias("own")), f"{folder}/pairs")

    def round_(chosen: DataFrame, floors: DataFrame | None) -> DataFrame:
        trees = chosen.join(queries.select("block", F.col("tree").alias("queries")), "block").join(data.select(F.col("block").alias("data_block"), F.col("tree").alias("data")), "data_block")
        trees = trees.join(floors, "block", "left") if floors is not None else trees.withColumn("floors", F.lit(None).cast("array<struct<query_id:bigint,floor:bigint>>"))
        return searched(trees, k)

    near = common.written(best_of(round_(pairs.where("own").select("block", "data_block"), None), k), f"{folder}/near")
    block_of = near.where(f"rank = {k}").select("query_id", F.col("score").alias("floor"))
    homes = asked.select(F.col("vec_id").alias("query_id"), "group", F.col("v"))
    parts = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))  # CENTRES rows
    homes = homes.join(F.broadcast(parts), "group").select("query_id", F.concat_ws("-", "group", F.pmod(F.xxhash64("query_id", "v"), F.col("parts"))).alias("block"))
    floors = homes.join(block_of, "query_id", "left").groupBy("block").agg(F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("query_id", "floor"))).alias("floors"), F.min(F.coalesce("floor", F.lit(int(NONE)))).alias("worst"))
    floors = common.written(floors, f"{folder}/floors")  # a row per block
    rest = pairs.where("NOT own").join(floors.select("block", "worst"), "block").where(F.col("most") >= F.greatest("floor", "worst").cast("double")).select("block", "data_block")
    far = round_(rest, floors.select("block", "floors"))
    found = near.select("query_id", "vec_id", "score").union(far)
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
