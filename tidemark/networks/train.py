"""Training in steps: the gradients of a batch's rows are summed up, and Adam moves the model.

A step needs the model of the one before. On a small batch a step takes less than a Spark job to start, so an epoch is one job: its last
task gets the batches in their order, packed by the tasks before it, and makes the steps. On a large batch each step is a job
over the batch's folder: tasks make the gradients of their rows, which are summed in a tree. There what travels is one vector of
the model's size for each task; the model, of fixed size, goes out with the step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.networks import nets, tape
from tidemark.operators import evaluate, sampling
from tidemark.sources.scratch import scratch, written

#: Tasks' vectors that one task sums up.
FAN_IN = 16
#: Rows of the largest batch whose steps one task makes; rows of a piece of it, which normalised layers see at once; rows scored at once.
LONE_ROWS, PIECE_ROWS, SCORED_ROWS = 8192, 512, 1024


@dataclass
class Trained:
    """A network's kind and size with its weights and running statistics, and what standardises its inputs."""

    kind: str
    inputs: list[str]
    params: dict
    weights: nets.Weights
    running: nets.Weights
    mean: np.ndarray
    sd: np.ndarray
    epochs: int = 0
    precision: float = 0.0


def flat(named: nets.Weights, names: list[str]) -> np.ndarray:
    return np.concatenate([named[n].ravel() for n in names]) if names else np.array([])


def shaped(vector: np.ndarray, like: nets.Weights) -> nets.Weights:
    out, at = {}, 0
    for name, value in like.items():
        out[name] = vector[at : at + value.size].reshape(value.shape)
        at += value.size
    return out


def step(net: nets.Net, weights: nets.Weights, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int) -> tuple[float, nets.Weights, nets.Weights]:
    """(loss, gradients, statistics) of some rows, as sums over them."""
    p = nets.Pass({k: tape.Var(v) for k, v in weights.items()}, net.running, np.random.default_rng(seed))
    loss = tape.cross_entropy(net.logits(p, x), y, w)
    loss = loss if p.extra is None else loss + p.extra
    return float(loss.value), tape.derivatives(loss, p.weights), {k: v * len(x) for k, v in p.seen.items()}


@dataclass(frozen=True)
class Course:
    """Where a training is: the model's weights and statistics as vectors, Adam's two moments, and the steps taken."""

    theta: np.ndarray
    stats: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def moved(self, found: np.ndarray, rate: float, l2: float) -> Course:
        """After a step with these sums over rows: loss, number of rows, gradients and statistics."""
        if found[1] == 0:
            return self
        size, t = len(self.theta), self.steps + 1
        g = found[2 : 2 + size] / found[1] + l2 * self.theta
        first, second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
        theta = self.theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return Course(theta, 0.9 * self.stats + 0.1 * found[2 + size :] / found[1], first, second, t)

    def packed(self) -> bytes:
        return np.concatenate([[self.steps], self.theta, self.stats, self.first, self.second]).tobytes()

    def unpacked(self, data: bytes) -> Course:
        """The course of the same model that packed() gave."""
        v, size = np.frombuffer(data), len(self.theta)
        theta, stats, first, second = np.split(v[1:], np.cumsum([size, len(self.stats), size]))
        return Course(theta, stats, first, second, int(v[0]))


def probabilities(net: nets.Net, weights: nets.Weights, running: nets.Weights, x: np.ndarray) -> np.ndarray:
    return tape._sigmoid(net.logits(nets.Pass({k: tape.Var(v) for k, v in weights.items()}, running), x).value)


def sequences(df: DataFrame, inputs: list[str], steps: int, by: str = "client_id", order: tuple[str, ...] = ("t", "message_id")) -> DataFrame:
    """df plus x: the inputs of the row and of the `steps` - 1 rows of its client before it, oldest first; zeros where there are fewer."""
    own = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs))
    window = Window.partitionBy(by).orderBy(*(F.col(c).asc_nulls_last() for c in order)).rowsBetween(1 - steps, 0)
    rows = df.withColumn("__own", own).withColumn("__past", F.collect_list("__own").over(window))
    empty = F.array_repeat(F.lit(0.0), len(inputs))
    return rows.withColumn("x", F.flatten(F.concat(F.array_repeat(empty, steps - F.size("__past")), F.col("__past")))).drop("__own", "__past")


def vectors(df: DataFrame, inputs: list[str]) -> DataFrame:
    """df plus x: the inputs, nulls as 0."""
    return df.withColumn("x", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs)))


def moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation (1 where that is 0) of each input over rows and steps; zeros of padding count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            if len(x):
                n, mean, square = _joined(n, mean, square, len(x), (own := x.mean(axis=0)), ((x - own) ** 2).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (mean, square))], ["n", "mean", "square"])

    n, mean, square = 0, np.zeros(width), np.zeros(width)
    for r in rows.select("x").mapInArrow(run, "n long, mean array<double>, square array<double>").collect():  # two vectors for each task
        if r["n"]:
            n, mean, square = _joined(n, mean, square, r["n"], np.array(r["mean"]), np.array(r["square"]))
    sd = np.sqrt(square / max(1, n))
    return mean, np.where(sd > 0, sd, 1.0)


def _joined(n: int, mean: np.ndarray, square: np.ndarray, m: int, other: np.ndarray, others: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and squared deviations of two sets of rows together."""
    off = other - mean
    return n + m, mean + off * (m / (n + m)), square + others + off * off * (n * m / (n + m))


def _inputs(batch: pa.RecordBatch, width: int, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """[rows, inputs], or [rows, steps, inputs] of sequences, standardised."""
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1, width)
    return _standardised(x, mean, sd)


def _standardised(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    x = (x - mean) / sd
    return x[:, 0] if x.shape[1] == 1 else x


def batch_gradient(rows: DataFrame, model: Trained, seed: int, pos_weight: float) -> np.ndarray:
    """Sums over rows (x, label): loss, number of rows, gradients and statistics, one behind the other."""
    net = nets.net(model.kind, len(model.inputs), 0, **model.params)
    names, stats = list(net.weights), list(net.running)
    sent = rows.sparkSession.sparkContext.broadcast((model.weights, model.mean, model.sd))  # of the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean, sd = sent.value
        made = nets.net(model.kind, len(model.inputs), 0, **model.params)
        out = None
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            y = batch.column("label").to_numpy().astype(float)
            loss, grads, seen = step(made, weights, _inputs(batch, len(model.inputs), mean, sd), y, np.where(y == 1, pos_weight, 1.0), seed + number)
            one = np.concatenate([[loss, len(y)], flat(grads, names), flat(seen, stats)])
            out = one if out is None else out + one
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["v"])

    def summed(table: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([np.stack(table.column("v").to_numpy(zero_copy_only=False)).sum(axis=0).tolist()], pa.list_(pa.float64()))})

    parts = rows.select("x", "label").mapInArrow(run, "v array<double>")
    n = rows.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(n)).alias("g")).applyInArrow(lambda t: summed(t.select(["v"])), "v array<double>")
    found = parts.toArrow()  # FAN_IN vectors at most
    sent.destroy()
    return np.stack(found.column("v").to_numpy(zero_copy_only=False)).sum(axis=0)


def _own_memory() -> None:
    """Freed memory stays with the process (where its C library is told so this way), as each step takes the same again."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, 32 << 20)  # glibc's M_MMAP_THRESHOLD, at its highest
        mallopt(-1, 512 << 20)  # M_TRIM_THRESHOLD


def dealt(rows: DataFrame, count: int, pieces: int, seed: int, folder: str) -> DataFrame:
    """Rows (message_id, label, x), written by batch and piece: n of them in a row, inputs one behind the other and labels, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, last = pa.Codec("zstd", 1), [], None

        def packed() -> list:
            x, y = (np.concatenate(v) for v in zip(*held, strict=True))
            x = np.ascontiguousarray(x.T)
            return [last // pieces, last % pieces, len(y), x.shape[0], codec.compress(x.tobytes(), asbytes=True), y.tobytes()]

        for batch in batches:
            if not batch.num_rows:
                continue
            slots, y = batch.column("slot").to_numpy(), batch.column("label").to_numpy().astype(np.int32)
            x = batch.column("x").flatten().to_numpy().reshape(len(slots), -1)
            edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
            out = []
            for a, b in zip(edges, edges[1:]):
                if held and slots[a] != last:
                    out.append(packed())
                    held.clear()
                last = int(slots[a])
                held.append((x[a:b], y[a:b]))
            if out:
                yield _rows(out)
        if held:
            yield _rows([packed()])

    slot = F.floor(sampling.unit_hash(seed=seed + 5) * (count * pieces)).cast("long")
    each = rows.select("message_id", "label", "x", slot.alias("slot")).where("slot IS NOT NULL").repartition("slot").sortWithinPartitions("slot", "message_id")
    packs = each.select("slot", "label", "x").mapInArrow(run, "batch long, piece int, n int, width int, x binary, y binary")
    packs.write.option("parquet.block.row.count.limit", 64).option("compression", "snappy").parquet(folder)
    return rows.sparkSession.read.schema(packs.schema).parquet(folder)


def _rows(made: list[list]) -> pa.RecordBatch:
    kinds = {"batch": pa.int64(), "piece": pa.int32(), "n": pa.int32(), "width": pa.int32(), "x": pa.binary(), "y": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), kinds.values(), strict=True)], list(kinds))


def epoch(packs: DataFrame, model: Trained, course: Course, order: np.ndarray, seed: int, pos_weight: float, rate: float, l2: float) -> Course:
    """The course after a step for each batch of packs (from dealt()), in this order: one job, whose last task makes the steps."""
    spark, kind, inputs, params = packs.sparkSession, model.kind, len(model.inputs), model.params
    names, stats = list(model.weights), list(model.running)
    sent = spark.sparkContext.broadcast((course, model.weights, model.running, model.mean, model.sd))  # of the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_memory()
        course, weights, running, mean, sd = sent.value
        made, codec, last, found = nets.net(kind, inputs, 0, **params), pa.Codec("zstd"), None, None
        for batch in batches:
            for at, piece, n, width, x, y in zip(*(batch.column(c) for c in ("at", "piece", "n", "width", "x", "y")), strict=True):
                if found is not None and at.as_py() != last:
                    course, found = course.moved(found, rate, l2), None
                last, n, width = at.as_py(), n.as_py(), width.as_py()
                x = np.frombuffer(codec.decompress(x.as_buffer(), n * width * 8)).reshape(width, n).T.reshape(n, -1, inputs)
                y = np.frombuffer(y.as_buffer(), np.int32).astype(float)
                net = replace(made, running=shaped(course.stats, running))
                loss, grads, seen = step(net, shaped(course.theta, weights), _standardised(x, mean, sd), y, np.where(y == 1, pos_weight, 1.0), seed + 1000 * course.steps + piece.as_py())
                one = np.concatenate([[loss, n], flat(grads, names), flat(seen, stats)])
                found = one if found is None else found + one
        course = course if found is None else course.moved(found, rate, l2)
        yield pa.RecordBatch.from_arrays([pa.array([course.packed()], pa.binary())], ["v"])

    places = spark.createDataFrame(pa.table({"batch": pa.array(order, pa.int64()), "at": pa.array(range(len(order)), pa.int64())}))
    rows = packs.join(F.broadcast(places), "batch").repartition(1).sortWithinPartitions("at", "piece")  # a row for each batch
    found = rows.select("at", "piece", "n", "width", "x", "y").mapInArrow(run, "v binary").collect()  # of the model's size
    sent.destroy()
    return course.unpacked(bytes(found[0]["v"])) if found else course


def epoch_by_jobs(rows: DataFrame, model: Trained, course: Course, order: np.ndarray, seed: int, pos_weight: float, rate: float, l2: float) -> Course:
    """The same over rows (batch, label, x) with a folder for each batch, each step a job."""
    for b in order.tolist():
        now = replace(model, weights=shaped(course.theta, model.weights), running=shaped(course.stats, model.running))
        course = course.moved(batch_gradient(rows.where(F.col("batch") == b), now, seed + 1000 * course.steps, pos_weight), rate, l2)
    return course


def fit(train: DataFrame, validation: DataFrame, kind: str, inputs: list[str], epochs: int = 25, batch_rows: int = 4096, rate: float = 3e-3, patience: int = 6, pos_weight: float = 1.0, l2: float = 0.0, seed: int = 1, **params) -> Trained:
    """Train on rows (message_id, label, x); the epoch with the best average precision on validation is kept.

    Training stops where `patience` epochs bring no better one.
    """
    net = nets.net(kind, len(inputs), seed, **params)
    spark, folder = train.sparkSession, scratch(train.sparkSession, "batches")
    n = train.count()
    count = max(1, -(-n // batch_rows))
    alone = batch_rows <= LONE_ROWS
    held = written(validation.select("message_id", "label", "x"), f"{folder}/held")
    mean, sd = moments(train, len(inputs))
    if alone:
        packs = dealt(train, count, -(-batch_rows // PIECE_ROWS), seed, f"{folder}/train")
    else:
        number = F.floor(sampling.unit_hash(seed=seed + 5) * count).cast("int")
        train.select("label", "x", number.alias("batch")).write.partitionBy("batch").parquet(f"{folder}/train")
        rows = spark.read.schema("label int, x array<double>, batch int").parquet(f"{folder}/train")
    model = Trained(kind, inputs, params, net.weights, net.running, mean, sd)
    theta, stats = flat(net.weights, list(net.weights)), flat(net.running, list(net.running))
    course = Course(theta, stats, np.zeros_like(theta), np.zeros_like(theta))
    best, best_epoch, rng = None, 0, np.random.default_rng(seed)
    for number in range(1, epochs + 1):
        order = rng.permutation(count)
        if n:
            course = epoch(packs, model, course, order, seed, pos_weight, rate, l2) if alone else epoch_by_jobs(rows, model, course, order, seed, pos_weight, rate, l2)
        model = replace(model, weights=shaped(course.theta, net.weights), running=shaped(course.stats, net.running))
        value = evaluate.average_precision(evaluate.curve(scored(model, held))).first()[0]
        if best is None or value > best.precision:
            best, best_epoch = replace(model, epochs=number, precision=value), number
        elif number - best_epoch >= patience:
            break
    return best


def scored(model: Trained, rows: DataFrame) -> DataFrame:
    """The columns of rows but x, plus score."""
    kept = [f for f in rows.schema if f.name not in ("x", "score")]
    sent = rows.sparkSession.sparkContext.broadcast(model)  # of the model's size
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_memory()
        m = sent.value
        net = nets.net(m.kind, len(m.inputs), 0, **m.params)
        for batch in batches:
            x = _inputs(batch, len(m.inputs), m.mean, m.sd) if batch.num_rows else ()
            score = np.concatenate([np.array([]), *(probabilities(net, m.weights, m.running, x[i : i + SCORED_ROWS]) for i in range(0, len(x), SCORED_ROWS))])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(np.round(score, 9))], [*(f.name for f in kept), "score"])

    return rows.select(*(f"`{f.name}`" for f in kept), "x").mapInArrow(run, schema)
