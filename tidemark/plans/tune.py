"""Parameter search by tree-structured Parzen estimators: good and bad trials each make a density; candidates drawn from the
good one are judged by the ratio of the two.

A study is a written table of trials. Trials run a few at a time, as Spark jobs side by side; those asked for together count
as bad ones for each other, so that they spread. What is asked for depends on the seed and on the trials before alone, so a
study gives the same again, and one that stopped goes on from its table.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import files

#: Trials before densities are made; share of trials that are good, and how many at most; candidates that are judged.
STARTUP, GOOD, MOST_GOOD, CANDIDATES = 10, 0.1, 25, 24


@dataclass(frozen=True)
class Real:
    """From low to high, on a logarithmic scale if log."""

    low: float
    high: float
    log: bool = False

    def inner(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def bounds(self) -> tuple[float, float]:
        return self.inner(self.low), self.inner(self.high)

    def outer(self, x: float) -> float:
        return float(min(self.high, max(self.low, math.exp(x) if self.log else x)))


@dataclass(frozen=True)
class Whole:
    """low, low + step, and so on up to high."""

    low: int
    high: int
    step: int = 1

    def inner(self, x: float) -> float:
        return float(x)

    def bounds(self) -> tuple[float, float]:
        return self.low - self.step / 2, self.high + self.step / 2

    def outer(self, x: float) -> int:
        last = (self.high - self.low) // self.step
        return self.low + self.step * int(min(last, max(0, round((x - self.low) / self.step))))


@dataclass(frozen=True)
class Choice:
    values: tuple


Space = dict[str, Real | Whole | Choice]


class Density:
    """Parzen estimator of numbers: normals at the points, as wide as the gaps around them, and one over the whole range; cut at the bounds."""

    def __init__(self, points: list[float], low: float, high: float):
        order = np.argsort(points, kind="stable")
        self.low, self.high, span = low, high, max(high - low, 1e-12)
        sorted_ = np.array(points, float)[order]
        edges = np.concatenate([[low], sorted_, [high]])
        widths = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        widths = np.clip(widths, span / min(100.0, 2.0 + len(points)), span)
        self.mid, self.wide = np.append(sorted_, (low + high) / 2), np.append(widths, span)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(n)
        for i in range(n):
            k = int(rng.integers(len(self.mid)))
            while True:
                x = rng.normal(self.mid[k], self.wide[k])
                if self.low <= x <= self.high:
                    break
            out[i] = x
        return out

    def log(self, x: np.ndarray) -> np.ndarray:
        part = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
        inside = part((self.high - self.mid) / self.wide) - part((self.low - self.mid) / self.wide)
        z = (x[:, None] - self.mid) / self.wide
        return np.log((np.exp(-0.5 * z * z) / (self.wide * math.sqrt(2 * math.pi) * inside)).mean(axis=1) + 1e-300)


def _shares(values: list, choice: Choice) -> np.ndarray:
    counts = np.array([1.0 + values.count(v) for v in choice.values])
    return counts / counts.sum()


def suggest(space: Space, done: list[tuple[dict, float]], pending: list[dict], seed: int, number: int) -> dict:
    """Parameters of trial `number`, from finished trials (params, value; larger is better) and those under way."""
    rng = np.random.default_rng([seed, number])
    if len(done) < STARTUP:
        return {name: dim.values[int(rng.integers(len(dim.values)))] if isinstance(dim, Choice) else dim.outer(rng.uniform(*dim.bounds())) for name, dim in space.items()}
    ranked = [p for p, _ in sorted(done, key=lambda x: -x[1])]  # of equal ones the earlier first
    n = min(MOST_GOOD, math.ceil(GOOD * len(ranked)))
    good, bad, out = ranked[:n], ranked[n:] + pending, {}
    for name, dim in space.items():
        if isinstance(dim, Choice):
            a, b = (_shares([p[name] for p in part], dim) for part in (good, bad))
            picked = rng.choice(len(a), size=CANDIDATES, p=a)
            out[name] = dim.values[int(max(picked, key=lambda k: a[k] / b[k]))]
        else:
            a, b = (Density([dim.inner(p[name]) for p in part], *dim.bounds()) for part in (good, bad))
            x = a.draw(rng, CANDIDATES)
            out[name] = dim.outer(float(x[np.argmax(a.log(x) - b.log(x))]))
    return out


TRIALS = "number int, params string, value double, seconds double"


def study(spark: SparkSession, space: Space, objective: Callable[[dict], float], folder: str, trials: int = 15, at_once: int = 3, seed: int = 1) -> DataFrame:
    """The table of trials (number, params as JSON, value, seconds) in folder; larger values are better.

    Each round's trials are a part of their own, so a study that stopped goes on with the round that it was in.
    """
    done: list[tuple[int, dict, float, float]] = []
    first = 0
    while first < trials:
        n = min(at_once, trials - first)
        part = f"{folder}/round-{first:05d}"
        if not files.exists(spark, part):
            known, asked = [(p, v) for _, p, v, _ in done], []
            for i in range(n):
                asked.append(suggest(space, known, asked.copy(), seed, first + i))

            def run(params: dict) -> tuple[float, float]:
                began = time.time()
                return float(objective(params)), time.time() - began

            with ThreadPoolExecutor(n) as pool:
                results = [*pool.map(inheritable_thread_target(spark)(run), asked)]
            rows = [(first + i, json.dumps(p, sort_keys=True), v, s) for i, (p, (v, s)) in enumerate(zip(asked, results, strict=True))]
            files.write_parquet(spark.createDataFrame(rows, TRIALS).coalesce(1), part)
        done += [(r["number"], json.loads(r["params"]), r["value"], r["seconds"]) for r in spark.read.schema(TRIALS).parquet(part).orderBy("number").collect()]  # a round's trials
        first += n
    return spark.read.schema(TRIALS).parquet(*(f"{folder}/round-{i:05d}" for i in range(0, trials, at_once)))


def best(trials: DataFrame) -> tuple[dict, float]:
    """Parameters and value of the best trial, the earliest of equal ones."""
    row = trials.orderBy(F.desc("value"), "number").first()
    return json.loads(row["params"]), row["value"]
