"""Parzen search, early stopping and weights of classifiers."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, sampling
from tidemark.plans import models, tune

SPACE = {"x": tune.Real(0.001, 10.0, log=True), "y": tune.Real(-2.0, 2.0), "n": tune.Whole(100, 600, 50), "k": tune.Choice(("a", "b", "c"))}


def loss(p):
    return -((math.log10(p["x"]) - 0.3) ** 2) - (p["y"] - 0.7) ** 2 - ((p["n"] - 350) / 250) ** 2 - (p["k"] != "b")


def test_density_by_plain_sums():
    points, low, high = [0.2, 0.9, 0.9, 0.35], 0.0, 1.0
    d = tune.Density(points, low, high)
    xs = sorted(points)
    wide = []
    for i, x in enumerate(xs):
        left, right = (xs[i - 1] if i else low), (xs[i + 1] if i + 1 < len(xs) else high)
        wide.append(min(1.0, max(max(x - left, right - x), 1 / min(100, 2 + len(xs)))))
    area = lambda m, s, z: 0.5 * (1 + math.erf((z - m) / s / math.sqrt(2)))
    for z in (0.0, 0.21, 0.5, 1.0):
        parts = [math.exp(-0.5 * ((z - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) / (area(m, s, high) - area(m, s, low)) for m, s in [*zip(xs, wide, strict=True), (0.5, 1.0)]]
        assert d.log(np.array([z]))[0] == pytest.approx(math.log(sum(parts) / len(parts)))
    drawn = d.draw(np.random.default_rng(1), 500)
    grid = np.linspace(0, 1, 20_001)
    assert drawn.min() >= low and drawn.max() <= high
    assert (drawn > 0.8).mean() == pytest.approx(np.exp(d.log(grid[grid > 0.8])).sum() / len(grid), abs=0.06)
    assert np.exp(d.log(grid)).mean() == pytest.approx(1, abs=1e-3)


def test_suggestions():
    """In their ranges and steps, repeatable by seed, and on the whole better than chance."""
    found = []
    for parzen in (True, False):
        total = 0.0
        for seed in range(8):
            done = []
            for number in range(40):
                p = tune.suggest(SPACE, done if parzen else [], [], seed, number)
                assert p == tune.suggest(SPACE, done if parzen else [], [], seed, number)
                assert 0.001 <= p["x"] <= 10 and -2 <= p["y"] <= 2 and p["n"] in range(100, 601, 50) and p["k"] in "abc"
                done.append((p, loss(p)))
            total += max(v for _, v in done)
        found.append(total)
    assert found[0] > found[1]  # losses: nearer to 0


def test_pending_trials_spread():
    rng = np.random.default_rng(2)
    done = [({"y": float(y)}, -(float(y) ** 2)) for y in rng.uniform(-2, 2, 20)]
    space = {"y": tune.Real(-2.0, 2.0)}
    first = tune.suggest(space, done, [], 3, 20)
    others = [tune.suggest(space, done, [first] * n, 3, 20) for n in (0, 30)]
    assert others[0] == first and others[1] != first


def test_study_goes_on(spark, tmp_path):
    """Rounds that are there aren't run again, and the trials are the same as in a study that wasn't stopped."""
    calls = []

    def objective(p):
        calls.append(p)
        if len(calls) == 8:
            raise RuntimeError("stopped")
        return loss(p)

    with pytest.raises(RuntimeError, match="stopped"):
        tune.study(spark, SPACE, objective, str(tmp_path / "a"), trials=15, at_once=3)
    got = tune.study(spark, SPACE, objective, str(tmp_path / "a"), trials=15, at_once=3)
    assert len(calls) <= 9 + 9
    whole = tune.study(spark, SPACE, loss, str(tmp_path / "b"), trials=15, at_once=3)
    rows = lambda df: [(r["number"], r["params"], r["value"]) for r in df.orderBy("number").collect()]
    assert rows(got) == rows(whole) and got.count() == 15
    params, value = tune.best(whole)
    assert loss(params) == value == max(r[2] for r in rows(whole)) and json.loads(rows(whole)[0][1]).keys() == SPACE.keys()


@pytest.fixture(scope="module")
def rows(spark):
    """Two inputs decide the label, which is wrong for a sixth of rows; the others are noise that deep trees fit."""
    rng = random.Random(4)
    made = []
    for i in range(600):
        x = [rng.random() for _ in range(8)]
        made.append((i, int((x[0] + x[1] > 1.3) != (rng.random() < 0.16)), *x))
    return models.training_rows(spark.createDataFrame(made, "message_id long, is_purchased int, " + ", ".join(f"f{k} double" for k in range(8))), [f"f{k}" for k in range(8)])


INPUTS = [f"f{k}" for k in range(8)]


def test_stopping_point():
    assert models.stopping_point([0.1, 0.3, 0.2, 0.3, 0.4], 4) == 5
    assert models.stopping_point([0.1, 0.3, 0.2, 0.3, 0.4], 2) == 2
    assert models.stopping_point([0.5], 3) == 1 and models.stopping_point([0.2, 0.2, 0.2], 9) == 1


def test_early_stopping(rows):
    """Fewer trees are better here; the cut model scores as its first trees do, and as it was measured."""
    train, held = models.fold_tables(rows, 2)[0]
    model = models.classifier("gbt", INPUTS, maxIter=12, maxDepth=5).fit(models.weighted(train))
    staged = models.staged_precision(model, held)
    ap = lambda m: evaluate.average_precision(evaluate.curve(models.scored(m, held))).first()[0]
    assert len(staged) == 12 and staged[-1] == pytest.approx(ap(model), abs=1e-6)
    stopped = models.fitted(train, held, "gbt", INPUTS, patience=12, maxIter=12, maxDepth=5)
    n = models.trees_of(stopped)
    assert n == int(np.argmax(np.round(staged, 12))) + 1 < 12
    assert ap(stopped) == pytest.approx(staged[n - 1], abs=1e-6) and staged[n - 1] > staged[-1]
    scores = models.ensemble(rows, "gbt", INPUTS, folds=2, patience=3, maxIter=6, maxDepth=4)
    assert {r[0] for r in scores.select("trees").distinct().collect()} <= set(range(2, 13)) and scores.count() == rows.where("split <> 'train'").count()


def test_fold_tables(rows):
    tables = models.fold_tables(rows, 3, most_negatives=50)
    train = rows.where("split = 'train'")
    assert sum(held.count() for _, held in tables) == train.count()
    for part, held in tables:
        assert part.where("label = 0").count() == 50 and part.join(held, "message_id").count() == 0


def test_weighted_perceptron(rows):
    """Replicated positives count as the weight says, and raise recall."""
    train, held = models.fold_tables(rows, 2)[0]
    copies = sampling.replicated(train, 2.5, label="label").groupBy("message_id", "label").count()
    times = F.when(F.col("label") == 1, 2 + (sampling.unit_hash(seed=2) < 0.5).cast("int")).otherwise(1)
    assert copies.where(F.col("count") != times).count() == 0 and copies.count() == train.count()
    recall = []
    for weight in (1.0, 8.0):
        scores = models.scored(models.fitted(train, held, "mlp", INPUTS, pos_weight=weight, maxIter=40, hidden=8), held)
        recall.append(evaluate.classification(evaluate.confusion(scores, 0.5)).first()["recall"])
    assert recall[1] > recall[0]


def test_parzen_search_beats_the_grid(rows, tmp_path):
    grid = models.search(rows, "rf", INPUTS, {"maxDepth": [2, 3], "numTrees": [4]}, folds=2)
    space = {"maxDepth": tune.Whole(2, 7), "numTrees": tune.Whole(2, 14, 2), "pos_weight": tune.Real(1.0, 8.0, log=True)}
    trials = models.tuned(rows, "rf", INPUTS, str(tmp_path), space, folds=2, trials=15)
    params, value = tune.best(trials)
    assert trials.count() == 15 and value >= grid[0][1] and set(params) == set(space)


def test_published_space():
    space = models.published_space("gbt", 900.0)
    assert space["pos_weight"] == tune.Real(45.0, 1800.0, log=True) and space["maxIter"].outer(1e9) == 600
    assert models.published_space("rf", 3.0)["pos_weight"].high == 3.0
    with pytest.raises(ValueError, match="no space"):
        models.published_space("x", 1.0)
