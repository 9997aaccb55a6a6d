"""Networks: derivatives against finite differences, sparsemax, data-parallel sums, and what they learn."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.networks import nets, tape, train
from tidemark.operators import evaluate, sampling

KINDS = {"mlp": {"hidden": 6, "dropout": 0.0}, "cnn": {"filters": 3, "dropout": 0.0}, "rnn": {"hidden": 4, "dropout": 0.0}, "lstm": {"hidden": 4, "layers": 2, "dropout": 0.0}, "cnn_lstm": {"filters": 3, "hidden": 4, "dropout": 0.0}, "rnn_lstm": {"hidden": 4, "dropout": 0.0}, "tabnet": {"width": 3, "steps": 2}}
SEQUENCES = ("rnn", "lstm", "cnn_lstm", "rnn_lstm")


@pytest.mark.parametrize("kind", KINDS)
def test_gradients(kind):
    rng = np.random.default_rng(3)
    net = nets.net(kind, 5, 1, **KINDS[kind])
    weights = {k: v + rng.normal(size=v.shape) * 0.3 for k, v in net.weights.items()}
    x = rng.normal(size=(7, 3, 5) if kind in SEQUENCES else (7, 5))
    y, w = rng.integers(0, 2, 7).astype(float), rng.random(7) + 0.5
    loss, grads, _ = train.step(net, weights, x, y, w, 1)
    for name, g in grads.items():
        for at in list(np.ndindex(g.shape))[:6]:
            values = []
            for e in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][at] += e
                values.append(train.step(net, moved, x, y, w, 1)[0])
            assert g[at] == pytest.approx((values[0] - values[1]) / 2e-5, rel=2e-3, abs=2e-5), name


def plain_projection(z):
    """The nearest point of the simplex by bisection of the threshold."""
    low, high = z.min() - 1, z.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.maximum(z - mid, 0).sum() > 1 else (low, mid)
    return np.maximum(z - low, 0)


def test_sparsemax():
    rng = np.random.default_rng(5)
    z = np.concatenate([rng.normal(size=(200, 9)) * rng.choice([0.1, 1, 5], (200, 1)), np.zeros((1, 9)), np.eye(9) * 3])
    p = tape.project(z)
    assert np.allclose(p, [plain_projection(r) for r in z], atol=1e-9) and np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and (p == 0).any()


def test_masks():
    """Every step's mask sums to 1, and what a step used weighs less in the next."""
    rng = np.random.default_rng(2)
    net = nets.net("tabnet", 8, 4, width=4, steps=3, gamma=1.0)
    p = nets.Pass({k: tape.Var(v) for k, v in net.weights.items()}, net.running, np.random.default_rng(1))
    net.logits(p, rng.normal(size=(50, 8)))
    assert len(p.masks) == 3 and all(np.allclose(m.sum(axis=1), 1) for m in p.masks)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = []
    for i in range(900):
        x = [rng.gauss(0, 1) for _ in range(4)]
        made.append((i, i % 30, float(i), int(x[0] + x[1] + 0.3 * rng.gauss(0, 1) > 1.2), *x))
    return spark.createDataFrame(made, "message_id long, client_id int, t double, label int, a double, b double, c double, d double")


@pytest.mark.parametrize(("kind", "params"), [("mlp", {"hidden": 16}), ("cnn", {"filters": 8}), ("lstm", {"hidden": 8}), ("tabnet", {"width": 4})])
def test_beats_the_prior(rows, kind, params):
    inputs = ["a", "b", "c", "d"]
    table = (train.sequences(rows, inputs, 3) if kind == "lstm" else train.vectors(rows, inputs)).select("message_id", "label", "x")
    model = train.fit(table.where("message_id % 3 > 0"), table.where("message_id % 3 = 0"), kind, inputs, epochs=4, batch_rows=64, rate=0.02, pos_weight=2.0, **params)
    scores = train.scored(model, table.where("message_id % 3 = 0"))
    found = evaluate.average_precision(evaluate.curve(scores)).first()[0]
    prior = scores.agg(F.avg("label")).first()[0]
    assert found == pytest.approx(model.precision, abs=1e-6) and found > prior + 0.25


def test_sums_over_tasks(rows, monkeypatch):
    """However rows are dealt out and summed up, a step's sums are those of all rows (a network without normalised layers)."""
    inputs = ["a", "b"]
    table = train.vectors(rows, inputs).select("label", "x")
    net = nets.net("rnn", 2, 1, hidden=3, dropout=0.0)
    model = train.Trained("rnn", inputs, {"hidden": 3, "dropout": 0.0}, net.weights, net.running, np.zeros(2), np.ones(2))
    one = train.batch_gradient(table.coalesce(1), model, 1, 3.0)
    monkeypatch.setattr(train, "FAN_IN", 2)
    assert one[1] == 900 and np.allclose(one, train.batch_gradient(table.repartition(7), model, 9, 3.0))


def test_sequences(spark):
    df = spark.createDataFrame([(1, 7, 1.0, 1.0, 10.0), (2, 7, 2.0, None, 20.0), (3, 7, 3.0, 3.0, 30.0), (4, 8, 1.0, 4.0, 40.0)], "message_id long, client_id int, t double, a double, b double")
    got = {r["message_id"]: r["x"] for r in train.sequences(df, ["a", "b"], 2).collect()}
    assert got == {1: [0.0, 0.0, 1.0, 10.0], 2: [1.0, 10.0, 0.0, 20.0], 3: [0.0, 20.0, 3.0, 30.0], 4: [0.0, 0.0, 4.0, 40.0]}


def test_unknown_network():
    with pytest.raises(ValueError, match="no network x"):
        nets.net("x", 3, 1)


def test_epoch_in_one_job(rows, monkeypatch):
    """An epoch of small batches is one job, and moves a network without normalised layers as steps of a job each do."""
    inputs, params = ["a", "b", "c", "d"], {"hidden": 3, "dropout": 0.0}
    spark, table = rows.sparkSession, train.vectors(rows, inputs).select("message_id", "label", "x")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setJobGroup("fit", "fit")
    fit = lambda: train.fit(table.where("message_id % 3 > 0"), table.where("message_id % 3 = 0"), "rnn", inputs, epochs=2, batch_rows=20, rate=0.02, l2=0.01, pos_weight=2.0, **params)
    monkeypatch.setattr(train, "PIECE_ROWS", 7)
    one, n = fit(), jobs()
    assert n < 60  # 30 batches twice
    monkeypatch.setattr(train, "LONE_ROWS", 0)
    each = fit()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs() - n >= 60 and one.precision == pytest.approx(each.precision, abs=1e-6)
    for name, v in each.weights.items():
        assert np.allclose(v, one.weights[name], atol=1e-9), name


def test_fewer_rows_than_pieces(rows):
    few = train.vectors(rows.where("message_id < 3"), ["a"]).select("message_id", "label", "x")
    model = train.fit(few, few, "mlp", ["a"], epochs=1, hidden=4)
    assert model.epochs == 1 and all(np.isfinite(v).all() for v in model.weights.values())


def test_moments(rows):
    table = train.vectors(rows, ["a", "t"]).repartition(5)
    mean, sd = train.moments(table, 2)
    own = rows.agg(F.avg("a"), F.avg("t"), F.stddev_pop("a"), F.stddev_pop("t")).first()
    assert np.allclose([*mean, *sd], own)
    assert [v.tolist() for v in train.moments(table.where("a > 99"), 2)] == [[0, 0], [1, 1]]


@pytest.mark.parametrize(("test", "validation"), [(0.15, 0.17647), (0.0, 0.0), (0.5, 1.0), (1.0, 0.5)])
def test_split_column(rows, test, validation):
    """The split as a column is that of ranked rows, for classes of any size."""
    df = rows.withColumn("label", F.when(F.col("message_id") == 7, None).otherwise(F.when(F.col("message_id") < 3, 5).otherwise(F.col("label"))))
    ranked = sampling.stratified_split(df, test, validation, "label").select("message_id", "split")
    assert sorted(df.select("message_id", sampling.split_column(df, test, validation, "label").alias("split")).collect()) == sorted(ranked.collect())
