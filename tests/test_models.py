"""Classifiers on a small table whose label two inputs decide; saved models; studies on their reports."""

import random
from pathlib import Path

import pytest

from tidemark.operators import evaluate, sampling
from tidemark.plans import features, models, studies
from tidemark.sources import files

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = []
    for i in range(400):
        a, b = rng.random(), rng.random()
        made.append((i, int(a + b > 1.3), a, b, None if i % 9 == 0 else rng.random()))
    return models.training_rows(spark.createDataFrame(made, "message_id long, is_purchased int, a double, b double, c double"), ["a", "b", "c"])


def test_prepared(rows):
    splits = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert sum(splits.values()) == 400 and splits["test"] == 60
    assert rows.where("c IS NULL").count() == 0 and {r[0] for r in rows.select("fold").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize(("kind", "params"), [("gbt", {"maxIter": 4, "maxDepth": 3}), ("rf", {"numTrees": 8, "maxDepth": 4}), ("mlp", {"maxIter": 30, "hidden": (8,)})])
def test_ensemble_and_report(rows, kind, params):
    scores = models.ensemble(rows, kind, ["a", "b", "c"], folds=2, **params)
    held = rows.where("split <> 'train'")
    assert {r[0] for r in scores.select("message_id").collect()} == {r[0] for r in held.select("message_id").collect()}
    r = models.report(scores, 3, (10, 20)).collect()[0]
    cm = r["confusion_matrix"]
    assert sum(cm) == 60 and r["num_features"] == 3 and r["roc_auc"] > 0.9 and r["pr_auc"] > 0.7
    assert r["recall"] == pytest.approx(cm["tp"] / (cm["tp"] + cm["fn"])) and r["top10_hits"] <= r["top20_hits"]


def test_weights_and_caps(rows):
    train = rows.where("split = 'train'")
    n, p = train.count(), train.where("label = 1").count()
    assert {round(r[0], 9) for r in models.weighted(train).select("weight").distinct().collect()} == {1.0, round((n - p) / p, 9)}
    assert sampling.capped_negatives(train, 20, label="label").where("label = 0").count() == 20


def test_search(rows):
    found = models.search(rows, "rf", ["a", "b"], {"maxDepth": [1, 4]}, {"numTrees": 4}, folds=2)
    assert [x[0]["numTrees"] for x in found] == [4, 4] and found[0][1] >= found[1][1] > 0


def test_unknown_classifier():
    with pytest.raises(ValueError, match="no classifier tabnet"):
        models.classifier("tabnet", ["a"])


def test_topk_delta(spark):
    rows = spark.createDataFrame([("base", 10, 5, 1, 2, 3), ("all", 15, 5, 1, 0, 6)], "experiment string, top100_hits int, tn int, fp int, fn int, tp int")
    got = {(r["experiment"], r["item"]): r["change"] for r in studies.topk_delta(rows).collect()}
    assert got["all", "top100_hits"] == "+50.000%" and got["all", "fn"] == "-100.000%" and got["base", "tp"] == "" and len(got) == 10


def test_crowded_scores(spark):
    """Scores that crowd in a thousandth of the range are still dealt out, and metrics are exact."""
    rng = random.Random(5)
    made = [(i, int(rng.random() < 0.1), 0.0001 * rng.random() if i % 50 else 0.9) for i in range(3000)]
    points = evaluate.curve(spark.createDataFrame(made, "message_id long, label int, score double")).collect()
    for r in rng.sample(points, 40):
        assert r["tp"] == sum(y for _, y, s in made if s >= r["score"]) and r["fp"] == sum(1 - y for _, y, s in made if s >= r["score"])


def test_files(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "id string, v string").coalesce(1)
    files.write_csv(df, str(tmp_path / "x.csv"), bom=True)
    part = next(tmp_path.glob("x.csv/part*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,v")
    assert sorted(files.read_log(spark, str(tmp_path / "x.csv")).collect(), key=str) == [("1", "a"), ("2", None)]
    (tmp_path / "there").mkdir()
    found = lambda env: files.resolve("ROOT", [str(tmp_path / "absent"), str(tmp_path / "there")], env, "default")
    assert (found({"ROOT": "given"}), found({})) == ("given", str(tmp_path / "there"))
    assert files.resolve("ROOT", [], {}, "default") == "default"


def test_one_window_operator_for_most_kernels(spark):
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    plan = features.state(features.fact_columns(features.log(spark, DATA)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window ") + plan.count(":- Window ") <= 8


def test_rows_by_one_ranking(rows, spark):
    """Splits and folds from one ranking, and the cap as a condition, are what ranked rows give."""
    df = rows.select("message_id", "label")
    both = sampling.stratified_folds(sampling.stratified_split(df, label="label"), label="label")
    assert sorted(sampling.split_and_folds(df, label="label").collect()) == sorted(both.select("message_id", "label", "split", "fold").collect())
    for most in (0, 20, 10_000):
        assert sorted(df.where(sampling.capped_filter(df, most, label="label")).collect()) == sorted(sampling.capped_negatives(df, most, label="label").collect())


def test_studies_share_their_tables(spark, monkeypatch):
    """An ablation's experiments and a sweep's multipliers fit on fold tables that are made once."""
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    made, fold_tables, state = [], models.fold_tables, features.stated
    monkeypatch.setattr(models, "fold_tables", lambda *a, **k: made.append("folds") or fold_tables(*a, **k))
    monkeypatch.setattr(models, "training_rows", lambda *a, rows=models.training_rows: made.append("rows") or rows(*a))
    log = features.log(spark, DATA)
    models.ablation(features.build(log), "rf", ["base", "all"], (10, 20), folds=2, numTrees=2, maxDepth=2)
    assert made == ["rows", "folds"]
    made.clear()
    found = models.tau_targeting(log, "rf", (10, 20), (0.5, 1.5), folds=2, numTrees=2, maxDepth=3).collect()
    assert made == ["rows", "folds"] and len(found) == 4
    own = features.completed(features.history.fatigue(state(log), studies.tau_of(1.5)))
    alone = models.ensemble(models.training_rows(own, features.INPUTS), "rf", features.INPUTS, folds=2, numTrees=2, maxDepth=3)
    hits = {r["top_k"]: r["tp_hits"] for r in evaluate.ranked_hits(alone.where("split = 'test'"), (10, 20)).collect()}
    assert hits == {r["top_k"]: r["tp_hits"] for r in found if r["tau_multiplier"] == "1.50x"}
