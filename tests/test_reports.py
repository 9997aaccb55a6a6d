"""Metrics by hand-checked values, report files, sinks, studies."""

import random

import pytest

from tidemark.operators import evaluate, impute
from tidemark.plans import features, studies
from tidemark.sources import files


def test_published_arithmetic(spark):
    """A published confusion matrix and top-k table (fixed values) give the published metrics."""
    cm = spark.createDataFrame([(1495855, 2194, 892, 959)], "tn long, fp long, fn long, tp long")
    r = evaluate.classification(cm).collect()[0]
    assert (round(r["precision"], 6), round(r["recall"], 6), round(r["f1_score"], 6), round(r["f2_score"], 6), round(r["accuracy"], 6)) == (0.304155, 0.518098, 0.383293, 0.454201, 0.997943)
    precision, prevalence = 494 / 1000, 1851 / 1499900
    assert round(precision / prevalence, 2) == 400.3
    assert round(494 / 1851, 4) == 0.2669


def test_ranking_metrics(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.3), round(rng.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "message_id long, label int, score double")
    points = evaluate.curve(df)
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    assert evaluate.roc_auc(points).collect()[0][0] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    ap = 0.0
    for s in sorted({s for *_, s in rows}):
        at, above = [y for *_, y, x in rows if x == s], [y for *_, y, x in rows if x >= s]
        ap += sum(at) / len(pos) * sum(above) / len(above)
    assert evaluate.average_precision(points).collect()[0][0] == pytest.approx(ap)
    top = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r["top_k"]: r["tp_hits"] for r in evaluate.ranked_hits(df, (10, 50)).collect()} == {k: sum(y for _, y, _ in top[:k]) for k in (10, 50)}


def test_without_positives(spark):
    df = spark.createDataFrame([(i, 0, 0.5) for i in range(5)], "message_id long, label int, score double")
    r = evaluate.classification(evaluate.confusion(df, 0.1)).collect()[0]
    assert (r["precision"], r["recall"], r["f1_score"]) == (0, 0, 0)
    assert evaluate.best_threshold(evaluate.curve(df)).collect()[0]["threshold"] == 0.5


def test_report_files(spark, tmp_path):
    text = '{"base": {"precision": 0.5, "confusion_matrix": {"tp": 1}}} junk { {"all": {"precision": 0.25}} {"base": {"precision": 0.75}}'
    assert files.parse_documents(text)["base"] == {"precision": 0.75}
    (tmp_path / "r.json").write_text(text)
    rows = studies.report_rows(files.read_reports(spark, str(tmp_path / "r.json"), studies.REPORT)).orderBy("experiment").collect()
    assert [(r["experiment"], r["precision"]) for r in rows] == [("all", 0.25), ("base", 0.75)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", "x")], "message_id long, is_opened string, stream string")
    files.write_parquet(df, str(tmp_path / "p"))
    files.write_csv(df, str(tmp_path / "c.csv"))
    files.write_report(df, str(tmp_path / "j"))
    assert files.exists(spark, str(tmp_path / "p")) and not files.exists(spark, str(tmp_path / "q"))
    assert files.read_log(spark, str(tmp_path / "p"), ["message_id", "none"]).columns == ["message_id"]
    assert files.read_log(spark, str(tmp_path / "c.csv"), ["message_id", "stream"]).collect() == [("1", "x")]


def test_studies():
    assert studies.tau_of(0.5) == {"email": 24.0, "mobile_push": 12.0, "sms": 36.0, "multichannel": 48.0, "unknown": 48.0}
    assert studies.regression_check({"a": 1.0, "n": 3}, {"a": 1.0 + 1e-13, "n": 4}) == ["n"]
    assert [x[1] for x in studies.run_all({"fine": lambda: 1, "bad": lambda: 1 / 0})] == ["ok", "failed: ZeroDivisionError: division by zero"]
    assert len(set(features.INPUTS)) == 64 and len(features.inputs_of("v0_v3" if "v0_v3" in features.EXPERIMENTS else "all")) == 50


def test_medians_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "message_id long, __topic_gap double")
    assert impute.medians(df, ["__topic_gap"]).collect()[0][0] == 48.0
