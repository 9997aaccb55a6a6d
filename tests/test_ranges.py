"""Global orders that are dealt out: running sums, first rows, medians by selection, ids of any size."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import evaluate, impute, ranges, rolling, sampling


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables in several ranges as well."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), float(rng.randrange(40)), rng.randrange(3)) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "message_id long, g string, v double, w int").repartition(7)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_running(made, by, inclusive):
    rows, df = made
    order = [F.desc("v"), F.col("message_id")]
    dealt = ranges.in_ranges(df, [*map(F.col, by), *order])
    assert dealt.select("__r").distinct().count() > 1
    got = {r["message_id"]: (r["s"], r["n"]) for r in ranges.running(dealt, order, {"s": F.col("w"), "n": F.lit(1)}, by, inclusive).collect()}
    seen = {}
    for i, g, _, w in sorted(rows, key=lambda r: (-r[2], r[0])):
        s, n = seen.get(g if by else 0, (0, 0))
        seen[g if by else 0] = (s + w, n + 1)
        assert got[i] == ((s + w, n + 1) if inclusive else (s, n))


@pytest.mark.parametrize("by", [(), ("g",)])
def test_first_rows(made, by, monkeypatch):
    rows, df = made
    monkeypatch.setattr(ranges, "FAN_IN", 2)
    top = ranges.first_rows(df, 25, [F.desc("v"), F.col("message_id")], by)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3  # 7 tasks meet two by two
    got = sorted((r["g"] if by else "", r["rank"], r["message_id"]) for r in top.collect())
    want = []
    for g in "ab" if by else [""]:
        best = sorted((r for r in rows if not by or r[1] == g), key=lambda r: (-r[2], r[0]))[:25]
        want += [(g, i + 1, r[0]) for i, r in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize(("most", "sketch"), [(100_000, 10_000), (20, 50), (1, 10)])
def test_medians_by_selection(spark, most, sketch, monkeypatch):
    """Crowded, repeated, far apart, odd and even, with nulls and without values."""
    monkeypatch.setattr(impute, "SELECTED", most)
    monkeypatch.setattr(impute, "SKETCH", sketch)
    rng = random.Random(4)
    cols = {"a": [rng.random() for _ in range(1001)], "b": [rng.choice([1.0, 2.0]) for _ in range(1000)], "c": [10.0 ** rng.randrange(-200, 200) for _ in range(999)], "d": [5.0] * 700, "e": [-1.0] * 500 + [3.0] * 500, "f": [], "g": [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(800)]}
    rows = [tuple(v[i] if i < len(v) else None for v in cols.values()) for i in range(1001)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    got, want = impute.medians(df, list(cols)).first(), df.agg(*(F.coalesce(F.median(c), F.lit(24.0)).alias(f"{c}_med") for c in cols)).first()
    assert got.asDict() == want.asDict()
    assert impute.medians(df, ["a"], fit_on=F.col("b") == 1).first()[0] == df.where("b = 1").agg(F.median("a")).first()[0]


def test_open_rate_of_one_crowded_time(spark):
    """All messages within a minute still go to several ranges, and each counts those before it."""
    rows = [(i, 100.0 + (i % 4) / 240, i % 3 % 2) for i in range(400)] + [(1000, None, 1), (1001, 900.0, 0)]
    got = {r["message_id"]: r["ctx_tc_open_rate_30d"] for r in rolling.global_open_rate(spark.createDataFrame(rows, "message_id long, t double, is_opened int")).collect()}
    for i, t, _ in rows:
        before = [o for j, u, o in rows if t is not None and u is not None and t - 720 <= u and (u, j) < (t, i)]
        assert got[i] == (pytest.approx(sum(before) / len(before)) if before else 0.25)


def test_large_and_negative_ids(spark):
    ids = [10**18, 10**18 + 1, -1, -(2**63), 2**63 - 1, 0, 2147483647, *range(50)]
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in ids], "message_id long, is_purchased int")
    assert all(0 <= r[0] < 1 for r in df.select(sampling.unit_hash()).collect())
    split = sampling.stratified_split(df)
    assert split.count() == len(ids) and {r[0] for r in split.select("split").distinct().collect()} == {"test", "validation", "train"}
    assert sampling.stratified_folds(df, 3).select("message_id").distinct().count() == len(set(ids))
    raw = spark.createDataFrame([("9007199254740993",), ("-9223372036854775808",), ("12.0",), ("1e3",), ("x",), (None,)], "v string")
    assert [r[0] for r in raw.select(clean.id_or_sentinel("v")).collect()] == [9007199254740993, -(2**63), 12, 1000, -1, -1]


def test_replicated_positives(spark):
    """A weight's whole part counts for each positive, its fraction for that share of them; negatives stay single."""
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(4000)], "message_id long, is_purchased int")
    n = {r["is_purchased"]: r["count"] for r in sampling.replicated(df, 2.3).groupBy("is_purchased").count().collect()}
    assert n[0] == 3000 and abs(n[1] - 2300) < 60
    assert sampling.replicated(df, 0.5).where("is_purchased = 1").count() < 600


def test_curve_of_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.randrange(2), rng.randrange(30) / 10) for _ in range(900)]
    for r in evaluate.curve(spark.createDataFrame(rows, "g string, label int, score double"), by=("g",)).collect():
        own = [x for x in rows if x[0] == r["g"]]
        assert r["tp"] == sum(y for _, y, s in own if s >= r["score"]) and r["fp"] == sum(1 - y for _, y, s in own if s >= r["score"])
        assert (r["p"], r["n"]) == (sum(y for _, y, _ in own), sum(1 - y for _, y, _ in own))
