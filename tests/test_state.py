"""Point-in-time state against plain loops, on small logs with ties, missing times and one-row clients."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import history, rolling, sampling, similarity

SCHEMA = "message_id long, client_id long, campaign_id long, t double, channel string, is_opened int, is_clicked int, is_unsubscribed int, is_complained int, is_purchased int, opened_h double, purchased_h double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(240):
        client = rng.choice([-1, 1, 2, 3]) if i else 99
        t = None if rng.random() < 0.05 else float(rng.choice([rng.randrange(0, 60) * 24, 720, 1440]))
        opened, bought = int(rng.random() < 0.4), int(rng.random() < 0.2)
        out.append((i, client, rng.randrange(6), t, rng.choice(["email", "sms", "mobile_push", "web_push", "multichannel", None]), opened, int(rng.random() < 0.3), 0, 0, bought, t + 1 if opened and t is not None else None, t + 2 if bought and t is not None and rng.random() < 0.5 else None))
    return out


def by_client(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], math.inf if r[3] is None else r[3], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups.values()


def test_counters_and_flags(spark, rows):
    df = history.distinct_campaigns(history.previous_flags(history.counters(spark.createDataFrame(rows, SCHEMA))))
    got = {r["message_id"]: r for r in df.collect()}
    for group in by_client(rows):
        for i, r in enumerate(group):
            x = got[r[0]]
            assert x["total_messages"] == i
            assert x["total_purchases"] == sum(p[9] for p in group[:i])
            assert x["total_campaigns"] == len({p[2] for p in group[:i]})
            assert x["prev_is_opened"] == (group[i - 1][5] if i else 0)


def test_fatigue_and_cooldown(spark, rows):
    got = {r["message_id"]: r for r in history.cooldown(history.fatigue(history.channel_times(spark.createDataFrame(rows, SCHEMA)))).collect()}
    code = {"email": 0, "mobile_push": 1, "sms": 2, "multichannel": 3}
    tau, cool = [*history.TAU.values()], [*history.COOL.values()]
    for group in by_client(rows):
        last, seen = {}, set()
        for r in group:
            c, t = code.get(r[4], 4), r[3]
            want = sum(math.exp(-(t - v) / tau[k]) for k, v in last.items() if t is not None and t >= v)
            assert got[r[0]]["feat_fatigue"] == pytest.approx(want, abs=1e-12)
            rested = c not in seen or (t is not None and c in last and t - last[c] >= cool[c])
            assert got[r[0]]["feat_cooldown_ok"] == int(rested)
            seen.add(c)
            if t is not None:
                last[c] = t


def test_rolling(spark, rows):
    got = {r["message_id"]: r for r in rolling.rolling(spark.createDataFrame(rows, SCHEMA)).collect()}
    for group in by_client(rows):
        start = {720: 0, 168: 0}
        for i, r in enumerate(group):
            for h in start:
                while r[3] is not None and start[h] < i and group[start[h]][3] < r[3] - h:
                    start[h] += 1
            month, week = group[start[720] : i], group[start[168] : i]
            rate = lambda part, k: sum(p[k] for p in part) / len(part) if part else 0.0
            x = got[r[0]]
            assert x["u_open_cnt_30d"] == sum(p[5] for p in month)
            assert x["u_open_rate_30d"] == pytest.approx(rate(month, 5))
            assert x["u_click_rate_30d"] == pytest.approx(rate(month, 6))
            assert x["u_open_velocity_7d_30d"] == pytest.approx(rate(week, 5) - rate(month, 5) if week else 0.0)
            if r[3] is not None:
                gaps = [b[3] - a[3] for a, b in zip(month, month[1:], strict=False)]
                mean = sum(gaps) / len(gaps) if gaps else 0
                assert x["u_cadence_std_30d"] == pytest.approx(math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if gaps else 0.0, abs=1e-6)


def test_global_open_rate(spark, rows):
    got = {r["message_id"]: r["ctx_tc_open_rate_30d"] for r in rolling.global_open_rate(spark.createDataFrame(rows, SCHEMA)).collect()}
    timed = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0]))
    for i, r in enumerate(timed):
        window = [p[5] for p in timed[:i] if p[3] >= r[3] - 720]
        assert got[r[0]] == pytest.approx(sum(window) / len(window) if window else 0.25)


def test_similarity(spark):
    rng = random.Random(5)
    schema = "message_id long, client_id long, t double, is_purchased int, " + ", ".join(f"{c} int" for c in similarity.ATTRIBUTES)
    rows = [(i, rng.randrange(4), float(rng.randrange(20)), int(rng.random() < 0.3), *(rng.choice([0, 1, None]) for _ in similarity.ATTRIBUTES)) for i in range(120)]
    got = {r["message_id"]: r for r in similarity.path_alignment(similarity.like_last_success(spark.createDataFrame(rows, schema))).collect()}
    for client in range(4):
        won, past, aligned = None, [0] * 13, []
        for r in sorted((r for r in rows if r[1] == client), key=lambda r: (r[2], r[0])):
            v = [x or 0 for x in r[4:]]
            union = sum(a | b for a, b in zip(v, won, strict=True)) if won else 0
            assert got[r[0]]["feat_like_last_success"] == pytest.approx(sum(a & b for a, b in zip(v, won, strict=True)) / union if union else 0.0)
            norm = math.sqrt(sum(a * a for a in past)) * math.sqrt(sum(v))
            now = sum(a * b for a, b in zip(past, v, strict=True)) / norm if norm else 0.0
            assert got[r[0]]["feat_path_align"] == pytest.approx(now - sum(aligned) / len(aligned) if aligned else 0.0, abs=1e-9)
            aligned.append(now)
            past = [a + b for a, b in zip(past, v, strict=True)]
            won = v if r[3] else won


def test_later_messages_change_nothing(spark, rows):
    whole, cut = spark.createDataFrame(rows, SCHEMA), [r for r in rows if r[3] is not None and r[3] <= 800]
    make = lambda df: rolling.rolling(history.fatigue(history.channel_times(history.counters(df)))).where("t <= 800")
    names = ["message_id", "total_messages", "feat_fatigue", "u_open_cnt_30d"]
    assert sorted(make(whole).select(names).collect()) == sorted(make(spark.createDataFrame(cut, SCHEMA)).select(names).collect())


def test_one_exchange_serves_all_client_windows(spark, rows):
    df = rolling.rolling(history.fatigue(history.channel_times(history.previous_flags(history.counters(spark.createDataFrame(rows, SCHEMA))))))
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, plan


def test_clean(spark):
    df = spark.createDataFrame([(" T ", "12.0", " Happy Birthday"), ("1.0", "x", None), (None, None, "sale out")], "a string, b string, c string")
    out = df.select(clean.flag("a"), clean.id_or_sentinel("b"), clean.label("c")).collect()
    assert [tuple(r) for r in out] == [(1, 12, "happy.birthday"), (1, -1, None), (0, -1, "sale.out")]
    with pytest.raises(ValueError, match="missing columns: z"):
        clean.require_columns(df, ["a", "z"])
    assert clean.ensure_columns(df, {"d": F.lit(1)}).columns == ["a", "b", "c", "d"]


def test_samples(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "message_id long, is_purchased int")
    assert sampling.exact_sample(df, 30, 200).groupBy("is_purchased").count().orderBy("is_purchased").collect() == [(0, 200), (1, 30)]
    with pytest.raises(ValueError):
        sampling.check_sizes(df, 101, 10)
    splits = {(r[0], r[1]): r[2] for r in sampling.stratified_split(df).groupBy("is_purchased", "split").count().collect()}
    assert splits == {(0, "test"): 135, (0, "validation"): 135, (0, "train"): 630, (1, "test"): 15, (1, "validation"): 15, (1, "train"): 70}
    assert {r[1] for r in sampling.stratified_folds(df, 5).groupBy("fold", "is_purchased").count().select("is_purchased", "count").collect()} == {180, 20}
