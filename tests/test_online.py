"""Features from a stream against the batch windows over the same messages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, similarity
from tidemark.streaming import online

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "message_id long, client_id long, campaign_id long, t double, channel string, is_opened int, is_clicked int, is_purchased int, is_unsubscribed int, is_complained int, opened_h double, clicked_h double, purchased_h double, unsubscribed_h double, complained_h double, first_purchase_h double, " + ", ".join(f"{c} int" for c in similarity.ATTRIBUTES)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(6)
    rows = []
    for i in range(260):
        t = 480_000.0 + rng.randrange(400) / 4  # with ties
        flag = lambda p: int(rng.random() < p)
        hours = lambda p: t + rng.randrange(9) if rng.random() < p else None  # noqa: E731, B023
        rows.append((i, rng.randrange(9), rng.randrange(6), t, rng.choice(["email", "SMS ", "mobile_push", "multichannel", None, "x"]), flag(0.5), flag(0.3), flag(0.2), flag(0.1), flag(0.1), hours(0.5), hours(0.3), hours(0.2), hours(0.1), hours(0.1), hours(0.2), *(flag(0.3) for _ in similarity.ATTRIBUTES)))
    return spark.createDataFrame(rows, SCHEMA).withColumn("sent_at", F.timestamp_seconds(F.col("t") * 3600))


def test_replay_equals_the_batch_plan(spark, log, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = online.arriving(log)
    # files in order of time, but each a little mixed up; the last moves the watermark past all
    parts = rows.withColumn("part", F.floor((F.col("t") - 480_000) / 25 + F.pmod(F.hash("message_id"), F.lit(10)) / 100).cast("int"))
    for k in range(5):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = rows.limit(1).withColumns({"message_id": F.lit(-1).cast("long"), "client_id": F.lit(-1).cast("long"), "t": F.lit(490_000.0), "sent_at": F.timestamp_seconds(F.lit(490_000.0 * 3600)), "ms": F.lit(490_000 * 3_600_000)})
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = online.features(stream, "2 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(240)
    got = {r["message_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

    df = history.applied(history.first_campaigns(log), history.campaign_count, history.counters, history.previous_flags, history.recency(), history.last_purchase, history.channel_times, similarity.like_last_success)
    want = history.cooldown(history.fatigue(df)).collect()
    assert set(got) == {r["message_id"] for r in want}
    names = {c: c for c in ("client_id", "total_messages", "total_purchases", "total_campaigns", *(f"prev_{c}" for c in online.FLAGS), "feat_fatigue", "feat_cooldown_ok", "feat_like_last_success")}
    names |= {c: f"__{c}" for c in (*history.RECENCIES, "avg_time_since_first_purchase")} | {"purchase_days": "__purchase_days"}
    for r in want:
        for mine, theirs in names.items():
            a, b = got[r["message_id"]][mine], r[theirs]
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (r["message_id"], mine)
