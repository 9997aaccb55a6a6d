"""The customer-messaging tables, as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import clean


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(code, values: tuple[str | None, ...]):
    out = F.lit(values[-1])
    for i, v in reversed([*enumerate(values[:-1])]):
        out = F.when(code == i, F.lit(v)).otherwise(out)
    return out


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message log, from events. t and the *_h columns are epoch hours; sent_at has no time zone."""
    k, kind = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), F.col("event_type")
    raw = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"), k.alias("k"))
    k = F.col("k")
    on = lambda c: c.cast("int")
    rows = raw.select(
        F.col("event_id").alias("message_id"),
        F.col("user_id").alias("client_id"),
        k.cast("long").alias("campaign_id"),
        F.col("ts").alias("sent_at"),
        clean.epoch_hours("ts").alias("t"),
        _pick(k % 5, ("email", "mobile_push", "sms", "multichannel", "web_push")).alias("channel"),
        _pick(k % 3, ("bulk", "transactional", "trigger")).alias("message_type"),
        _pick(k % 4, ("gmail.com", "mail.ru", "yahoo.com", None)).alias("email_provider"),
        _pick(k % 6, ("desktop", "smartphone", "phablet", "tablet", "tv", None)).alias("platform"),
        on(kind.isin("view", "click", "purchase")).alias("is_opened"),
        on(kind.isin("click", "purchase")).alias("is_clicked"),
        on(kind == "purchase").alias("is_purchased"),
        on((kind == "error") & (k % 10 == 0)).alias("is_unsubscribed"),
        on((kind == "error") & (k % 10 == 1)).alias("is_complained"),
        on((kind == "signup") & (k % 20 == 0)).alias("is_hard_bounced"),
        on((kind == "signup") & (k % 20 == 1)).alias("is_blocked"),
        "value",
        "k",
    )
    after = lambda cond, d: F.when(cond, F.col("t") + F.col("value") / d)
    return rows.withColumns(
        {
            "opened_h": after(F.col("is_opened") == 1, 60.0),
            "clicked_h": after(F.col("is_clicked") == 1, 30.0),
            "purchased_h": after((F.col("is_purchased") == 1) & (k % 7 != 0), 20.0),
            "unsubscribed_h": after(F.col("is_unsubscribed") == 1, 60.0),
            "complained_h": after(F.col("is_complained") == 1, 60.0),
        }
    )


def raw_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    topic = F.lit("survey")
    for name, text in (("SMALL", "sale out "), ("PROMO", "offer after purchase"), ("MEDIUM", "Leave review"), ("LARGE", "happy birthday"), ("ECONOMY", " Event")):
        topic = F.when(kind == name, text).otherwise(topic)
    return read(spark, sf_dir, "part").where("p_partkey % 10 <> 9").select(
        F.col("p_partkey").alias("campaign_id"),
        topic.alias("topic"),
        _pick(size % 4, ("bulk", "Transactional", "trigger", "test")).alias("campaign_type"),
        _pick(size % 5, ("email", "mobile_push", "sms", "multichannel", "web_push")).alias("channel"),
        F.when(size % 6 != 0, size.cast("double") * 1.5 - 6).alias("duration_h"),
    )


def campaigns(raw: DataFrame) -> DataFrame:
    """One row per campaign: camp_* one-hot columns, avg_campaign_duration, vec (the one-hots as bits)."""
    kind = clean.allowed(clean.label("campaign_type"), clean.CAMPAIGN_TYPES)
    channel = clean.allowed(clean.label("channel"), clean.CAMPAIGN_CHANNELS)
    topic = F.coalesce(clean.allowed(clean.label("topic"), clean.TOPICS, "other"), F.lit("other"))
    hot = [*clean.one_hot(kind, "camp_campaign_type", clean.CAMPAIGN_TYPES), *clean.one_hot(channel, "camp_channel", clean.CAMPAIGN_CHANNELS), *clean.one_hot(topic, "camp_topic", clean.TOPICS)]
    first = raw.withColumn("__n", F.row_number().over(Window.partitionBy("campaign_id").orderBy("topic", "campaign_type", "channel", "duration_h"))).where("__n = 1")
    return first.select("campaign_id", *hot, clean.duration_hours(F.col("duration_h")).alias("avg_campaign_duration"))



def campaign_dimension(raw: DataFrame) -> DataFrame:
    """A campaign file's columns under the names that campaigns() reads; columns that it lacks are null."""
    raw = raw.withColumnRenamed("id", "campaign_id")
    raw = clean.ensure_columns(raw, {c: F.lit(None).cast("string") for c in ("topic", "campaign_type", "channel", "started_at", "finished_at")})
    return raw.withColumn("duration_h", clean.hours_between("started_at", "finished_at")).drop("started_at", "finished_at")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("client_id")).agg(F.min("o_orderdate").alias("first_purchase_date"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id")).join(orders, "client_id", "left").withColumn("first_purchase_h", clean.epoch_hours("first_purchase_date"))


def holidays(spark: SparkSession) -> DataFrame:
    days = ("2024-01-01", "2024-01-06", "2024-01-15", "2024-01-26")
    return spark.sql("SELECT DATE'" + "' AS date, 1 AS is_holiday UNION ALL SELECT DATE'".join(days) + "' AS date, 1 AS is_holiday")


def enriched(log: DataFrame, campaign: DataFrame, client: DataFrame, holiday: DataFrame) -> DataFrame:
    """The log with its dimensions, each on a unique key; Spark broadcasts those that it finds small enough."""
    rows = log.join(client.select("client_id", "first_purchase_h"), "client_id", "left").join(campaign, "campaign_id", "left")
    rows = rows.withColumn("__date", F.to_date("sent_at")).join(holiday.withColumnRenamed("date", "__date"), "__date", "left").drop("__date")
    return rows.withColumns({"is_holiday": F.coalesce("is_holiday", F.lit(0)), "avg_campaign_duration": F.coalesce("avg_campaign_duration", F.lit(24.0))})


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second log, from orders, with same-time messages of a client."""
    price, digit = F.col("o_totalprice"), F.substring("o_orderpriority", 1, 1).cast("int")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("message_id"),
        F.col("o_custkey").alias("client_id"),
        clean.epoch_hours("o_orderdate").alias("t"),
        _pick(digit % 5, ("email", "mobile_push", "sms", "multichannel", "web_push")).alias("channel"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_opened"),
        (F.col("o_orderstatus") == "O").cast("int").alias("is_clicked"),
        (price > 400000).cast("int").alias("is_purchased"),
    )
