"""The feature table: 64 model inputs and extras, point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.functions.calendar import calendar
from tidemark.operators import history, impute, rolling, sampling, similarity
from tidemark.sources import crm
from tidemark.sources.scratch import scratch, written

IMPUTED = [f"__{c}" for c in (*history.RECENCIES, "avg_time_since_first_purchase")]
CAMPAIGN = similarity.ATTRIBUTES
FACT = [*(f"channel_{c}" for c in clean.FACT_CHANNELS), *(f"message_type_{c}" for c in clean.MESSAGE_TYPES), "email_provider_gmail_com", "email_provider_mail_ru", "email_provider_other", *(f"platform_{c}" for c in clean.PLATFORMS), "platform_rest"]
GROUPS = {
    "v0": ["avg_campaign_duration", *(c.lstrip("_") for c in IMPUTED), *CAMPAIGN, *FACT, "is_holiday", "prev_is_opened", "prev_is_clicked", "prev_is_unsubscribed", "prev_is_complained", "total_messages", "total_campaigns", "total_purchases"],
    "v1": ["days_since_last_purchase", "feat_rtb_hazard", "feat_postbuy_refrac"],
    "v2": ["cal_week_of_month", "cal_is_weekend", "feat_dow_shift", "feat_hour_shift", "feat_payday_bump", "feat_eoq_bump"],
    "v3": ["feat_fatigue", "feat_last_email_hours", "feat_last_mobile_push_hours", "feat_last_any_hours", "u_open_cnt_30d", "u_open_rate_30d", "u_click_rate_30d", "u_cadence_std_30d", "ctx_tc_open_rate_30d"],
    "v4": ["topic_N7", "topic_t_since_hours", "feat_topic_novelty", "feat_like_last_success", "feat_path_align"],
}
INPUTS = [c for g in GROUPS.values() for c in g]
EXTRAS = ["has_prior_purchase", "feat_cooldown_ok", "feat_last_sms_hours", "feat_last_multichannel_hours", "u_open_velocity_7d_30d", "u_click_velocity_7d_30d"]
EXPERIMENTS = {"base": ["v0"], **{f"v0_v{i}": ["v0", f"v{i}"] for i in range(1, 5)}, "all": list(GROUPS)}


def inputs_of(experiment: str) -> list[str]:
    return [c for g in EXPERIMENTS[experiment] for c in GROUPS[g]]


def fact_columns(df: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.trim(F.col(c)))
    provider = clean.provider(F.col("email_provider"))
    rest = F.when(low("platform").isin(*clean.PLATFORMS), 0).otherwise(1)
    return df.select("*", *clean.one_hot(low("channel"), "channel_", clean.FACT_CHANNELS), *clean.one_hot(F.lower("message_type"), "message_type_", clean.MESSAGE_TYPES), *clean.one_hot(provider, "email_provider_", (*clean.PROVIDERS, "other")), *clean.one_hot(low("platform"), "platform_", clean.PLATFORMS), rest.alias("platform_rest"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live log with its dimensions."""
    return crm.enriched(clean.live(crm.messages(spark, sf_dir)), crm.campaigns(crm.raw_campaigns(spark, sf_dir)), crm.clients(spark, sf_dir), crm.holidays(spark))


def state(df: DataFrame, tau: dict[str, float] | None = None, strict_time: bool = False) -> DataFrame:
    """All per-client state, without imputation."""
    kernels = (history.campaign_count, history.counters, history.previous_flags, history.recency(strict_time), history.last_purchase, history.channel_times, history.topics, similarity.like_last_success, similarity.path_alignment, rolling.rolling)
    df = history.applied(history.first_campaigns(df), *kernels)
    return history.channel_recency(history.cooldown(history.fatigue(df, tau))).withColumns(calendar())


def stated(df: DataFrame, tau: dict[str, float] | None = None, strict_time: bool = False) -> DataFrame:
    """The state of an enriched log, written once: medians, the open rate of all clients and the table itself read it."""
    return written(state(fact_columns(df), tau, strict_time), f"{scratch(df.sparkSession, 'features')}/state")


def completed(df: DataFrame, fit_on: Column | None = None, accuracy: int | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """The feature table of a written state, and the columns kept of it besides."""
    columns = [*IMPUTED, "__purchase_days", "__topic_gap"]
    medians = impute.medians(df, columns, fit_on=fit_on, accuracy=accuracy)
    df = rolling.global_open_rate(df).join(F.broadcast(medians))  # one row
    df = impute.topic_features(impute.purchase_features(impute.filled(df, IMPUTED)))
    return df.select("message_id", "client_id", "sent_at", "t", "is_purchased", *INPUTS, *EXTRAS, *kept)


def build(df: DataFrame, tau: dict[str, float] | None = None, fit_on: Column | None = None, accuracy: int | None = None, strict_time: bool = False) -> DataFrame:
    """The feature table of an enriched log. fit_on: on which rows medians are fitted (all, by default).

    accuracy: approximate medians for a log whose distinct values don't fit a task.
    """
    return completed(stated(df, tau, strict_time), fit_on, accuracy)


def sampled(df: DataFrame, rate: Column | float, full_history: bool = False, **how) -> DataFrame:
    """The feature table of all positives and of negatives at this rate.

    Rows are sampled first, so that history is the sampled one; with full_history features are made of the whole log.
    """
    if full_history:
        return sampling.bernoulli_negatives(build(df, **how), rate)
    return build(sampling.bernoulli_negatives(df, rate), **how)
