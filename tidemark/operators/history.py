"""Point-in-time state of a client, from strictly earlier messages.

All windows share one order, so the whole family needs one exchange and one sort by client.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import clean

#: Decay constants and cool-down, in hours, for STATE_CHANNELS.
TAU = {"email": 48.0, "mobile_push": 24.0, "sms": 72.0, "multichannel": 48.0, "unknown": 48.0}
COOL = {"email": 24.0, "mobile_push": 6.0, "sms": 24.0, "multichannel": 24.0, "unknown": 24.0}
RECENCIES = {"avg_time_since_last_open": "opened_h", "avg_time_since_last_click": "clicked_h", "avg_time_since_unsubscribe": "unsubscribed_h", "avg_time_since_complaint": "complained_h"}


def order() -> WindowSpec:
    return Window.partitionBy("client_id").orderBy(F.col("t").asc_nulls_last(), "message_id")


def earlier() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, -1)


def up_to_now() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def last_before(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(earlier())


class Kernel(NamedTuple):
    """One family of features: columns of the row, then windows over them, then what follows from both."""

    before: Callable[[], dict[str, Column]]
    windows: Callable[[], dict[str, Column]]
    after: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return applied(df, self)


def applied(df: DataFrame, *kernels: Kernel) -> DataFrame:
    """All kernels at once: their windows become one window operator, rather than one each."""
    for step in ("before", "windows"):
        new = {name: c for k in kernels for name, c in getattr(k, step)().items()}
        df = df.withColumns(new) if new else df
    for k in kernels:
        df = k.after(df)
    return df


def kernel(windows: Callable[[], dict[str, Column]], before: Callable[[], dict[str, Column]] = dict, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> Kernel:
    return Kernel(before, windows, after)


#: total_messages, total_purchases, has_prior_purchase.
counters = kernel(
    lambda: {"total_messages": (F.row_number().over(order()) - 1).cast("long"), "total_purchases": F.coalesce(F.sum("is_purchased").over(earlier()), F.lit(0)).cast("long")},
    after=lambda df: df.withColumn("has_prior_purchase", (F.col("total_purchases") > 0).cast("int")),
)


def first_campaigns(df: DataFrame) -> DataFrame:
    """__first: whether a message is the client's first of its campaign."""
    first = Window.partitionBy("client_id", "campaign_id").orderBy(F.col("t").asc_nulls_last(), "message_id")
    return df.withColumn("__first", (F.row_number().over(first) == 1).cast("int"))


#: total_campaigns: a campaign's first message counts for all later ones. Needs first_campaigns.
campaign_count = kernel(lambda: {"total_campaigns": F.coalesce(F.sum("__first").over(earlier()), F.lit(0)).cast("long")}, after=lambda df: df.drop("__first"))


def distinct_campaigns(df: DataFrame) -> DataFrame:
    return campaign_count(first_campaigns(df))


#: prev_is_*: the last known value of each flag, 0 without any.
previous_flags = kernel(lambda: {f"prev_{c}": F.coalesce(last_before(F.col(c)), F.lit(0)) for c in ("is_opened", "is_clicked", "is_unsubscribed", "is_complained")})


def recency(strict_time: bool = False) -> Kernel:
    """Raw hours since the last response known from earlier messages, and since the first purchase.

    A response may come after the current message is sent; that gives negative hours, clipped to 0 later. strict_time
    leaves such responses out.
    """
    known = lambda c: F.last(F.when(F.col(c) <= F.col("t"), F.col(c)) if strict_time else F.col(c), ignorenulls=True)
    hours = lambda: {f"__{new}": F.col("t") - known(src).over(earlier()) for new, src in RECENCIES.items()}
    return kernel(lambda: hours() | {"__avg_time_since_first_purchase": F.col("t") - F.last("first_purchase_h", ignorenulls=True).over(up_to_now())})


def recencies(df: DataFrame, strict_time: bool = False) -> DataFrame:
    return recency(strict_time)(df)


#: __purchase_days: days since the last earlier purchase, at its own time if known, else its message's.
last_purchase = kernel(lambda: {"__purchase_days": (F.col("t") - last_before(F.when(F.col("is_purchased") == 1, F.coalesce("purchased_h", "t")))) / 24})

#: __code, and of each state channel the time of the last earlier message and whether there was one: __last_0, __seen_0 and so on.
channel_times = kernel(
    lambda: {f"__last_{i}": last_before(F.when(F.col("__code") == i, F.col("t"))) for i in range(len(clean.STATE_CHANNELS))} | {f"__seen_{i}": F.max(F.when(F.col("__code") == i, 1)).over(earlier()) for i in range(len(clean.STATE_CHANNELS))},
    before=lambda: {"__code": clean.channel_code(F.lower(F.trim(F.coalesce("channel", F.lit("unknown")))))},
)


def fatigue(df: DataFrame, tau: dict[str, float] | None = None, name: str = "feat_fatigue") -> DataFrame:
    """Decayed last touches summed over channels. Needs channel_times; tau_hours is the e-folding time."""
    tau = TAU | (tau or {})
    total = F.lit(0.0)
    for i, c in enumerate(clean.STATE_CHANNELS):
        gap = F.col("t") - F.col(f"__last_{i}")
        total = total + F.when(gap >= 0, F.exp(-gap / F.lit(tau[c]))).otherwise(0.0)
    return df.withColumn(name, total)


def cooldown(df: DataFrame) -> DataFrame:
    """feat_cooldown_ok: the channel is new to the client or rested; 0 on a message without a time in a seen channel."""
    code = F.col("__code")
    own = F.element_at(F.array(*(F.col(f"__last_{i}") for i in range(5))), code + 1)
    cool = F.element_at(F.array(*(F.lit(COOL[c]) for c in clean.STATE_CHANNELS)), code + 1)
    seen = F.element_at(F.array(*(F.col(f"__seen_{i}") for i in range(5))), code + 1)
    return df.withColumn("feat_cooldown_ok", F.when(seen.isNull(), 1).when(F.col("t") - own >= cool, 1).otherwise(0))


def channel_recency(df: DataFrame) -> DataFrame:
    hours = {f"feat_last_{c}_hours": clean.clipped(F.col("t") - F.col(f"__last_{i}"), 72.0) for i, c in enumerate(clean.STATE_CHANNELS[:4])}
    return df.withColumns(hours).withColumn("feat_last_any_hours", F.least("feat_last_email_hours", "feat_last_mobile_push_hours"))


def _topic() -> Column:
    code = F.lit(0)
    for i, v in reversed([*enumerate(clean.TOPICS)]):
        code = F.when(F.col(f"camp_topic{v.replace('.', '_')}") == 1, i).otherwise(code)
    return code


#: topic_N7 and __topic_gap: hours since the client's last message of the same topic.
topics = kernel(
    lambda: {f"__topic_{i}": last_before(F.when(F.col("topic_N7") == i, F.col("t"))) for i in range(len(clean.TOPICS))},
    before=lambda: {"topic_N7": _topic()},
    after=lambda df: df.withColumn("__topic_gap", F.col("t") - F.element_at(F.array(*(F.col(f"__topic_{i}") for i in range(len(clean.TOPICS)))), F.col("topic_N7") + 1)).drop(*(f"__topic_{i}" for i in range(len(clean.TOPICS)))),
)
