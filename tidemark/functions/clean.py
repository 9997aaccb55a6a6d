"""Cleaning of raw log and dimension columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: The closed lists of labels.
CAMPAIGN_TYPES = ("bulk", "transactional", "trigger")
CAMPAIGN_CHANNELS = ("email", "mobile_push", "multichannel", "sms")
TOPICS = ("event", "happy.birthday", "leave.review", "offer.after.purchase", "other", "sale.out")
MESSAGE_TYPES = ("bulk", "transactional", "trigger")
FACT_CHANNELS = ("email", "mobile_push", "web_push")
PROVIDERS = ("gmail.com", "mail.ru")
PLATFORMS = ("desktop", "smartphone", "phablet", "tablet")
#: Channels in the order of their codes; all others have the last one's.
STATE_CHANNELS = ("email", "mobile_push", "sms", "multichannel", "unknown")
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def flag(column: str | Column) -> Column:
    """1 for t, true, 1 and 1.0 in any case and padding, else 0, also for null."""
    raw = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin("t", "true", "1", "1.0").cast("int"), F.lit(0))


def id_or_sentinel(column: str | Column) -> Column:
    """A number, also when written like 12.0, as a long; -1 for what isn't one. Whole numbers keep all their digits."""
    raw = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(raw.try_cast("bigint"), raw.try_cast("double").try_cast("bigint"), F.lit(-1).cast("bigint"))


def timestamp_or_null(column: str) -> Column:
    return F.try_to_timestamp(F.col(column).cast("string"))


def epoch_hours(column: str | Column) -> Column:
    """Hours since 1970 of a timestamp's whole seconds, whatever the session's time zone."""
    ts = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("SECOND", F.expr(EPOCH), ts.cast("timestamp_ntz")) / F.lit(3600.0)


def label(column: str | Column) -> Column:
    """Trimmed, lower case, spaces as dots."""
    raw = F.col(column) if isinstance(column, str) else column
    return F.translate(F.lower(F.trim(raw)), " ", ".")


def allowed(column: Column, values: tuple[str, ...], other: str | None = None) -> Column:
    return F.when(column.isin(*values), column).otherwise(F.lit(other))


def one_hot(column: Column, prefix: str, values: tuple[str, ...]) -> list[Column]:
    """Columns of a closed list, so that schemas never depend on data; null is 0 in all. Dots in names become underscores."""
    return [F.when(column == v, 1).otherwise(0).alias(f"{prefix}{v.replace('.', '_')}") for v in values]


def hours_between(started: str, finished: str) -> Column:
    """Hours from one text timestamp to another, null where either isn't one."""
    return epoch_hours(timestamp_or_null(finished)) - epoch_hours(timestamp_or_null(started))


def duration_hours(hours: Column) -> Column:
    """Null is 24; at least 0.1."""
    return F.greatest(F.lit(0.1), F.coalesce(hours, F.lit(24.0)))


def clipped(value: Column, missing: Column | float, low: float = 0.0, high: float = 8760.0) -> Column:
    missing = missing if isinstance(missing, Column) else F.lit(missing)
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value, missing)))


def channel_code(column: Column) -> Column:
    code = F.lit(len(STATE_CHANNELS) - 1)
    for i, name in reversed([*enumerate(STATE_CHANNELS[:-1])]):
        code = F.when(column == name, i).otherwise(code)
    return code


def provider(column: Column) -> Column:
    """The listed providers; all else, empty and null-like text included, is other."""
    low = F.lower(F.trim(column))
    return F.coalesce(allowed(low, PROVIDERS, "other"), F.lit("other"))


def live(messages: DataFrame) -> DataFrame:
    """Without hard-bounced and blocked messages."""
    return messages.where("is_hard_bounced = 0 AND is_blocked = 0")


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with each missing column at its default."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([c for c in names if c in df.columns])


def zero_filled(df: DataFrame, names: list[str]) -> DataFrame:
    return df.fillna(0, names)


def normalised(df: DataFrame) -> DataFrame:
    """Booleans as 0 and 1; other columns, missing text included, as they are."""
    return df.withColumns({f.name: F.col(f.name).cast("int") for f in df.schema if isinstance(f.dataType, BooleanType)})
