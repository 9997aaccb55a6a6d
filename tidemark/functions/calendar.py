"""Calendar features of a send time; a missing time counts as day 1, Monday, hour 12, January."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar(ts: str = "sent_at") -> dict[str, Column]:
    at = F.col(ts)
    day, dow = F.coalesce(F.dayofmonth(at), F.lit(1)), F.coalesce(F.weekday(at), F.lit(0))
    hour, month = F.coalesce(F.hour(at), F.lit(12)), F.coalesce(F.month(at), F.lit(1))
    return {
        "cal_week_of_month": F.floor((day - 1) / 7).cast("int") + 1,
        "cal_is_weekend": (dow >= 5).cast("int"),
        "feat_dow_shift": F.sin(F.lit(2 * math.pi) * dow / 7),
        "feat_hour_shift": F.sin(F.lit(2 * math.pi) * hour / 24),
        "feat_payday_bump": F.exp(-F.least(F.abs(day - 10), F.abs(day - 25)) / F.lit(3.0)),
        "feat_eoq_bump": F.exp(-F.greatest(F.lit(0), F.when(month.isin(3, 6, 9, 12), 30 - day).otherwise(30)) / F.lit(5.0)),
    }
