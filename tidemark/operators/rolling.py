"""Look-back windows of 30 and 7 days: per client by prefix sums, and over all clients by prefix sums in ranges of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.operators.history import earlier, kernel, order, up_to_now

MONTH, WEEK = 720.0, 168.0


def _start(value: Column, hours: float) -> Column:
    """value at the first row whose time is at most `hours` back; without a time, where the last timed row's window began."""
    reach = Window.partitionBy("client_id").orderBy(F.col("t").asc_nulls_last()).rangeBetween(-int(hours), 0)
    return F.when(F.col("t").isNotNull(), F.min(value).over(reach))


def _running() -> dict[str, Column]:
    before = lambda c: F.coalesce(F.sum(c).over(earlier()), F.lit(0))
    gap = F.col("t") - F.lag("t").over(order())
    return {"__rn": F.row_number().over(order()), "__open": before("is_opened"), "__click": before("is_clicked"), "__before": F.lag("t").over(order()), "__gap": F.coalesce(gap * gap, F.lit(0.0))}


def _looked_back(df: DataFrame) -> DataFrame:
    df = df.withColumn("__gaps", F.sum("__gap").over(up_to_now()))
    starts = {f"__{c}_{n}": _start(F.col(f"__{c}"), h) for n, h in (("30", MONTH), ("7", WEEK)) for c in ("rn", "open", "click")}
    starts |= {"__t_30": _start(F.col("t"), MONTH), "__gaps_30": _start(F.col("__gaps"), MONTH), "__sq_to": F.lag("__gaps").over(order())}
    df = df.withColumns(starts)
    first = {"rn": 1, "open": 0, "click": 0}
    df = df.withColumns({f"__{c}_{n}": F.coalesce(F.last(f"__{c}_{n}", ignorenulls=True).over(up_to_now()), F.lit(v)) for n in ("30", "7") for c, v in first.items()})
    n = {d: F.col("__rn") - F.col(f"__rn_{d}") for d in ("30", "7")}
    total = lambda c, d: F.col(f"__{c}") - F.col(f"__{c}_{d}")
    rate = lambda c, d: F.when(n[d] > 0, total(c, d) / n[d])
    speed = lambda c: F.coalesce(rate(c, "7") - rate(c, "30"), F.lit(0.0))
    m = n["30"] - 1
    mean = (F.col("__before") - F.col("__t_30")) / m
    variance = (F.col("__sq_to") - F.col("__gaps_30")) / m - mean * mean
    out = {
        "u_open_cnt_30d": total("open", "30").cast("double"),
        "u_open_rate_30d": F.coalesce(rate("open", "30"), F.lit(0.0)),
        "u_click_rate_30d": F.coalesce(rate("click", "30"), F.lit(0.0)),
        "u_open_velocity_7d_30d": speed("open"),
        "u_click_velocity_7d_30d": speed("click"),
        "u_cadence_std_30d": F.when((m > 0) & F.col("t").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), variance))).otherwise(0.0),
    }
    return df.withColumns(out).drop("__gaps", *_running(), *starts)


#: u_open_cnt_30d, u_open_rate_30d, u_click_rate_30d, both velocities, u_cadence_std_30d. A window's count and sums are
#: differences of running totals, which never fall, so a range frame's least total is the total at its start; equal times
#: and the current row need no special care.
rolling = kernel(_running, after=_looked_back)


def global_open_rate(df: DataFrame) -> DataFrame:
    """ctx_tc_open_rate_30d: the open rate of all clients' earlier messages of the last 30 days; 0.25 without any.

    Each message is an event at t and a probe at t - 30 days, in one order of time. Running totals of events and opens are
    made in ranges of that order which follow the load, so a day of any size is many tasks; the difference of a message's
    two is its window. Messages without a time have no window.
    """
    timed = df.where("t IS NOT NULL").select("message_id", "t", "is_opened")
    both = timed.select("message_id", "is_opened", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("t").alias("pos")), F.struct(F.lit(0).alias("kind"), (F.col("t") - MONTH).alias("pos")))).alias("e"))
    both = both.select("message_id", "e.kind", "e.pos", F.when(F.col("e.kind") == 1, F.col("is_opened")).otherwise(0).alias("opened"))
    order = [F.col("pos"), F.col("kind"), F.col("message_id")]
    run = ranges.running(ranges.in_ranges(both, order, "open-rate"), order, {"n": F.col("kind"), "s": F.col("opened")}, inclusive=False)
    sign = F.when(F.col("kind") == 1, 1).otherwise(-1)
    windows = run.groupBy("message_id").agg(F.sum(sign * F.col("n")).alias("__n"), F.sum(sign * F.col("s")).alias("__s"))
    rate = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).otherwise(0.25)
    return df.join(windows, "message_id", "left").withColumn("ctx_tc_open_rate_30d", rate).drop("__n", "__s")
