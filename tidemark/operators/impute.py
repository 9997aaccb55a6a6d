"""Medians over the log and what is filled in with them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.sources.scratch import scratch, written

#: Values of a span that are sorted at once; accuracy of the sketches that narrow larger ones.
SELECTED, SKETCH = 100_000, 10_000

#: What stands in for the median of a column without values.
FALLBACK = {"__purchase_days": 14.0, "__topic_gap": 48.0}


def medians(df: DataFrame, columns: list[str], fit_on: Column | None = None, accuracy: int | None = None) -> DataFrame:
    """One row: each column's exact median without nulls, over all rows or those that fit_on picks.

    No aggregate holds all distinct values: see selected(). accuracy asks for one pass of approximate percentiles instead.
    """
    rows = (df.where(fit_on) if fit_on is not None else df).select(*(F.col(c).cast("double").alias(c) for c in columns))
    missing = lambda c: FALLBACK.get(c, 24.0)
    if accuracy:
        return rows.agg(*(F.coalesce(F.percentile_approx(c, 0.5, accuracy).cast("double"), F.lit(missing(c))).alias(f"{c}_med") for c in columns))
    rows = written(rows, f"{scratch(df.sparkSession, 'medians')}/columns")
    sizes = rows.agg(*(F.count(c).alias(c) for c in columns)).first()
    ranks = {(c, r): None for c in columns if sizes[c] for r in ((sizes[c] - 1) // 2, sizes[c] // 2)}
    values = selected(rows, sizes.asDict(), list(ranks))
    middle = lambda c: (values[c, (sizes[c] - 1) // 2] + values[c, sizes[c] // 2]) / 2 if sizes[c] else missing(c)
    return df.sparkSession.range(1).select(*(F.lit(float(middle(c))).alias(f"{c}_med") for c in columns))


@dataclass(frozen=True)
class Span:
    """Values of a column strictly between two of its values (None: no bound), n of them."""

    column: str
    low: float | None
    high: float | None
    n: int

    def has(self) -> Column:
        v = F.col(self.column)
        above = v.isNotNull() if self.low is None else v > self.low
        return above if self.high is None else above & (v < self.high)


def selected(rows: DataFrame, sizes: dict[str, int], wanted: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The values at ranks (column, rank from 0, nulls left out) of a written table of doubles.

    Each rank is searched in a span of values. A pass takes a sketch of bounded size of every open span, a second one counts
    what lies under, at, between and above two values that the sketch puts close around the rank; so a span shrinks by a
    factor of thousands, also where values crowd or repeat. Spans of at most SELECTED values are taken and sorted.
    """
    found: dict[tuple[str, int], float] = {}
    at = {(c, r): (Span(c, None, None, sizes[c]), r) for c, r in wanted}
    while at:
        small = list(dict.fromkeys(s for s, _ in at.values() if s.n <= SELECTED))
        if small:
            each = F.explode(F.array(*(F.when(s.has(), F.struct(F.lit(i).alias("i"), F.col(s.column).alias("v"))) for i, s in enumerate(small)))).alias("x")
            taken = rows.select(each).where("x IS NOT NULL").select("x.*").toArrow()  # SELECTED values a span
            i, v = taken.column("i").to_numpy(), taken.column("v").to_numpy()
            sorted_ = {s: np.sort(v[i == k]) for k, s in enumerate(small)}
            found |= {key: float(sorted_[s][rank]) for key, (s, rank) in at.items() if s in sorted_}
            at = {key: x for key, x in at.items() if x[0] not in sorted_}
        if not at:
            break
        keys = list(at)
        near = lambda s, rank: [min(1.0, max(0.0, (rank + 0.5) / s.n + d)) for d in (-1.5 / SKETCH, 1.5 / SKETCH)]
        cuts = rows.agg(*(F.percentile_approx(F.when(at[k][0].has(), F.col(k[0])), near(*at[k]), SKETCH).alias(f"c{i}") for i, k in enumerate(keys))).first()
        counts = []
        for i, key in enumerate(keys):
            v, has, (a, b) = F.col(key[0]), at[key][0].has(), cuts[i]
            counts += [F.count_if(has & c).alias(f"n{i}_{j}") for j, c in enumerate((v < a, v == a, (v > a) & (v < b), (v == b) & F.lit(b > a)))]
        seen = rows.agg(*counts).first()
        for i, key in enumerate(keys):
            (span, rank), (a, b) = at.pop(key), cuts[i]
            under, at_a, between, at_b = (seen[f"n{i}_{j}"] for j in range(4))
            parts = [(under, Span(span.column, span.low, a, under)), (at_a, a), (between, Span(span.column, a, b, between)), (at_b, b), (span.n, Span(span.column, b, span.high, span.n - under - at_a - between - at_b))]
            for n, part in parts:
                if rank < n:
                    if isinstance(part, Span):
                        at[key] = (part, rank)
                    else:
                        found[key] = float(part)
                    break
                rank -= n
    return found


def with_medians(df: DataFrame, columns: list[str], **how) -> DataFrame:
    return df.join(F.broadcast(medians(df, columns, **how)))  # one row


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each __name as name: missing is the median, clipped to 0..8760 hours. Needs with_medians."""
    return df.withColumns({c.lstrip("_"): clean.clipped(F.col(c), F.col(f"{c}_med")) for c in columns})


def purchase_features(df: DataFrame) -> DataFrame:
    """days_since_last_purchase, feat_rtb_hazard, feat_postbuy_refrac: of buyers; others have 365, 0, 0."""
    buyer, med = F.col("has_prior_purchase") == 1, F.col("__purchase_days_med")
    df = df.withColumn("days_since_last_purchase", F.when(buyer, clean.clipped(F.col("__purchase_days"), med, high=365.0)).otherwise(365.0))
    days = F.col("days_since_last_purchase")
    z = (days - med) / 7
    return df.withColumns({"feat_rtb_hazard": F.when(buyer, F.exp(-0.5 * z * z)).otherwise(0.0), "feat_postbuy_refrac": F.when(buyer, F.exp(-days / 14)).otherwise(0.0)})


def topic_features(df: DataFrame) -> DataFrame:
    df = df.withColumn("topic_t_since_hours", clean.clipped(F.col("__topic_gap"), F.col("__topic_gap_med")))
    return df.withColumn("feat_topic_novelty", F.exp(-F.col("topic_t_since_hours") / 48))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, by its population standard deviation (1 where that is 0)."""
    stats = df.agg(*(f(c).alias(f"{c}{s}") for c in columns for f, s in ((F.avg, "_mean"), (F.stddev_pop, "_sd"))))
    sd = lambda c: F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0)
    return df.join(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / sd(c) for c in columns}).drop(*(f"{c}{s}" for c in columns for s in ("_mean", "_sd")))
