"""Diagnostics over the feature table, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlation(a: str, b: str) -> Column:
    """Pearson's; 0 where a column doesn't vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.when(spread > 0, F.covar_pop(x, y) / spread), F.lit(0.0))


def _tall(df: DataFrame, values: dict[str, dict[str, str]]) -> DataFrame:
    """A one-row frame's columns as rows: feature and, for each output, the column named for it."""
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), *(F.col(f"`{c}`").alias(n) for n, c in v.items())) for k, v in values.items()))
    return df.select(F.explode(rows).alias("r")).select("r.*")


def class_distribution(df: DataFrame, label: str = "is_purchased") -> DataFrame:
    total, pos = F.count("*"), F.coalesce(F.sum(label), F.lit(0))
    return df.agg(total.alias("total"), pos.alias("positives"), (total - pos).alias("negatives"), (pos / total).alias("positive_rate"), F.greatest(F.lit(1.0), (total - pos) / pos).alias("neg_pos_ratio"))


def redundancy(df: DataFrame, features: list[str], strong: list[str]) -> DataFrame:
    """Each feature's strongest absolute correlation with one of the strong columns (the first of equal ones)."""
    pairs = {f"{f}|{s}": F.abs(correlation(f, s)) for f in features for s in strong}
    one = df.agg(*(v.alias(k) for k, v in pairs.items()))
    best = lambda f: F.array_max(F.array(*(F.struct(F.round(F.col(f"`{f}|{s}`"), 9).alias("corr"), F.lit(-i).alias("i"), F.lit(s).alias("against")) for i, s in enumerate(strong))))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), best(f).alias("b")) for f in features))).alias("r"))
    return rows.select("r.feature", "r.b.against", F.col("r.b.corr").alias("abs_corr"), (F.col("r.b.corr") > 0.5).cast("int").alias("redundant"))


def target_correlation(df: DataFrame, features: list[str], label: str = "is_purchased") -> DataFrame:
    one = df.agg(*(F.abs(correlation(f, label)).alias(f) for f in features))
    return _tall(one, {f: {"abs_corr": f} for f in features})


def buyer_contrast(df: DataFrame, features: list[str], label: str = "is_purchased") -> DataFrame:
    side = {f"{f}|{v}": F.avg(F.when(F.col(label) == v, F.col(f))) for f in features for v in (0, 1)}
    rows = _tall(df.agg(*(v.alias(k) for k, v in side.items())), {f: {"buyer_mean": f"{f}|1", "other_mean": f"{f}|0"} for f in features})
    diff = F.abs(F.col("buyer_mean") - F.col("other_mean")) / F.greatest(F.abs("other_mean"), F.lit(1e-10)) * 100
    return rows.withColumn("diff_pct", diff).withColumn("size", F.when(F.col("diff_pct") > 30, "big").when(F.col("diff_pct") > 10, "moderate").otherwise("tiny"))


def variance(df: DataFrame, features: list[str]) -> DataFrame:
    one = df.agg(*(F.var_samp(f).alias(f"{f}|v") for f in features), *(F.countDistinct(f).alias(f"{f}|n") for f in features))
    return _tall(one, {f: {"variance": f"{f}|v", "n_distinct": f"{f}|n"} for f in features})
