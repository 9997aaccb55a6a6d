"""Samples, splits and folds by a hash of the id, so that they don't depend on how rows are laid out.

The hash is a fifth power modulo a prime, plain integer arithmetic, and one-to-one below the prime; larger and negative ids
are taken modulo the prime first, and ties go by the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranges

PRIME = 2147483647


def unit_hash(column: str = "message_id", seed: int = 1) -> Column:
    """A number from 0 to 1 for each id."""
    x = F.pmod(F.pmod(F.col(column).cast("long"), F.lit(PRIME)) * 48271 + seed * 69621 + 11, F.lit(PRIME))
    square = F.pmod(x * x, F.lit(PRIME))
    return F.pmod(F.pmod(square * square, F.lit(PRIME)) * x, F.lit(PRIME)) / F.lit(float(PRIME))


def bernoulli_negatives(df: DataFrame, rate: Column | float, label: str = "is_purchased", seed: int = 1) -> DataFrame:
    """All positives, and negatives at this rate."""
    return df.where((F.col(label) == 1) | (unit_hash(seed=seed) < rate))


def rate_for(df: DataFrame, target: int, label: str = "is_purchased", oversample: float = 1.02) -> DataFrame:
    """One row, rate: what share of negatives gives `target` of them and a little more."""
    return df.agg(F.least(F.lit(1.0), F.lit(target * oversample) / F.greatest(F.lit(1), F.count_if(F.col(label) == 0))).alias("rate"))


def exact_sample(df: DataFrame, positives: int, negatives: int, label: str = "is_purchased", seed: int = 1) -> DataFrame:
    """Exactly so many of each class, those with the smallest hashes; an error where a class is short, found by counting first."""
    check_sizes(df, positives, negatives, label)
    want = F.when(F.col(label) == 1, positives).otherwise(negatives)
    return _class_rank(df, label, seed).where(F.col("__rank") < want).drop("__rank", "__size")


def check_sizes(df: DataFrame, positives: int, negatives: int, label: str = "is_purchased") -> None:
    n, pos = df.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).collect()[0]
    if pos < positives or n - pos < negatives:
        raise ValueError(f"{pos} positives and {n - pos} negatives; {positives} and {negatives} are asked for")


def capped_negatives(df: DataFrame, most: int, label: str = "is_purchased", seed: int = 1) -> DataFrame:
    """All positives, and the `most` negatives with the smallest hashes."""
    return _class_rank(df, label, seed).where((F.col(label) == 1) | (F.col("__rank") < most)).drop("__rank", "__size")


def capped_filter(df: DataFrame, most: int, label: str = "is_purchased", seed: int = 1) -> Column:
    """capped_negatives() as a condition, from where df's negatives are cut: wide rows needn't be moved to be ranked."""
    ranked = _class_rank(df.select("message_id", label), label, seed).where((F.col("__rank") == most) & ~F.col(label).eqNullSafe(F.lit(1)))
    kept, h = F.lit(True), unit_hash(seed=seed)
    for r in ranked.select(label, "message_id", unit_hash(seed=seed).alias("h")).collect():  # a row for each class
        before = (h < r["h"]) | ((h == r["h"]) & (F.col("message_id") < F.lit(r["message_id"])))
        kept &= ~F.col(label).eqNullSafe(F.lit(r[label])) | before
    return kept


def subsample(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    return ranges.first_rows(df, n, [unit_hash(seed=seed), F.col("message_id")], rank="__rank").drop("__rank")


def replicated(df: DataFrame, weight: Column | float, label: str = "is_purchased", seed: int = 2) -> DataFrame:
    """Positives `weight` times over, for classifiers that take no weights; the fraction is a share of rows, by their hash."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    times = F.floor(weight).cast("int") + (unit_hash(seed=seed) < weight - F.floor(weight)).cast("int")
    copies = F.when(F.col(label) == 1, times).otherwise(1)
    return df.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")


def _class_rank(df: DataFrame, label: str, seed: int) -> DataFrame:
    """__rank: place in the class by hash, from 0; __size: of the class. Counted in ranges, so no task holds a whole class."""
    order = [F.col("__h"), F.col("message_id")]
    rows = ranges.in_ranges(df.withColumn("__h", unit_hash(seed=seed)), [F.col(label), *order], "class-ranks")
    ranked = ranges.running(rows, order, {"__rank": F.lit(1)}, by=(label,), inclusive=False)
    sizes = rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__size"))  # a row for each class
    return ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__label"))).drop("__label", "__h")


def stratified_split(df: DataFrame, test: float = 0.15, validation: float = 0.17647, label: str = "is_purchased", seed: int = 1) -> DataFrame:
    """split: test, validation (a share of the rest) or train, per class."""
    return _class_rank(df, label, seed).withColumn("split", _split(test, validation)).drop("__rank", "__size")


def _split(test: float, validation: float) -> Column:
    held = F.floor(F.col("__size") * test + 0.5)
    tuned = F.floor((F.col("__size") - held) * validation + 0.5)
    return F.when(F.col("__rank") < held, "test").when(F.col("__rank") < held + tuned, "validation").otherwise("train")


def split_and_folds(df: DataFrame, test: float = 0.15, validation: float = 0.17647, k: int = 3, label: str = "is_purchased", seed: int = 1) -> DataFrame:
    """stratified_split() and stratified_folds() from one ranking."""
    return _class_rank(df, label, seed).withColumns({"split": _split(test, validation), "fold": F.pmod("__rank", F.lit(k)).cast("int")}).drop("__rank", "__size")


def split_column(df: DataFrame, test: float = 0.15, validation: float = 0.17647, label: str = "is_purchased", seed: int = 1) -> Column:
    """stratified_split() as a column, from where df's classes are cut: wide rows needn't be moved to be ranked."""
    held = F.floor(F.col("__size") * test + 0.5)
    tuned = held + F.floor((F.col("__size") - held) * validation + 0.5)
    ranked = _class_rank(df.select("message_id", label), label, seed).select(label, "message_id", unit_hash(seed=seed).alias("h"), F.col("__rank").alias("rank"), F.col("__size").alias("size"), held.alias("held"), tuned.alias("tuned"))
    cuts = ranked.where((F.col("rank") == 0) | (F.col("rank") == F.col("held")) | (F.col("rank") == F.col("tuned"))).orderBy("rank").collect()  # three rows for each class
    split = F.lit("train")
    for first in (r for r in cuts if r["rank"] == 0):
        own = F.lit("train" if first["tuned"] < first["size"] else "validation" if first["held"] < first["size"] else "test")
        for end, name in (("tuned", "validation"), ("held", "test")):
            for r in (r for r in cuts if r[label] == first[label] and r["rank"] == first[end]):
                h, lit = unit_hash(seed=seed), F.lit(r["message_id"])
                own = F.when((h < r["h"]) | ((h == r["h"]) & (F.col("message_id") < lit)), name).otherwise(own)
        split = F.when(F.col(label).eqNullSafe(F.lit(first[label])), own).otherwise(split)
    return split


def stratified_folds(df: DataFrame, k: int = 3, label: str = "is_purchased", seed: int = 1) -> DataFrame:
    return _class_rank(df, label, seed).withColumn("fold", F.pmod("__rank", F.lit(k)).cast("int")).drop("__rank", "__size")
