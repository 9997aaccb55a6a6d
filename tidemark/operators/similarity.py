"""Similarity of a message's campaign attributes with a client's past; the attributes are K one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators.history import earlier, kernel, last_before

ATTRIBUTES = [f"{p}{v.replace('.', '_')}" for p, values in (("camp_campaign_type", clean.CAMPAIGN_TYPES), ("camp_channel", clean.CAMPAIGN_CHANNELS), ("camp_topic", clean.TOPICS)) for v in values]


def bits(columns: list[str]) -> Column:
    """The columns as bits of a long; null is 0."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out + F.coalesce(F.col(c), F.lit(0)).cast("long") * (1 << i)
    return out


def _like(df: DataFrame) -> DataFrame:
    either = F.bit_count(F.col("__vec").bitwiseOR(F.col("__won")))
    return df.withColumn("feat_like_last_success", F.when(either > 0, F.bit_count(F.col("__vec").bitwiseAND(F.col("__won"))) / either).otherwise(0.0)).drop("__vec", "__won")


#: feat_like_last_success: Jaccard similarity with the last purchased message's attributes; 0 without any.
like_last_success = kernel(lambda: {"__won": last_before(F.when(F.col("is_purchased") == 1, F.col("__vec")))}, before=lambda: {"__vec": bits(ATTRIBUTES)}, after=_like)


def _own() -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit(0)) for c in ATTRIBUTES}


def _aligned(df: DataFrame) -> DataFrame:
    own, zero = _own(), F.lit(0)
    dot = sum((F.col(f"__s{i}") * own[c] for i, c in enumerate(ATTRIBUTES)), zero)
    past = sum((F.col(f"__s{i}") * F.col(f"__s{i}") for i in range(len(ATTRIBUTES))), zero)
    now = sum((own[c] * own[c] for c in ATTRIBUTES), zero)
    df = df.withColumn("__ca", F.when((past > 0) & (now > 0), dot / (F.sqrt(past.cast("double")) * F.sqrt(now.cast("double")))).otherwise(0.0))
    df = df.withColumn("feat_path_align", F.coalesce(F.col("__ca") - F.avg("__ca").over(earlier()), F.lit(0.0)))
    return df.drop("__ca", *(f"__s{i}" for i in range(len(ATTRIBUTES))))


#: feat_path_align: cosine with the sum of earlier attributes, less the mean of earlier such cosines; first message 0.
path_alignment = kernel(lambda: {f"__s{i}": F.coalesce(F.sum(c).over(earlier()), F.lit(0)) for i, c in enumerate(_own().values())}, after=_aligned)
