"""Where a pattern matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose places are added up together. A plain running sum copies its array at each step.
TOGETHER = 256


def with_spans(df: DataFrame, name: str, text: str, pattern: str, maybe: Column | None = None, group: int = 0) -> DataFrame:
    """df plus an array column: struct<start, end, value> of each leftmost non-overlapping match of pattern in text.

    Offsets are code points, end exclusive; value is the match's group. Splitting at the pattern gives what stands between
    matches, so lengths of both add up to places. maybe: a cheap condition without which nothing matches. Null text: empty.
    """
    parts, found, pairs = f"__{name}_parts", f"__{name}_found", f"__{name}_pairs"
    held = F.coalesce(F.col(text), F.lit(""))
    on = (lambda c, empty: F.when(maybe, c).otherwise(empty)) if maybe is not None else (lambda c, empty: c)
    none = F.array().cast("array<string>")
    df = df.withColumn(found, on(F.regexp_extract_all(held, F.lit(pattern), F.lit(0)), none))
    df = df.withColumn(parts, F.when(F.size(found) > 0, F.split(held, pattern, -1)).otherwise(none))
    values = F.col(found) if not group else F.when(F.size(found) > 0, F.regexp_extract_all(held, F.lit(pattern), F.lit(group))).otherwise(none)
    df = df.withColumn(pairs, F.zip_with(F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("gap"), F.col(found).alias("whole")), values, lambda p, v: F.struct(F.char_length(p["gap"]).cast("long").alias("gap"), F.char_length(p["whole"]).cast("long").alias("len"), v.alias("value"))))
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    block = lambda b: F.aggregate(
        F.slice(pairs, b * TOGETHER + 1, F.lit(TOGETHER)),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end"), x["value"].alias("value")))).alias("out")),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / TOGETHER).cast("int")), block)
    moved = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda x: F.struct((acc["at"] + x["start"]).alias("start"), (acc["at"] + x["end"]).alias("end"), x["value"].alias("value"))))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return df.withColumn(name, F.when(F.size(pairs) > 0, moved).otherwise(F.array().cast(kind))).drop(parts, found, pairs)


def tagged(name: str, kind: str, rank: int, keep=None, entity=None) -> Column:
    """The spans of a column as struct<start, rank, end, kind, value>; keep: a condition on the value; entity: its normal form."""
    spans = F.filter(name, lambda s: keep(s["value"])) if keep else F.col(name)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), (entity(s["value"]) if entity else s["value"]).alias("value")))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: str, spans: Column, shown) -> Column:
    """The text with each of the spans (sorted) as shown(span); where they overlap, only what comes after the earlier one is cut."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), shown(s))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
