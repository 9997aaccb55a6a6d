"""Work on one global order, dealt out: running sums, ranks and the k first rows, whatever the number and the crowding of keys.

Rows are put into ranges of the order by Spark's range partitioning, which samples the keys, so ranges follow the load: a day,
a score or a class of any size is split over many tasks, and their number follows the session's shuffle partitions. A range
only needs to know what stands before it: one total a range, summed up over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch, written

#: Partial results that one task takes when the k first rows are merged.
FAN_IN = 16


def in_ranges(df: DataFrame, order: list[Column], label: str = "ranges") -> DataFrame:
    """df, written, plus __r: the number of each row's range; ranges ascend in this order."""
    rows = df.repartitionByRange(*order).withColumn("__r", F.spark_partition_id())
    return written(rows, f"{scratch(df.sparkSession, label)}/rows")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """rows, from in_ranges() over by and this order, plus running sums inside each by; without __r.

    With inclusive, a row's own value counts; else only those before it.
    """
    first, last = Window.unboundedPreceding, Window.currentRow if inclusive else -1
    totals = rows.groupBy(*by, "__r").agg(*(F.sum(v).alias(f"__t_{k}") for k, v in sums.items()))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__r").rowsBetween(first, -1)  # a row for each range
    totals = totals.select(*by, "__r", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums))
    inside = Window.partitionBy(*by, "__r").orderBy(*order).rowsBetween(first, last)
    own = rows.withColumns({f"__i_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    keys = [*by, "__r"]
    joined = own.join(totals, keys) if not by else own.join(totals.withColumnsRenamed({c: f"__k_{c}" for c in by}), [*(F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by), own["__r"] == totals["__r"]]).drop(totals["__r"], *(f"__k_{c}" for c in by))
    return joined.withColumns({k: F.col(f"__b_{k}") + F.col(f"__i_{k}") for k in sums}).drop("__r", *(f"__{x}_{k}" for k in sums for x in "bi"))


def first_rows(df: DataFrame, k: int, order: list[Column], by: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """The k first rows of each by, with their rank from 1.

    Each task keeps its own k first rows. What is left of FAN_IN tasks meets in one, and again, until one is left: no task
    gets more than FAN_IN times k rows of a group, however many tasks there are.
    """
    parts = df.rdd.getNumPartitions()
    rows = df.withColumn("__part", F.spark_partition_id())
    while True:
        parts = -(-parts // FAN_IN)
        merged = Window.partitionBy(*by, *(["__part"] if parts > 1 or not by else [])).orderBy(*order)
        rows = rows.withColumn("__part", F.floor(F.col("__part") / FAN_IN).cast("int") if parts > 1 else F.lit(0)).withColumn(rank, F.row_number().over(merged)).where(F.col(rank) <= k)
        if parts == 1:
            return rows.drop("__part")
