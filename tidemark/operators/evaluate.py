"""Classification and ranking metrics of (label 0/1, score) rows, exact with tied scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ranges

#: Sizes of targeted groups.
TOP_K = (1000, 2000, 3000, 5000, 10000)


def confusion(df: DataFrame, threshold: Column | float, label: str = "label", score: str = "score") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(*(F.count_if(c).alias(n) for n, c in (("tn", ~hit & ~real), ("fp", hit & ~real), ("fn", ~hit & real), ("tp", hit & real))))


def _share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def classification(cm: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1_score, f2_score of confusion rows; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f = lambda b2: _share((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)
    return cm.withColumns({"accuracy": _share(tp + tn, tp + tn + fp + fn), "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1_score": f(1), "f2_score": f(4)})


def curve(df: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score: pos, neg, and tp, fp among scores at least as high, p and n in all.

    Scores are pre-aggregated; running sums are made in ranges of them, so no task holds all of them however they crowd.
    """
    order = [F.desc(score)]
    counts = df.groupBy(*by, score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    rows = ranges.in_ranges(counts, [*map(F.col, by), *order], "curve")
    totals = rows.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = ranges.running(rows, order, {"tp": F.col("pos"), "fp": F.col("neg")}, by=by)
    return points.join(totals, list(by)) if by else points.join(F.broadcast(totals))  # one row


def best_threshold(points: DataFrame, beta: float = 1.0, score: str = "score") -> DataFrame:
    """One row: the threshold with the best F score, the lowest of equal ones."""
    b2 = beta * beta
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    f = F.round((1 + b2) * precision * recall / F.greatest(b2 * precision + recall, F.lit(1e-10)), 12)
    return points.withColumn("__f", f).agg(F.max_by(score, F.struct(F.col("__f"), -F.col(score))).alias("threshold"), F.max("__f").alias("best_f"))


def average_precision(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("pr_auc"))


def roc_auc(points: DataFrame) -> DataFrame:
    won = F.sum(F.col("pos") * (F.col("n") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg"))
    return points.agg((won / (F.max("p") * F.max("n"))).alias("roc_auc"))


def ranked_hits(df: DataFrame, sizes: tuple[int, ...], label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """by, top_k, tp_hits: positives among the k highest scores, ties by message_id.

    Only the k highest rows of each task travel, and a few tasks' at a time.
    """
    top = ranges.first_rows(df, max(sizes), [F.desc(score), F.col("message_id")], by, "__n")
    ks = F.explode(F.array(*map(F.lit, sizes))).alias("top_k")
    return top.select(*by, label, "__n", ks).where("__n <= top_k").groupBy(*by, "top_k").agg(F.sum(label).alias("tp_hits"))


def targeting(df: DataFrame, sizes: tuple[int, ...], label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Population share, precision, cumulative recall and lift of the k highest scores."""
    totals = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("p")) if by else df.agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    hits = ranked_hits(df, sizes, label, score, by)
    joined = hits.join(totals, list(by)) if by else hits.join(F.broadcast(totals))  # one row
    precision = F.col("tp_hits") / F.col("top_k")
    return joined.select(*by, "top_k", (F.col("top_k") / F.col("n")).alias("population_share"), "tp_hits", precision.alias("precision_at_k"), (F.col("tp_hits") / F.col("p")).alias("cumulative_recall"), (precision / (F.col("p") / F.col("n"))).alias("lift_vs_random"))


def topk_bounds(spark: SparkSession, df: DataFrame, sizes: tuple[int, ...], share: float = 0.15, label: str = "label") -> DataFrame:
    """What a holdout of this share allows at best: most hits, fewest misses, highest recall and precision for each k."""
    totals = df.agg(F.floor(F.count("*") * share).alias("n"), F.floor(F.sum(label) * share).alias("p"))
    ks = spark.createDataFrame([(k,) for k in sizes], "top_k int")
    hits = F.least("top_k", "p")
    return ks.join(F.broadcast(totals)).select("top_k", hits.alias("max_tp"), (F.col("top_k") - hits).alias("min_fp"), (hits / F.col("p")).alias("max_recall"), (hits / F.col("top_k")).alias("ideal_precision"))
