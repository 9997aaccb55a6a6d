"""Studies: half-life sweep, targeting by multiplier, comparison and ablation tables, regression check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluate, history
from tidemark.plans.ledger import Ledger

#: Multipliers of the sweep; multichannel and unknown channels keep their constants.
MULTIPLIERS = (0.5, 0.75, 1.0, 1.25, 1.5)
SWEPT = ("sms", "email", "mobile_push")
METRICS = ("precision", "recall", "f1_score", "accuracy", "roc_auc", "f2_score", "pr_auc")
REPORT = "num_features int, optimal_threshold double, accuracy double, precision double, recall double, f1_score double, f2_score double, roc_auc double, pr_auc double, top1000_hits int, top2000_hits int, top3000_hits int, confusion_matrix struct<tn:long,fp:long,fn:long,tp:long>"


def tau_of(multiplier: float) -> dict[str, float]:
    return {c: v * multiplier if c in SWEPT else v for c, v in history.TAU.items()}


def tau_sweep(log: DataFrame) -> DataFrame:
    """The log's fatigue under every multiplier, in one pass: message_id, is_purchased, tau_multiplier, feat_fatigue."""
    df = history.channel_times(log)
    for m in MULTIPLIERS:
        df = history.fatigue(df, tau_of(m), f"__f{m}")
    rows = F.explode(F.array(*(F.struct(F.lit(f"{m:.2f}x").alias("tau_multiplier"), F.col(f"`__f{m}`").alias("feat_fatigue")) for m in MULTIPLIERS))).alias("r")
    return df.select("message_id", "client_id", "is_purchased", rows).select("message_id", "client_id", "is_purchased", "r.*")


def tau_targeting(log: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Targeting by low fatigue, for each multiplier."""
    scored = tau_sweep(log).withColumns({"label": F.col("is_purchased"), "score": F.round(-F.col("feat_fatigue"), 9)})
    return evaluate.targeting(scored, sizes, by=("tau_multiplier",))


def resumable_targeting(log: DataFrame, sizes: tuple[int, ...], ledger: Ledger, multipliers: tuple[float, ...] = MULTIPLIERS) -> DataFrame:
    """tau_targeting(), a finished table for each multiplier: those that the ledger has aren't made again."""

    def one(m: float) -> DataFrame:
        rows = history.fatigue(history.channel_times(log), tau_of(m))
        scored = rows.select("message_id", F.lit(f"{m:.2f}x").alias("tau_multiplier"), F.col("is_purchased").alias("label"), F.round(-F.col("feat_fatigue"), 9).alias("score"))
        return evaluate.targeting(scored, sizes, by=("tau_multiplier",))

    parts = [ledger.table(f"targeting-{m:.2f}x", {"sizes": sizes, "tau": tau_of(m)}, lambda m=m: one(m)) for m in multipliers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def change(base: Column, value: Column, form: str = "%+.1f%%") -> Column:
    """The relative change as text; empty where the base is null or 0."""
    return F.when(base.isNull() | value.isNull() | (base == 0), "").otherwise(F.format_string(form, (value - base) / base * 100))


def report_rows(reports: DataFrame) -> DataFrame:
    """Nested reports (experiment, r) as flat rows."""
    return reports.select("experiment", "r.*").select("*", "confusion_matrix.*").drop("confusion_matrix")


def model_comparison(reports: DataFrame) -> DataFrame:
    """Of (model, experiment, metrics) rows: base and all side by side for each metric, with the relative change."""
    tall = reports.where(F.col("experiment").isin("base", "all")).select("model", "experiment", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("x"))
    wide = tall.groupBy("model", F.col("x.metric").alias("metric")).agg(F.max(F.when(F.col("experiment") == "base", F.col("x.value"))).alias("base"), F.max(F.when(F.col("experiment") == "all", F.col("x.value"))).alias("total"))
    return wide.withColumn("change", change(F.col("base"), F.col("total")))


def ablation_delta(reports: DataFrame) -> DataFrame:
    """Of (experiment, metrics) rows: each metric beside the base's, with the relative change."""
    tall = reports.select("experiment", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("x")).select("experiment", "x.*")
    base = tall.where("experiment = 'base'").select("metric", F.col("value").alias("base"))
    return tall.join(base, "metric").select("experiment", "metric", "value", F.when(F.col("experiment") != "base", change(F.col("base"), F.col("value"), "%+.3f%%")).otherwise("").alias("change"))


def fold_mean(scores: DataFrame, *kept: str) -> DataFrame:
    """The ensemble's score: the mean over folds of (message_id, label, score, and the columns that are kept)."""
    return scores.groupBy("message_id", "label", *kept).agg(F.avg("score").alias("score"))


def topk_delta(reports: DataFrame) -> DataFrame:
    """Of flat report rows with top1000_hits to top3000_hits and confusion counts: each as a row beside the base's, with the relative change."""
    names = [c for c in reports.columns if c.startswith("top") and c.endswith("_hits")] + ["tn", "fp", "fn", "tp"]
    tall = reports.select("experiment", F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select("experiment", "x.*")
    base = tall.where("experiment = 'base'").select("item", F.col("value").alias("base"))
    return tall.join(base, "item").select("experiment", "item", "value", F.when(F.col("experiment") != "base", change(F.col("base"), F.col("value"), "%+.3f%%")).otherwise("").alias("change"))


def regression_check(found: dict[str, float], expected: dict[str, float], tolerance: float = 1e-12) -> list[str]:
    """Names of metrics that differ from what is expected."""
    return [k for k, v in expected.items() if k not in found or abs(found[k] - v) > (tolerance if isinstance(v, float) else 0)]


def run_all(jobs: dict[str, Callable[[], object]]) -> list[tuple[str, str, float]]:
    """(name, status, seconds) of each job; a failing one doesn't stop the others."""
    import time

    out = []
    for name, job in jobs.items():
        began = time.time()
        try:
            job()
            status = "ok"
        except Exception as e:  # each job's failure is its row
            status = f"failed: {type(e).__name__}: {e}"
        out.append((name, status, time.time() - began))
    return out
