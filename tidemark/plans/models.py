"""Classifiers over the feature table, with Spark ML: boosted trees, forest, perceptron; k-fold ensembles and search.

Boosted trees stop early on average precision: of the trees that were fitted, those up to the best count on validation rows
are kept. The perceptron takes no weights, so its positives are replicated.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate, history, sampling
from tidemark.plans import features, studies, tune
from tidemark.plans.ledger import Ledger
from tidemark.sources.scratch import scratch, written

SEED = 1


def classifier(kind: str, inputs: list[str], **params):
    """A pipeline on columns of numbers; nulls are 0. Trees take the column `weight`. featureShare: of inputs that a split sees."""
    parts = [VectorAssembler(inputCols=inputs, outputCol="x")]
    if "featureShare" in params:
        params["featureSubsetStrategy"] = str(max(1, math.ceil(params.pop("featureShare") * len(inputs))))
    if kind == "gbt":
        parts.append(GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", seed=SEED, **{"maxIter": 20, "maxDepth": 4} | params))
    elif kind == "rf":
        parts.append(RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", seed=SEED, **{"numTrees": 40, "maxDepth": 8} | params))
    elif kind == "mlp":
        hidden, layers = params.pop("hidden", (32, 16)), params.pop("layers_", 2)
        hidden = hidden if isinstance(hidden, tuple) else (hidden,) * layers
        parts += [StandardScaler(inputCol="x", outputCol="z", withMean=True), MultilayerPerceptronClassifier(featuresCol="z", labelCol="label", seed=SEED, layers=[len(inputs), *hidden, 2], **{"maxIter": 60} | params)]
    else:
        raise ValueError(f"no classifier {kind}")
    return Pipeline(stages=parts)


def prepared(table: DataFrame, inputs: list[str]) -> DataFrame:
    """message_id, label, inputs as doubles with nulls as 0, split, fold."""
    rows = table.select("message_id", "is_purchased", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in inputs))
    return sampling.split_and_folds(rows).withColumnRenamed("is_purchased", "label")


def ratio(df: DataFrame) -> float:
    """Negatives for each positive, at least 1."""
    n, pos = df.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return max(1.0, (n - pos) / max(1, pos))


def weighted(df: DataFrame, pos_weight: float | None = None) -> DataFrame:
    """weight: of positives pos_weight, or the ratio of negatives to positives."""
    return df.withColumn("weight", F.when(F.col("label") == 1, float(pos_weight if pos_weight is not None else ratio(df))).otherwise(1.0))


def scored(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("message_id", "label", "split", F.round(vector_to_array("probability")[1], 9).alias("score"))


def leaf_values(model: GBTClassificationModel) -> list[np.ndarray]:
    """Each tree's predictions at its leaves, in the order of leaf indices, times the tree's weight."""
    return [w * np.array([float(x) for x in re.findall(r"Predict: (\S+)", t.toDebugString)]) for t, w in zip(model.trees, model.treeWeights, strict=True)]


def staged_precision(model: PipelineModel, rows: DataFrame) -> list[float]:
    """Average precision on rows after each number of trees, from one pass of leaf indices."""
    trees = model.stages[-1]
    known = rows.sparkSession.sparkContext.broadcast(leaf_values(trees))  # leaves of one model
    leaves = PipelineModel([*model.stages[:-1], trees.copy().setLeafCol("leaf")]).transform(rows).select("label", vector_to_array("leaf").alias("leaf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = known.value
        for batch in batches:
            at = batch.column("leaf").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, len(values))
            margins = np.cumsum(np.stack([v[at[:, i]] for i, v in enumerate(values)], axis=1), axis=1)
            labels = batch.column("label").to_numpy()
            for i in range(len(values)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(labels), i + 1, np.int32)), pa.array(labels), pa.array(np.round(margins[:, i], 9) + 0.0)], ["trees", "label", "score"])

    each = leaves.mapInArrow(run, "trees int, label int, score double")
    points = evaluate.curve(each, by=("trees",)).withColumn("part", F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    found = {r["trees"]: r["ap"] for r in points.groupBy("trees").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("ap")).collect()}  # a row for each tree
    return [found.get(i + 1, 0.0) for i in range(len(trees.trees))]


def stopping_point(precisions: list[float], patience: int) -> int:
    """The best number of trees: the search ends where `patience` more haven't improved it."""
    best = 0
    for i, value in enumerate(precisions):
        if round(value, 12) > round(precisions[best], 12):
            best = i
        elif i - best >= patience:
            break
    return best + 1


def cut(model: PipelineModel, n: int) -> PipelineModel:
    """The model of boosted trees with its first n only."""
    trees, known = model.stages[-1], model.stages[-1]._java_obj.trees()
    jvm, gateway = SparkSession.active()._jvm, SparkSession.active().sparkContext._gateway
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        kept[i], weights[i] = known[i], float(trees.treeWeights[i])
    made = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(trees.uid, kept, weights))
    for name in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        made.set(made.getParam(name), trees.getOrDefault(name))
    made._transfer_params_to_java()
    return PipelineModel([*model.stages[:-1], made])


def fitted(train: DataFrame, validation: DataFrame, kind: str, inputs: list[str], patience: int | None = None, pos_weight: float | None = None, **params) -> PipelineModel:
    """A model of train (a written table). Positives weigh pos_weight, or the ratio of the classes; perceptrons have them replicated.

    With patience, boosted trees stop early on the average precision of validation.
    """
    pos_weight = pos_weight if pos_weight is not None else ratio(train)
    if kind == "mlp":
        return classifier(kind, inputs, **params).fit(sampling.replicated(train, pos_weight, label="label"))
    model = classifier(kind, inputs, **params).fit(weighted(train, pos_weight))
    if kind == "gbt" and patience:
        return cut(model, stopping_point(staged_precision(model, validation), patience))
    return model


def fold_tables(rows: DataFrame, folds: int = 3, most_negatives: int = 200_000, write_held: bool = True) -> list[tuple[DataFrame, DataFrame]]:
    """(training rows without the fold, the fold's rows), written, as every pass of every fit reads them.

    Of each fold's training rows at most most_negatives negatives are kept, those with the smallest hashes. Where the fold's rows
    are hardly read, write_held can leave them in the table.
    """
    folder, train = scratch(rows.sparkSession, "folds"), rows.where("split = 'train'")
    own, out = F.pmod("fold", F.lit(folds)), []
    for i in range(folds):
        rest, held = train.where(own != i), train.where(own == i)
        rest = written(rest.where(sampling.capped_filter(rest, most_negatives, label="label")), f"{folder}/train-{i}")
        out.append((rest, written(held, f"{folder}/held-{i}") if write_held else held))
    return out


def trees_of(model: PipelineModel) -> int:
    """How many trees a model has; 0 for one without."""
    return len(getattr(model.stages[-1], "trees", ()))


def ensemble(rows: DataFrame, kind: str, inputs: list[str], folds: int = 3, most_negatives: int = 200_000, patience: int | None = None, ledger: Ledger | None = None, tables: Callable[[], list[tuple[DataFrame, DataFrame]]] | None = None, **params) -> DataFrame:
    """Scores of validation and test rows: the mean over models, each fitted without one fold of the training rows; trees: of all models.

    rows are a written table. With patience, boosted trees stop early on the fold that is left out. With a ledger, fold models
    that it has are loaded rather than fitted, and new ones are saved there. tables: the fold_tables() of rows, if others need them too.
    """
    folder, out = scratch(rows.sparkSession, "ensemble"), None
    tables = tables or cache(lambda: fold_tables(rows, folds, most_negatives, write_held=patience is not None))
    for fold in range(folds):

        def fit(fold: int = fold) -> PipelineModel:
            return fitted(*tables()[fold], kind, inputs, patience, **params)

        setting = {"kind": kind, "inputs": inputs, "fold": fold, "folds": folds, "most_negatives": most_negatives, "patience": patience, **params}
        model = ledger.model(f"fold-{fold}", setting, fit) if ledger else fit()
        found = scored(model, rows.where("split <> 'train'")).withColumn("trees", F.lit(trees_of(model)))
        out = found if out is None else out.unionByName(found)
    return written(out.groupBy("message_id", "label", "split").agg(F.avg("score").alias("score"), F.sum("trees").alias("trees")), f"{folder}/scores")


def report(scores: DataFrame, n_inputs: int, sizes: tuple[int, ...] = (1000, 2000, 3000)) -> DataFrame:
    """One row of metrics on test rows, at the threshold that is best on validation rows."""
    best = evaluate.best_threshold(evaluate.curve(scores.where("split = 'validation'"))).select(F.coalesce("threshold", F.lit(0.5)).alias("optimal_threshold"))
    test = scores.where("split = 'test'")
    marked = test.join(F.broadcast(best)).withColumn("over", F.col("score") - F.col("optimal_threshold"))  # one row
    cm, ranks = evaluate.classification(evaluate.confusion(marked, 0.0, score="over")), evaluate.curve(test)
    hits = evaluate.ranked_hits(test, sizes).agg(*(F.coalesce(F.max(F.when(F.col("top_k") == k, F.col("tp_hits"))), F.lit(0)).alias(f"top{k}_hits") for k in sizes))
    out = best
    for one in (cm, evaluate.roc_auc(ranks), evaluate.average_precision(ranks), hits):
        out = out.join(F.broadcast(one))  # one row each
    return out.select(F.lit(n_inputs).alias("num_features"), "optimal_threshold", "accuracy", "precision", "recall", "f1_score", "f2_score", "roc_auc", "pr_auc", *(f"top{k}_hits" for k in sizes), F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix"))


def fold_precision(tables: list[tuple[DataFrame, DataFrame]], kind: str, inputs: list[str], patience: int | None = None, **params) -> float:
    """The mean average precision over folds of models with these parameters."""
    total = 0.0
    for train, held in tables:
        model = fitted(train, held, kind, inputs, patience, **params)
        total += evaluate.average_precision(evaluate.curve(scored(model, held))).first()[0]
    return total / len(tables)


def search(rows: DataFrame, kind: str, inputs: list[str], grid: dict[str, list], fixed: dict | None = None, folds: int = 3, patience: int | None = None) -> list[tuple[dict, float]]:
    """The grid's settings with their mean average precision over folds, best first; fixed: parameters known beforehand."""
    tables = fold_tables(rows, folds)
    settings = [(fixed or {}) | dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return sorted(((p, fold_precision(tables, kind, inputs, patience, **p)) for p in settings), key=lambda x: -x[1])


def published_space(kind: str, class_ratio: float) -> tune.Space:
    """The published ranges, under the names that the classifiers here have for them."""
    if kind == "gbt":
        return {"pos_weight": tune.Real(max(1.0, 0.05 * class_ratio), max(1.0, min(2000.0, 2 * class_ratio)), log=True), "maxIter": tune.Whole(100, 600, 50), "stepSize": tune.Real(0.01, 0.3, log=True), "maxDepth": tune.Whole(3, 10), "minInstancesPerNode": tune.Whole(1, 10), "subsamplingRate": tune.Real(0.6, 0.9), "featureShare": tune.Real(0.85, 1.0)}
    if kind == "rf":
        return {"pos_weight": tune.Real(1.0, max(1.0, min(100.0, class_ratio)), log=True), "numTrees": tune.Whole(100, 200, 50), "maxDepth": tune.Whole(8, 16)}
    if kind == "mlp":
        return {"pos_weight": tune.Real(1.0, max(1.0, min(100.0, class_ratio)), log=True), "hidden": tune.Whole(64, 128, 32)}
    raise ValueError(f"no space for {kind}")


#: Parameters that a missing-parameter study searches, beside known ones.
MISSING_SPACE = {"rf": {"minInstancesPerNode": tune.Whole(1, 5), "minInfoGain": tune.Real(1e-6, 1e-2, log=True)}, "gbt": {"minInfoGain": tune.Real(1e-6, 1e-2, log=True)}, "mlp": {"layers_": tune.Whole(1, 3)}}


def tuned(rows: DataFrame, kind: str, inputs: list[str], folder: str, space: tune.Space | None = None, fixed: dict | None = None, folds: int = 3, trials: int = 15, at_once: int = 3, patience: int | None = 30, most_negatives: int = 200_000, seed: int = SEED) -> DataFrame:
    """The table of trials of a Parzen search for the best mean average precision over folds; fixed: parameters known beforehand."""
    tables = fold_tables(rows, folds, most_negatives)
    space = space or published_space(kind, ratio(rows.where("split = 'train'")))
    return tune.study(rows.sparkSession, space, lambda p: fold_precision(tables, kind, inputs, patience, **(fixed or {}) | p), folder, trials, at_once, seed)


def missing_parameters(rows: DataFrame, kind: str, inputs: list[str], known: dict, folder: str, most_rows: int = 300_000, **how) -> DataFrame:
    """A study of the parameters that a finished study left out, with the others as known, on at most most_rows rows by hash."""
    few = written(sampling.subsample(rows.where("split = 'train'"), most_rows), f"{folder}/rows")
    return tuned(few, kind, inputs, f"{folder}/trials", MISSING_SPACE[kind], known, **how)


def ablation(table: DataFrame, kind: str, experiments: list[str] | None = None, sizes: tuple[int, ...] = (1000, 2000, 3000), **params) -> DataFrame:
    """experiment and its report r, for each experiment's inputs; all fit on the same fold tables."""
    rows, out = training_rows(table, features.INPUTS), None
    tables = _shared(rows, params)
    for name in experiments or list(features.EXPERIMENTS):
        inputs = features.inputs_of(name)
        one = report(ensemble(rows, kind, inputs, tables=tables, **params), len(inputs), sizes)
        one = one.select(F.lit(name).alias("experiment"), F.struct(*one.columns).alias("r"))
        out = one if out is None else out.unionByName(one)
    return out


def _shared(rows: DataFrame, params: dict) -> Callable[[], list[tuple[DataFrame, DataFrame]]]:
    """The fold tables of ensembles with these parameters, made when first asked for."""
    how = {k: params[k] for k in ("folds", "most_negatives") if k in params}
    return cache(lambda: fold_tables(rows, **how, write_held=params.get("patience") is not None))


def tau_targeting(log: DataFrame, kind: str, sizes: tuple[int, ...], multipliers: tuple[float, ...] = studies.MULTIPLIERS, ledger: Ledger | None = None, **params) -> DataFrame:
    """Targeting on test rows by a model for each multiplier; splits are the same for all.

    Multipliers change nothing but fatigue, so the training rows and fold tables are made once and have every multiplier's.
    With a ledger, multipliers that it has scores of aren't fitted again.
    """
    names, out = {m: f"fatigue_{i}" for i, m in enumerate(multipliers)}, None

    @cache
    def shared() -> tuple[DataFrame, Callable]:
        state = features.stated(log)
        for m, name in names.items():
            state = history.fatigue(state, studies.tau_of(m), name)
        rows = training_rows(features.completed(state, kept=tuple(names.values())), [*features.INPUTS, *names.values()])
        return rows, _shared(rows, params)

    def scores(m: float) -> DataFrame:
        rows, tables = shared()
        own = lambda df: df.withColumn("feat_fatigue", F.col(names[m]))
        return ensemble(own(rows), kind, features.INPUTS, ledger=ledger.below(f"{m:.2f}x") if ledger else None, tables=lambda: [(own(a), own(b)) for a, b in tables()], **params)

    for m in multipliers:
        found = ledger.table(f"scores-{m:.2f}x", {"kind": kind, "inputs": features.INPUTS, **params}, lambda m=m: scores(m)) if ledger else scores(m)
        test = found.where("split = 'test'").withColumn("tau_multiplier", F.lit(f"{m:.2f}x"))
        out = test if out is None else out.unionByName(test)
    return evaluate.targeting(out, sizes, by=("tau_multiplier",))


def training_rows(table: DataFrame, inputs: list[str]) -> DataFrame:
    """prepared(), written."""
    return written(prepared(table, inputs), f"{scratch(table.sparkSession, 'training')}/rows")
