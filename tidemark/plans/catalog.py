"""Every query of the engine by name, and its SQL: one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.functions.calendar import calendar
from tidemark.networks import train
from tidemark.operators import diagnostics, evaluate, history, impute, rolling, sampling, similarity
from tidemark.plans import features, models, oracle, studies, tune
from tidemark.plans.ledger import Ledger, digest_of
from tidemark.sources import crm
from tidemark.sources.scratch import scratch, written

#: Sizes of samples and groups that suit the driver's tables.
POSITIVES, NEGATIVES, CAP, SMALL = 100, 500, 400, 200
TOP_K = (50, 100, 200, 300, 500)
STRONG = ["total_purchases", "prev_is_clicked", "prev_is_opened", "total_campaigns", "total_messages", "avg_time_since_first_purchase"]
DOMAIN = [c for g in ("v1", "v2", "v3", "v4") for c in features.GROUPS[g]]
BUILDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}



def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    kinds = {"i": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "s": lambda c: F.col(c).cast("string")}
    return df.select(*(kinds[k](c).alias(c) for c, k in columns.items()))


def query(name: str, columns: str, body: str | None = None, sampled: bool = False):
    """Register a plan; columns: kind:name of each (i long, d double, s text); body: the SQL that gives the same; sampled: its log is."""
    kinds = {c: k for k, _, c in (x.partition(":") for x in columns.split())}

    def add(build):
        BUILDS[name] = lambda spark, sf_dir: typed(build(spark, sf_dir), kinds)
        if body:
            SQL[name] = oracle.sql(body, kinds, sampled)
        return build

    return add


def with_kind(kind: str, names) -> str:
    return " ".join(f"{kind}:{c}" for c in names)


def msg(spark, d):
    return crm.messages(spark, d)


def logged(spark, d):
    return features.log(spark, d)


def scored(spark, d):
    return msg(spark, d).select("message_id", F.col("is_purchased").alias("label"), (F.floor(F.col("value") / 5 + 0.5) / 100).alias("score"))


def feature_kinds(names) -> str:
    whole = {*features.FACT, "is_holiday", "total_messages", "total_campaigns", "total_purchases", "cal_week_of_month", "cal_is_weekend", "topic_N7", "has_prior_purchase", "feat_cooldown_ok"}
    return " ".join(f"{'i' if c in whole or c.startswith('prev_') else 'd'}:{c}" for c in names)


FLAGS = ["is_opened", "is_clicked", "is_purchased", "is_unsubscribed", "is_complained", "is_hard_bounced", "is_blocked"]


@query("fatigue_pressure", "s:channel i:messages d:avg_fatigue d:rested_share d:conversion_rate", "SELECT channel, count(*) AS messages, avg(feat_fatigue) AS avg_fatigue, avg(feat_cooldown_ok) AS rested_share, avg(is_purchased) AS conversion_rate FROM hist GROUP BY channel")
def _(s, d):
    df = history.cooldown(history.fatigue(history.channel_times(clean.live(msg(s, d)))))
    return df.groupBy("channel").agg(F.count("*").alias("messages"), F.avg("feat_fatigue").alias("avg_fatigue"), F.avg("feat_cooldown_ok").alias("rested_share"), F.avg("is_purchased").alias("conversion_rate"))


@query("crm_messages", "i:message_id i:client_id i:campaign_id d:t s:channel s:message_type s:email_provider s:platform d:opened_h d:clicked_h d:purchased_h d:unsubscribed_h d:complained_h " + with_kind("i", FLAGS), "SELECT * FROM msg")
def _(s, d):
    return msg(s, d)


@query("flag_normalize", "i:message_id i:f1 i:f2 i:f3", "SELECT message_id, CASE WHEN k % 5 IN (0, 1, 2, 3) THEN 1 ELSE 0 END AS f1, is_opened AS f2, 0 AS f3 FROM msg")
def _(s, d):
    k = F.col("k") % 5
    raw = F.when(k == 0, " T").when(k == 1, "TRUE ").when(k == 2, "1").when(k == 3, "1.0").otherwise("yes")
    return msg(s, d).select("message_id", clean.flag(raw).alias("f1"), clean.flag("is_opened").alias("f2"), clean.flag(F.lit(None).cast("string")).alias("f3"))


@query("dead_log_filter", "i:message_id i:client_id", "SELECT message_id, client_id FROM msg WHERE is_hard_bounced = 0 AND is_blocked = 0")
def _(s, d):
    return clean.live(msg(s, d))


@query("id_coercion", "i:message_id i:a i:b", "SELECT message_id, CASE WHEN k % 3 = 0 THEN k WHEN k % 3 = 1 THEN k ELSE -1 END AS a, -1 AS b FROM msg")
def _(s, d):
    k = F.col("k")
    raw = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise("n/a")
    return msg(s, d).select("message_id", clean.id_or_sentinel(raw).alias("a"), clean.id_or_sentinel(F.lit(None).cast("string")).alias("b"))


@query("epoch_hours", "i:message_id d:t", "SELECT message_id, t FROM msg")
def _(s, d):
    return msg(s, d)


@query("campaign_onehot", f"i:campaign_id {with_kind('i', features.CAMPAIGN)} d:avg_campaign_duration", "SELECT * FROM camp")
def _(s, d):
    return crm.campaigns(crm.raw_campaigns(s, d))


@query("fact_onehot", f"i:message_id {with_kind('i', features.FACT)}", "SELECT * FROM log")
def _(s, d):
    return features.fact_columns(clean.live(msg(s, d)))


@query("dim_enrichment", f"i:message_id i:client_id d:first_purchase_h d:avg_campaign_duration {with_kind('d', features.CAMPAIGN)}", "SELECT * FROM log")
def _(s, d):
    return logged(s, d)


@query("holiday_lookup", "i:message_id i:is_holiday", "SELECT message_id, is_holiday FROM log")
def _(s, d):
    return logged(s, d)


@query("class_distribution", "i:total i:positives i:negatives d:positive_rate d:neg_pos_ratio", "SELECT count(*) AS total, sum(is_purchased) AS positives, sum(1 - is_purchased) AS negatives, avg(is_purchased) AS positive_rate, greatest(1, sum(1 - is_purchased) / sum(is_purchased)) AS neg_pos_ratio FROM msg")
def _(s, d):
    return diagnostics.class_distribution(msg(s, d))


MEDIANS = [*history.RECENCIES, "avg_time_since_first_purchase"]


@query("recency_medians", with_kind("d", [f"m_{c}" for c in MEDIANS] + ["m_days", "m_gap"]), "SELECT * FROM med")
def _(s, d):
    df = history.topics(history.last_purchase(history.recencies(logged(s, d))))
    names = {**{f"__{c}": f"m_{c}" for c in MEDIANS}, "__purchase_days": "m_days", "__topic_gap": "m_gap"}
    return impute.medians(df, list(names)).select(*(F.col(f"{k}_med").alias(v) for k, v in names.items()))


@query("recencies", "i:message_id " + with_kind("d", MEDIANS), "SELECT * FROM imp0")
def _(s, d):
    return impute.filled(impute.with_medians(history.recencies(logged(s, d)), features.IMPUTED), features.IMPUTED)


@query("prev_flags", "i:message_id i:prev_is_opened i:prev_is_clicked i:prev_is_unsubscribed i:prev_is_complained", "SELECT * FROM hist")
def _(s, d):
    return history.previous_flags(clean.live(msg(s, d)))


@query("message_counters", "i:message_id i:total_messages i:total_purchases i:has_prior_purchase", "SELECT * FROM hist")
def _(s, d):
    return history.counters(clean.live(msg(s, d)))


@query("distinct_campaigns", "i:message_id i:total_campaigns", "SELECT * FROM distinct_c")
def _(s, d):
    return history.distinct_campaigns(clean.live(msg(s, d)))


def _purchases(s, d):
    df = history.last_purchase(history.counters(clean.live(msg(s, d))))
    return impute.purchase_features(impute.with_medians(df, ["__purchase_days"]))


@query("purchase_recency", "i:message_id d:days_since_last_purchase", "SELECT * FROM feat")
def _(s, d):
    return _purchases(s, d)


@query("repurchase_hazard", "i:message_id d:feat_rtb_hazard", "SELECT * FROM feat")
def _(s, d):
    return _purchases(s, d)


@query("postbuy_refractory", "i:message_id d:feat_postbuy_refrac", "SELECT * FROM feat")
def _(s, d):
    return _purchases(s, d)


@query("calendar_features", "i:message_id i:cal_week_of_month i:cal_is_weekend d:feat_dow_shift d:feat_hour_shift", "SELECT * FROM feat")
def _(s, d):
    return clean.live(msg(s, d)).withColumns(calendar())


@query("payday_eoq", "i:message_id d:feat_payday_bump d:feat_eoq_bump", "SELECT * FROM feat")
def _(s, d):
    return clean.live(msg(s, d)).withColumns(calendar())


@query("fatigue", "i:message_id d:feat_fatigue", "SELECT * FROM hist")
def _(s, d):
    return history.fatigue(history.channel_times(clean.live(msg(s, d))))


@query("cooldown", "i:message_id i:feat_cooldown_ok", "SELECT * FROM hist")
def _(s, d):
    return history.cooldown(history.channel_times(clean.live(msg(s, d))))


@query("channel_recency", "i:message_id " + with_kind("d", [f"feat_last_{c}_hours" for c in ("email", "mobile_push", "sms", "multichannel", "any")]), "SELECT * FROM hist")
def _(s, d):
    return history.channel_recency(history.channel_times(clean.live(msg(s, d))))


@query("rolling_30d", "i:message_id d:u_open_cnt_30d d:u_open_rate_30d d:u_click_rate_30d", "SELECT * FROM roll")
def _(s, d):
    return rolling.rolling(clean.live(msg(s, d)))


@query("velocity_7d_30d", "i:message_id d:u_open_velocity_7d_30d d:u_click_velocity_7d_30d", "SELECT * FROM roll")
def _(s, d):
    return rolling.rolling(clean.live(msg(s, d)))


@query("cadence_std", "i:message_id d:u_cadence_std_30d", "SELECT * FROM roll")
def _(s, d):
    return rolling.rolling(clean.live(msg(s, d)))


@query("rolling_30d_orders", "i:message_id d:u_open_cnt_30d d:u_open_rate_30d d:u_click_rate_30d d:u_open_velocity_7d_30d d:u_click_velocity_7d_30d d:u_cadence_std_30d", "SELECT * FROM oroll")
def _(s, d):
    return rolling.rolling(crm.order_log(s, d))


@query("global_open_rate", "i:message_id d:ctx_tc_open_rate_30d", "SELECT * FROM ctx")
def _(s, d):
    return rolling.global_open_rate(clean.live(msg(s, d)))


@query("topic_recency", "i:message_id i:topic_N7 d:topic_t_since_hours d:feat_topic_novelty", "SELECT * FROM feat")
def _(s, d):
    return impute.topic_features(impute.with_medians(history.topics(logged(s, d)), ["__topic_gap"]))


@query("last_success_jaccard", "i:message_id d:feat_like_last_success", "SELECT * FROM hist")
def _(s, d):
    return similarity.like_last_success(logged(s, d))


@query("path_alignment", "i:message_id d:feat_path_align", "SELECT * FROM path")
def _(s, d):
    return similarity.path_alignment(logged(s, d))


@query("bernoulli_negatives", "i:message_id i:is_purchased", "SELECT message_id, is_purchased FROM hashed WHERE is_purchased = 1 OR h < CAST(0.37 AS DOUBLE)")
def _(s, d):
    return sampling.bernoulli_negatives(msg(s, d), 0.37)


@query("sampling_rate", "d:rate", f"SELECT least(1, {NEGATIVES} * CAST(1.02 AS DOUBLE) / greatest(1, count(*) FILTER (is_purchased = 0))) AS rate FROM msg")
def _(s, d):
    return sampling.rate_for(msg(s, d), NEGATIVES)


@query("exact_sample", "i:message_id i:is_purchased", f"SELECT message_id, is_purchased FROM ranks WHERE r < CASE WHEN is_purchased = 1 THEN {POSITIVES} ELSE {NEGATIVES} END")
def _(s, d):
    return sampling.exact_sample(msg(s, d), POSITIVES, NEGATIVES)


SPLIT = "CASE WHEN r < floor(size * 0.15 + 0.5) THEN 'test' WHEN r < floor(size * 0.15 + 0.5) + floor((size - floor(size * 0.15 + 0.5)) * 0.17647 + 0.5) THEN 'validation' ELSE 'train' END"


@query("stratified_split", "i:message_id i:is_purchased s:split", f"SELECT message_id, is_purchased, {SPLIT} AS split FROM ranks")
def _(s, d):
    return sampling.stratified_split(msg(s, d))


@query("stratified_folds", "i:message_id i:is_purchased i:fold", "SELECT message_id, is_purchased, r % 3 AS fold FROM ranks")
def _(s, d):
    return sampling.stratified_folds(msg(s, d))


@query("capped_negatives", "i:message_id i:is_purchased", f"SELECT message_id, is_purchased FROM ranks WHERE is_purchased = 1 OR r < {CAP}")
def _(s, d):
    return sampling.capped_negatives(msg(s, d), CAP)


@query("uniform_subsample", "i:message_id", f"SELECT message_id FROM hashed ORDER BY h, message_id LIMIT {SMALL}")
def _(s, d):
    return sampling.subsample(msg(s, d), SMALL)


@query("union_all", "i:message_id i:is_purchased", "SELECT message_id, is_purchased FROM msg WHERE is_purchased = 1 UNION ALL SELECT message_id, is_purchased FROM hashed WHERE is_purchased = 0 AND h < CAST(0.1 AS DOUBLE)")
def _(s, d):
    df = msg(s, d)
    return df.where("is_purchased = 1").unionByName(df.where((F.col("is_purchased") == 0) & (sampling.unit_hash() < 0.1)))


def _table(s, d):
    return features.build(logged(s, d))


def corr(a: str, b: str) -> str:
    return f"coalesce(abs(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)), 0)"


def tall(one: dict[str, str], rows: list[str]) -> str:
    """SQL of a one-row query over the feature table, then its columns as rows."""
    return "WITH one AS MATERIALIZED (SELECT " + ", ".join(f"{v} AS {k}" for k, v in one.items()) + " FROM feat) " + " UNION ALL ".join(f"SELECT {r} FROM one" for r in rows)


REDUNDANT = [f for f in DOMAIN if f != "cal_week_of_month"]


@query("feature_correlation", "s:feature d:abs_corr i:redundant", "SELECT *, CAST(abs_corr > 0.5 AS INTEGER) AS redundant FROM (" + tall({f"{f}_{i}": f"round({corr(f, c)}, 9)" for f in REDUNDANT for i, c in enumerate(STRONG)}, [f"'{f}' AS feature, greatest({', '.join(f'{f}_{i}' for i in range(6))}) AS abs_corr" for f in REDUNDANT]) + ")")
def _(s, d):
    return diagnostics.redundancy(_table(s, d), REDUNDANT, STRONG)


SIMPLE = ["u_open_cnt_30d", "u_open_rate_30d", "u_click_rate_30d", "feat_fatigue", "feat_last_any_hours", "total_messages", "total_purchases", "days_since_last_purchase", "feat_hour_shift"]


@query("target_correlation_top", "s:feature d:abs_corr", "SELECT * FROM (" + tall({f: f"round({corr(f, 'is_purchased')}, 6)" for f in SIMPLE}, [f"'{f}' AS feature, {f} AS abs_corr" for f in SIMPLE]) + ") ORDER BY abs_corr DESC, feature LIMIT 5")
def _(s, d):
    return diagnostics.target_correlation(_table(s, d), SIMPLE).withColumn("abs_corr", F.round("abs_corr", 6)).orderBy(F.desc("abs_corr"), "feature").limit(5)


@query("target_correlation_bottom", "s:feature d:abs_corr", "SELECT * FROM (" + tall({f: f"round({corr(f, 'is_purchased')}, 6)" for f in SIMPLE}, [f"'{f}' AS feature, {f} AS abs_corr" for f in SIMPLE]) + ") ORDER BY abs_corr, feature LIMIT 4")
def _(s, d):
    return diagnostics.target_correlation(_table(s, d), SIMPLE).withColumn("abs_corr", F.round("abs_corr", 6)).orderBy("abs_corr", "feature").limit(4)


MEANS = tall({f"{f}_{v}": f"avg(CASE WHEN is_purchased = {v} THEN {f} END)" for f in SIMPLE for v in (0, 1)}, [f"'{f}' AS feature, {f}_1 AS buyer_mean, {f}_0 AS other_mean" for f in SIMPLE])


@query("buyer_contrast", "s:feature d:buyer_mean d:other_mean d:diff_pct s:size", f"SELECT *, CASE WHEN diff_pct > 30 THEN 'big' WHEN diff_pct > 10 THEN 'moderate' ELSE 'tiny' END AS size FROM (SELECT *, abs(buyer_mean - other_mean) / greatest(abs(other_mean), 1e-10) * 100 AS diff_pct FROM ({MEANS}))")
def _(s, d):
    return diagnostics.buyer_contrast(_table(s, d), SIMPLE)


COUNTED = ["total_messages", "total_purchases", "cal_week_of_month", "topic_N7", "u_open_cnt_30d"]


@query("feature_variance", "s:feature d:variance i:n_distinct", tall({k: v for f in COUNTED for k, v in ((f"{f}_v", f"var_samp({f})"), (f"{f}_n", f"count(DISTINCT {f})"))}, [f"'{f}' AS feature, {f}_v AS variance, {f}_n AS n_distinct" for f in COUNTED]))
def _(s, d):
    return diagnostics.variance(_table(s, d), COUNTED)


@query("confusion", "i:tn i:fp i:fn i:tp", "SELECT * FROM cm")
def _(s, d):
    return evaluate.confusion(scored(s, d), 0.5)


@query("classification_metrics", "d:accuracy d:precision d:recall d:f1_score d:f2_score", "SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2_score FROM cm")
def _(s, d):
    return evaluate.classification(evaluate.confusion(scored(s, d), 0.5))


def best(b2: int) -> str:
    f = f"round({1 + b2} * (tp / (tp + fp)) * (tp / p) / greatest({b2} * (tp / (tp + fp)) + tp / p, 1e-10), 12)"
    return f"SELECT score AS threshold, {f} AS best_f FROM pts ORDER BY best_f DESC, score LIMIT 1"


@query("threshold_f1", "d:threshold d:best_f", best(1))
def _(s, d):
    return evaluate.best_threshold(evaluate.curve(scored(s, d)))


@query("threshold_f2", "d:threshold d:best_f", best(4))
def _(s, d):
    return evaluate.best_threshold(evaluate.curve(scored(s, d)), beta=2.0)


@query("average_precision", "d:pr_auc", "SELECT sum(pos / p * (tp / (tp + fp))) AS pr_auc FROM pts")
def _(s, d):
    return evaluate.average_precision(evaluate.curve(scored(s, d)))


@query("roc_auc", "d:roc_auc", "SELECT sum(pos * (n - fp) + 0.5 * pos * neg) / (max(p) * max(n)) AS roc_auc FROM pts")
def _(s, d):
    return evaluate.roc_auc(evaluate.curve(scored(s, d)))


KS = "(SELECT unnest([" + ", ".join(map(str, TOP_K)) + "]) AS top_k)"


@query("topk_hits", "i:top_k i:tp_hits", f"SELECT top_k, sum(label) AS tp_hits FROM top JOIN {KS} ON rk <= top_k GROUP BY top_k")
def _(s, d):
    return evaluate.ranked_hits(scored(s, d), TOP_K)


TOTALS = "(SELECT count(*) AS n, sum(label) AS p FROM scored)"


@query("targeting_lift", "i:top_k d:population_share i:tp_hits d:precision_at_k d:cumulative_recall d:lift_vs_random", f"SELECT top_k, top_k / n AS population_share, h AS tp_hits, h / top_k AS precision_at_k, h / p AS cumulative_recall, (h / top_k) / (p / n) AS lift_vs_random FROM (SELECT top_k, sum(label) AS h FROM top JOIN {KS} ON rk <= top_k GROUP BY top_k) CROSS JOIN {TOTALS}")
def _(s, d):
    return evaluate.targeting(scored(s, d), TOP_K)


@query("topk_bounds", "i:top_k i:max_tp i:min_fp d:max_recall d:ideal_precision", f"SELECT top_k, least(top_k, q) AS max_tp, top_k - least(top_k, q) AS min_fp, least(top_k, q) / q AS max_recall, least(top_k, q) / top_k AS ideal_precision FROM {KS} CROSS JOIN (SELECT floor(p * 0.15) AS q FROM {TOTALS})")
def _(s, d):
    return evaluate.topk_bounds(s, scored(s, d), TOP_K)


@query("holdout_sizes", "i:n_test i:p_test i:n_negative", "SELECT floor(n * 0.15) AS n_test, floor(p * 0.15) AS p_test, floor(n * 0.15) - floor(p * 0.15) AS n_negative FROM " + TOTALS)
def _(s, d):
    one = scored(s, d).agg(F.floor(F.count("*") * 0.15).alias("n_test"), F.floor(F.sum("label") * 0.15).alias("p_test"))
    return one.withColumn("n_negative", F.col("n_test") - F.col("p_test"))


@query("tau_sweep", "i:message_id s:tau_multiplier d:feat_fatigue", "SELECT * FROM sweep")
def _(s, d):
    return studies.tau_sweep(clean.live(msg(s, d)))


RANKED = "SELECT *, row_number() OVER (PARTITION BY tau_multiplier ORDER BY round(-feat_fatigue, 9) DESC, message_id) AS rk FROM sweep"


@query("tau_targeting", "s:tau_multiplier i:top_k i:tp_hits d:precision_at_k d:cumulative_recall d:lift_vs_random", f"SELECT tau_multiplier, top_k, h AS tp_hits, h / top_k AS precision_at_k, h / p AS cumulative_recall, (h / top_k) / (p / n) AS lift_vs_random FROM (SELECT tau_multiplier, top_k, sum(is_purchased) AS h FROM ({RANKED}) JOIN {KS} ON rk <= top_k GROUP BY tau_multiplier, top_k) JOIN (SELECT tau_multiplier, count(*) AS n, sum(is_purchased) AS p FROM sweep GROUP BY tau_multiplier) USING (tau_multiplier)")
def _(s, d):
    return studies.tau_targeting(clean.live(msg(s, d)), TOP_K)


#: Two reports whose scores are simple thresholds, for the tables of studies.
REPORTS = "SELECT 'base' AS experiment, * FROM (SELECT count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM scored) UNION ALL SELECT 'all' AS experiment, * FROM (SELECT count(*) FILTER (score < 0.25 AND label = 0) AS tn, count(*) FILTER (score >= 0.25 AND label = 0) AS fp, count(*) FILTER (score < 0.25 AND label = 1) AS fn, count(*) FILTER (score >= 0.25 AND label = 1) AS tp FROM scored)"
MEASURED = f"SELECT experiment, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1_score, (tp + tn) / (tp + tn + fp + fn) AS accuracy, 5 * tp / (5 * tp + 4 * fn + fp) AS f2_score, tn, fp, fn, tp FROM ({REPORTS})"


def _reports(s, d):
    rows = scored(s, d)
    found = None
    for name, threshold in (("base", 0.5), ("all", 0.25)):
        one = evaluate.classification(evaluate.confusion(rows, threshold)).withColumns({"experiment": F.lit(name), "model": F.lit("threshold"), "roc_auc": F.lit(None).cast("double"), "pr_auc": F.lit(None).cast("double")})
        found = one if found is None else found.unionByName(one)
    return found


SIGNED = "CASE WHEN {c} >= 0 THEN '+' ELSE '' END || printf('{f}', {c}) || '%'"
METRIC_ROWS = " UNION ALL ".join(f"SELECT experiment, '{m}' AS metric, {m} AS value FROM ({MEASURED})" for m in ("precision", "recall", "f1_score", "accuracy", "f2_score"))


@query("model_comparison", "s:metric d:base d:total s:change", f"SELECT b.metric, b.value AS base, a.value AS total, {SIGNED.format(c='((a.value - b.value) / b.value * 100)', f='%.1f')} AS change FROM ({METRIC_ROWS}) b JOIN ({METRIC_ROWS}) a ON a.metric = b.metric AND a.experiment = 'all' WHERE b.experiment = 'base'")
def _(s, d):
    return studies.model_comparison(_reports(s, d)).where("metric NOT IN ('roc_auc', 'pr_auc')")


@query("ablation_delta", "s:experiment s:metric d:value s:change", f"SELECT a.experiment, a.metric, a.value, CASE WHEN a.experiment = 'base' THEN '' ELSE {SIGNED.format(c='((a.value - b.value) / b.value * 100)', f='%.3f')} END AS change FROM ({METRIC_ROWS}) a JOIN ({METRIC_ROWS}) b ON a.metric = b.metric AND b.experiment = 'base'")
def _(s, d):
    return studies.ablation_delta(_reports(s, d)).where("metric NOT IN ('roc_auc', 'pr_auc')")


@query("report_flatten", "s:experiment d:precision d:recall i:tn i:fp i:fn i:tp", MEASURED)
def _(s, d):
    r = _reports(s, d)
    return studies.report_rows(r.select("experiment", F.struct("precision", "recall", F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix")).alias("r")))


@query("fold_ensemble", "i:message_id i:label d:score", "SELECT message_id, label, (score + score / 2 + score / 4) / 3 AS score FROM scored")
def _(s, d):
    each = scored(s, d).select("message_id", "label", F.posexplode(F.array(F.col("score"), F.col("score") / 2, F.col("score") / 4)).alias("fold", "score"))
    return studies.fold_mean(each)


@query("standardised", "i:message_id d:value d:t", "SELECT message_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value, (t - avg(t) OVER ()) / stddev_pop(t) OVER () AS t FROM msg")
def _(s, d):
    return impute.standardised(msg(s, d).select("message_id", "value", "t"), ["value", "t"])


@query("strict_time_recency", "i:message_id d:hours", f"SELECT message_id, t - max(o) AS hours FROM (SELECT a.message_id, a.t, (CASE WHEN b.opened_h <= b.t THEN b.opened_h END) AS o FROM log a LEFT JOIN log b ON {oracle.EARLIER}) GROUP BY message_id, t")
def _(s, d):
    return history.recencies(logged(s, d), strict_time=True).withColumnRenamed("__avg_time_since_last_open", "hours")


for _group in features.GROUPS:

    @query(f"features_{_group}", "i:message_id " + feature_kinds(features.GROUPS[_group]), "SELECT * FROM feat")
    def _(s, d):
        return _table(s, d)


@query("features_extras", "i:message_id " + feature_kinds(features.EXTRAS), "SELECT * FROM feat")
def _(s, d):
    return _table(s, d)


@query("features_all", "i:message_id i:is_purchased " + feature_kinds(features.INPUTS), "SELECT * FROM feat")
def _(s, d):
    return _table(s, d)


SAMPLED = "i:message_id i:is_purchased " + feature_kinds(["total_messages", "avg_time_since_last_open", "feat_fatigue", "u_open_rate_30d", "ctx_tc_open_rate_30d", "days_since_last_purchase"])


@query("features_sampled_first", SAMPLED, "SELECT * FROM feat", sampled=True)
def _(s, d):
    return features.sampled(logged(s, d), 0.4)


@query("features_full_history", SAMPLED, "SELECT * FROM feat WHERE message_id IN (SELECT message_id FROM hashed WHERE is_purchased = 1 OR h < CAST(0.4 AS DOUBLE))")
def _(s, d):
    return features.sampled(logged(s, d), 0.4, full_history=True)


#: Sizes of models that suit the driver's tables.
TREES = {"maxIter": 10, "maxDepth": 4}
REPORTED = "s:experiment i:num_features d:optimal_threshold d:accuracy d:precision d:recall d:f1_score d:f2_score d:roc_auc d:pr_auc"


def _training(s, d):
    return models.training_rows(_table(s, d), features.INPUTS)


@query("gbt_scores", "i:message_id i:label s:split d:score i:trees")
def _(s, d):
    return models.ensemble(_training(s, d), "gbt", features.INPUTS, patience=4, **TREES)


@query("rf_scores", "i:message_id i:label s:split d:score")
def _(s, d):
    return models.ensemble(_training(s, d), "rf", features.INPUTS, numTrees=20)


@query("mlp_scores", "i:message_id i:label s:split d:score")
def _(s, d):
    return models.ensemble(_training(s, d), "mlp", features.INPUTS, maxIter=40)


#: Inputs of the networks' queries: state that is cheap to make.
NETWORK_INPUTS = ["total_messages", "total_purchases", "has_prior_purchase", *(f"prev_is_{c}" for c in ("opened", "clicked", "unsubscribed", "complained")), "feat_fatigue", "feat_cooldown_ok", *(f"feat_last_{c}_hours" for c in ("email", "mobile_push", "sms", "multichannel", "any")), *features.CAMPAIGN]


def _network(s, d, kind: str, steps: int = 1, **params):
    table = history.applied(logged(s, d).where("t IS NOT NULL"), history.counters, history.previous_flags, history.channel_times)
    table = history.channel_recency(history.cooldown(history.fatigue(table)))
    table = train.sequences(table, NETWORK_INPUTS, steps) if steps > 1 else train.vectors(table, NETWORK_INPUTS)
    split = sampling.split_column(clean.live(msg(s, d)).where("t IS NOT NULL"))
    rows = written(table.select("message_id", split.alias("split"), F.col("is_purchased").alias("label"), "x"), f"{scratch(s, 'network')}/rows")
    model = train.fit(rows.where("split = 'train'"), rows.where("split = 'validation'"), kind, NETWORK_INPUTS, epochs=3, pos_weight=4.0, **params)
    return train.scored(model, rows.where("split = 'test'"))


for _kind, _steps, _params in (("cnn", 1, {"filters": 16}), ("rnn", 4, {"hidden": 16}), ("lstm", 4, {"hidden": 16}), ("cnn_lstm", 1, {"filters": 16, "hidden": 16}), ("rnn_lstm", 4, {"hidden": 16}), ("tabnet", 1, {"width": 8})):

    @query(f"{_kind}_scores", "i:message_id i:label d:score")
    def _(s, d, kind=_kind, steps=_steps, params=_params):
        return _network(s, d, kind, steps, **params)


@query("model_ablation", f"{REPORTED} i:top100_hits i:top200_hits i:top300_hits i:tn i:fp i:fn i:tp")
def _(s, d):
    return studies.report_rows(models.ablation(_table(s, d), "rf", sizes=(100, 200, 300), folds=2, numTrees=10, maxDepth=6))


@query("model_topk_delta", "s:experiment s:item d:value s:change")
def _(s, d):
    return studies.topk_delta(studies.report_rows(models.ablation(_table(s, d), "rf", ["base", "all"], (100, 200, 300), folds=2, numTrees=10, maxDepth=6)))


@query("model_search", "i:place i:trees i:depth d:pr_auc")
def _(s, d):
    found = models.search(_training(s, d), "rf", features.INPUTS, {"maxDepth": [4, 6]}, {"numTrees": 10}, folds=2)
    return s.createDataFrame([(i + 1, p["numTrees"], p["maxDepth"], v) for i, (p, v) in enumerate(found)], "place int, trees int, depth int, pr_auc double")


@query("model_tuning", "i:number s:params d:value")
def _(s, d):
    space = {"pos_weight": tune.Real(1.0, 20.0, log=True), "numTrees": tune.Whole(5, 15, 5), "maxDepth": tune.Whole(3, 7)}
    return models.tuned(_training(s, d), "rf", features.INPUTS, f"{scratch(s, 'tuning')}/trials", space, folds=2)


@query("model_missing_parameters", "i:number s:params d:value")
def _(s, d):
    return models.missing_parameters(_training(s, d), "rf", features.INPUTS, {"numTrees": 8, "maxDepth": 5}, scratch(s, "missing"), folds=2, trials=6)


@query("replicated_positives", "i:message_id i:copies", f"SELECT message_id, CASE WHEN is_purchased = 1 THEN 2 + CAST(h < CAST(0.5 AS DOUBLE) AS INTEGER) ELSE 1 END AS copies FROM (SELECT *, {oracle.HASH} AS h FROM (SELECT *, (message_id * 48271 + 2 * 69621 + 11) % 2147483647 AS x FROM msg))")
def _(s, d):
    return sampling.replicated(msg(s, d), 2.5).groupBy("message_id").agg(F.count("*").alias("copies"))


@query("saved_fold_models", "i:message_id i:same", f"SELECT message_id, 1 AS same FROM (SELECT message_id, {SPLIT} AS split FROM (SELECT *, row_number() OVER (PARTITION BY is_purchased ORDER BY h, message_id) - 1 AS r, count(*) OVER (PARTITION BY is_purchased) AS size FROM hashed WHERE is_hard_bounced = 0 AND is_blocked = 0)) WHERE split <> 'train'")
def _(s, d):
    """Fold models are fitted and saved; a second study loads them, and its scores are the same."""
    rows = models.training_rows(logged(s, d), ["k", "value", "is_opened", "is_clicked"])
    folder, found = scratch(s, "fold-models"), []
    for _ in range(2):
        ledger = Ledger(s, folder, digest_of(rows))
        found.append(models.ensemble(rows, "rf", ["k", "value", "is_opened", "is_clicked"], folds=2, ledger=ledger, numTrees=5, maxDepth=4))
    again = F.lit(int(ledger.reused == ["fold-0", "fold-1"]))
    both = found[0].join(found[1].select("message_id", F.col("score").alias("loaded")), "message_id")
    return both.select("message_id", ((F.col("score") == F.col("loaded")).cast("int") * again).alias("same"))


@query("tau_targeting_resumed", "s:tau_multiplier i:top_k i:tp_hits i:reused", f"SELECT tau_multiplier, top_k, h AS tp_hits, CAST(tau_multiplier IN ('0.50x', '0.75x') AS INTEGER) AS reused FROM (SELECT tau_multiplier, top_k, sum(is_purchased) AS h FROM ({RANKED}) JOIN {KS} ON rk <= top_k GROUP BY tau_multiplier, top_k)")
def _(s, d):
    """A sweep that stopped after two multipliers goes on with the third."""
    log = clean.live(msg(s, d))
    folder, inputs = scratch(s, "sweep"), digest_of(log)
    studies.resumable_targeting(log, TOP_K, Ledger(s, folder, inputs), studies.MULTIPLIERS[:2])
    ledger = Ledger(s, folder, inputs)
    rows = studies.resumable_targeting(log, TOP_K, ledger)
    reused = F.col("tau_multiplier").isin(*(name.removeprefix("targeting-") for name in ledger.reused))
    return rows.withColumn("reused", reused.cast("int"))


@query("tau_model_targeting", "s:tau_multiplier i:top_k i:tp_hits d:population_share d:precision_at_k d:cumulative_recall d:lift_vs_random")
def _(s, d):
    return models.tau_targeting(logged(s, d), "rf", TOP_K, folds=2, numTrees=10, maxDepth=6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(BUILDS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from tidemark.plans import io_queries  # noqa: E402, F401  (registers its queries)
