"""SQL of the queries, written apart from the plans: self-joins and plain windows where those use prefix sums."""

from __future__ import annotations

from tidemark.functions import clean
from tidemark.operators import history, similarity


def case(code: str, values: tuple[str | None, ...]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


def hot(expr: str, prefix: str, values: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN {expr} = '{v}' THEN 1 ELSE 0 END AS {prefix}{v.replace('.', '_')}" for v in values)


def one_of(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def clip(value: str, missing: str, high: float = 8760.0) -> str:
    return f"least(CAST({high} AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce({value}, CAST({missing} AS DOUBLE))))"


P = "(PARTITION BY client_id ORDER BY t NULLS LAST, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
C = "(PARTITION BY client_id ORDER BY t NULLS LAST, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
EARLIER = "b.client_id = a.client_id AND (b.t < a.t OR (b.t = a.t AND b.message_id < a.message_id))"


def last(value: str, frame: str = P) -> str:
    return f"last_value({value} IGNORE NULLS) OVER {frame}"


def fatigue(multiplier: float = 1.0) -> str:
    tau = {c: v * (multiplier if c in ("sms", "email", "mobile_push") else 1) for c, v in history.TAU.items()}
    return " + ".join(f"CASE WHEN t - l{i} >= 0 THEN exp(-(t - l{i}) / CAST({tau[c]} AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END" for i, c in enumerate(clean.STATE_CHANNELS))


CODE = "CASE channel WHEN 'email' THEN 0 WHEN 'mobile_push' THEN 1 WHEN 'sms' THEN 2 WHEN 'multichannel' THEN 3 ELSE 4 END"
VEC = " + ".join(f"coalesce({c}, 0) * {1 << i}" for i, c in enumerate(similarity.ATTRIBUTES))
COOL = "CASE code " + " ".join(f"WHEN {i} THEN {history.COOL[c]}" for i, c in enumerate(clean.STATE_CHANNELS)) + " END"
OWN = "CASE code " + " ".join(f"WHEN {i} THEN l{i}" for i in range(5)) + " END"
TOPIC = "CASE " + " ".join(f"WHEN camp_topic{v.replace('.', '_')} = 1 THEN {i}" for i, v in enumerate(clean.TOPICS)) + " ELSE 0 END"
HASH = "((x * x % 2147483647) * (x * x % 2147483647) % 2147483647 * x % 2147483647) / CAST(2147483647 AS DOUBLE)"
DAY, DOW, HOUR, MONTH = "day(sent_at)", "(isodow(sent_at) - 1)", "hour(sent_at)", "month(sent_at)"
#: Scores with intended ties, for metrics.
SCORED = "SELECT message_id, is_purchased AS label, floor(value / 5 + 0.5) / 100 AS score FROM msg"

CTES: dict[str, str] = {
    "raw": "SELECT event_id AS message_id, user_id AS client_id, ts AS sent_at, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) / 3600 AS t FROM events",
    "msg0": f"""SELECT *, CAST(k AS BIGINT) AS campaign_id, {case('k % 5', ('email', 'mobile_push', 'sms', 'multichannel', 'web_push'))} AS channel,
        {case('k % 3', ('bulk', 'transactional', 'trigger'))} AS message_type, {case('k % 4', ('gmail.com', 'mail.ru', 'yahoo.com', None))} AS email_provider,
        {case('k % 6', ('desktop', 'smartphone', 'phablet', 'tablet', 'tv', None))} AS platform,
        CAST(event_type IN ('view', 'click', 'purchase') AS INTEGER) AS is_opened, CAST(event_type IN ('click', 'purchase') AS INTEGER) AS is_clicked,
        CAST(event_type = 'purchase' AS INTEGER) AS is_purchased, CAST(event_type = 'error' AND k % 10 = 0 AS INTEGER) AS is_unsubscribed,
        CAST(event_type = 'error' AND k % 10 = 1 AS INTEGER) AS is_complained, CAST(event_type = 'signup' AND k % 20 = 0 AS INTEGER) AS is_hard_bounced,
        CAST(event_type = 'signup' AND k % 20 = 1 AS INTEGER) AS is_blocked FROM raw""",
    "msg": """SELECT *, CASE WHEN is_opened = 1 THEN t + value / 60 END AS opened_h, CASE WHEN is_clicked = 1 THEN t + value / 30 END AS clicked_h,
        CASE WHEN is_purchased = 1 AND k % 7 <> 0 THEN t + value / 20 END AS purchased_h, CASE WHEN is_unsubscribed = 1 THEN t + value / 60 END AS unsubscribed_h,
        CASE WHEN is_complained = 1 THEN t + value / 60 END AS complained_h FROM msg0""",
    "camp0": f"""SELECT p_partkey AS campaign_id, lower(replace(trim(CASE p_type WHEN 'ECONOMY' THEN ' Event' WHEN 'LARGE' THEN 'happy birthday' WHEN 'MEDIUM' THEN 'Leave review'
        WHEN 'PROMO' THEN 'offer after purchase' WHEN 'SMALL' THEN 'sale out ' ELSE 'survey' END), ' ', '.')) AS topic0,
        lower({case('p_size % 4', ('bulk', 'Transactional', 'trigger', 'test'))}) AS type0, {case('p_size % 5', ('email', 'mobile_push', 'sms', 'multichannel', 'web_push'))} AS channel0,
        CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * CAST(1.5 AS DOUBLE) - 6 END AS duration_h FROM part WHERE p_partkey % 10 <> 9""",
    "camp": f"""SELECT campaign_id, {hot('type0', 'camp_campaign_type', clean.CAMPAIGN_TYPES)}, {hot('channel0', 'camp_channel', clean.CAMPAIGN_CHANNELS)},
        {hot(f"CASE WHEN topic0 IN ({one_of(clean.TOPICS)}) THEN topic0 ELSE 'other' END", 'camp_topic', clean.TOPICS)},
        greatest(CAST(0.1 AS DOUBLE), coalesce(duration_h, CAST(24 AS DOUBLE))) AS avg_campaign_duration FROM camp0""",
    "cust": "SELECT c_custkey AS client_id, CAST(floor(epoch_us(min(o_orderdate)) / 1000000) AS DOUBLE) / 3600 AS first_purchase_h FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "hol": "SELECT unnest([DATE '2024-01-01', DATE '2024-01-06', DATE '2024-01-15', DATE '2024-01-26']) AS day, 1 AS is_holiday",
    "log": f"""SELECT m.*, first_purchase_h, {', '.join(similarity.ATTRIBUTES)}, coalesce(avg_campaign_duration, CAST(24 AS DOUBLE)) AS avg_campaign_duration, coalesce(is_holiday, 0) AS is_holiday,
        {hot('channel', 'channel_', clean.FACT_CHANNELS)}, {hot('message_type', 'message_type_', clean.MESSAGE_TYPES)},
        CASE WHEN email_provider = 'gmail.com' THEN 1 ELSE 0 END AS email_provider_gmail_com, CASE WHEN email_provider = 'mail.ru' THEN 1 ELSE 0 END AS email_provider_mail_ru,
        CASE WHEN email_provider IN ('gmail.com', 'mail.ru') THEN 0 ELSE 1 END AS email_provider_other, {hot('platform', 'platform_', clean.PLATFORMS)},
        CASE WHEN platform IN ({one_of(clean.PLATFORMS)}) THEN 0 ELSE 1 END AS platform_rest, {CODE} AS code, {TOPIC} AS topic_N7, {VEC} AS vec
        FROM msg m LEFT JOIN cust USING (client_id) LEFT JOIN camp USING (campaign_id) LEFT JOIN hol ON CAST(sent_at AS DATE) = hol.day WHERE is_hard_bounced = 0 AND is_blocked = 0""",
    "hist0": f"""SELECT *, count(*) OVER {P} AS total_messages, coalesce(sum(is_purchased) OVER {P}, 0) AS total_purchases,
        {', '.join(f"coalesce({last(c)}, 0) AS prev_{c}" for c in ('is_opened', 'is_clicked', 'is_unsubscribed', 'is_complained'))},
        {', '.join(f"t - {last(src)} AS r_{new}" for new, src in history.RECENCIES.items())}, t - {last('first_purchase_h', C)} AS r_avg_time_since_first_purchase,
        (t - {last('CASE WHEN is_purchased = 1 THEN coalesce(purchased_h, t) END')}) / 24 AS days0,
        {', '.join(f"last_value(CASE WHEN code = {i} THEN t END IGNORE NULLS) OVER {P} AS l{i}" for i in range(5))},
        last_value(t) OVER (PARTITION BY client_id, topic_N7 ORDER BY t NULLS LAST, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic_last,
        {last('CASE WHEN is_purchased = 1 THEN vec END')} AS won FROM log""",
    "hist": f"""SELECT *, t - topic_last AS gap0, {fatigue()} AS feat_fatigue, CASE WHEN {OWN} IS NULL THEN 1 WHEN t - {OWN} >= {COOL} THEN 1 ELSE 0 END AS feat_cooldown_ok,
        {', '.join(f"{clip(f't - l{i}', '72')} AS feat_last_{c}_hours" for i, c in enumerate(clean.STATE_CHANNELS[:4]))},
        least({clip('t - l0', '72')}, {clip('t - l1', '72')}) AS feat_last_any_hours, CAST(total_purchases > 0 AS INTEGER) AS has_prior_purchase,
        CASE WHEN bit_count(vec | won) > 0 THEN bit_count(vec & won) / CAST(bit_count(vec | won) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS feat_like_last_success FROM hist0""",
    "distinct_c": f"SELECT a.message_id, count(DISTINCT b.campaign_id) AS total_campaigns FROM log a LEFT JOIN log b ON {EARLIER} GROUP BY a.message_id",
    "gaps": "SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY t, message_id) AS rn, t - lag(t) OVER (PARTITION BY client_id ORDER BY t, message_id) AS gap FROM log",
    "win": f"""SELECT a.message_id, b.is_opened AS o, b.is_clicked AS c, b.rn, b.gap, b.t >= a.t - 168 AS week, min(b.rn) OVER (PARTITION BY a.message_id) AS first
        FROM gaps a LEFT JOIN gaps b ON {EARLIER} AND b.t >= a.t - 720""",
    "roll0": """SELECT message_id, coalesce(sum(o), 0) AS n_open, avg(o) AS r_open, avg(c) AS r_click, avg(o) FILTER (week) AS r_open7, avg(c) FILTER (week) AS r_click7,
        coalesce(stddev_pop(gap) FILTER (rn > first), 0) AS cadence FROM win GROUP BY message_id""",
    "roll": """SELECT message_id, n_open AS u_open_cnt_30d, coalesce(r_open, 0) AS u_open_rate_30d, coalesce(r_click, 0) AS u_click_rate_30d, coalesce(r_open7 - r_open, 0) AS u_open_velocity_7d_30d,
        coalesce(r_click7 - r_click, 0) AS u_click_velocity_7d_30d, cadence AS u_cadence_std_30d FROM roll0""",
    "ctx": """SELECT a.message_id, coalesce(avg(b.is_opened), 0.25) AS ctx_tc_open_rate_30d FROM log a LEFT JOIN log b
        ON b.t >= a.t - 720 AND (b.t < a.t OR (b.t = a.t AND b.message_id < a.message_id)) GROUP BY a.message_id""",
    "path0": f"""SELECT message_id, client_id, t, {', '.join(f'coalesce({c}, 0) AS v{i}' for i, c in enumerate(similarity.ATTRIBUTES))},
        {', '.join(f'coalesce(sum(coalesce({c}, 0)) OVER {P}, 0) AS s{i}' for i, c in enumerate(similarity.ATTRIBUTES))} FROM log""",
    "path1": f"""SELECT *, CASE WHEN {' + '.join(f's{i} * s{i}' for i in range(13))} > 0 AND {' + '.join(f'v{i}' for i in range(13))} > 0
        THEN ({' + '.join(f's{i} * v{i}' for i in range(13))}) / (sqrt(CAST({' + '.join(f's{i} * s{i}' for i in range(13))} AS DOUBLE)) * sqrt(CAST({' + '.join(f'v{i}' for i in range(13))} AS DOUBLE)))
        ELSE CAST(0 AS DOUBLE) END AS ca FROM path0""",
    "path": f"SELECT message_id, coalesce(ca - avg(ca) OVER {P}, 0) AS feat_path_align FROM path1",
    "med": f"""SELECT {', '.join(f"coalesce(median(r_{c}), 24) AS m_{c}" for c in (*history.RECENCIES, 'avg_time_since_first_purchase'))}, coalesce(median(days0), 14) AS m_days, coalesce(median(gap0), 48) AS m_gap FROM hist""",
    "imp0": f"""SELECT *, {', '.join(f"{clip(f'r_{c}', f'm_{c}')} AS {c}" for c in (*history.RECENCIES, 'avg_time_since_first_purchase'))},
        CASE WHEN has_prior_purchase = 1 THEN {clip('days0', 'm_days', 365.0)} ELSE CAST(365 AS DOUBLE) END AS days_since_last_purchase, {clip('gap0', 'm_gap')} AS topic_t_since_hours FROM hist CROSS JOIN med""",
    "feat": f"""SELECT *, CASE WHEN has_prior_purchase = 1 THEN exp(-0.5 * power((days_since_last_purchase - m_days) / 7, 2)) ELSE 0 END AS feat_rtb_hazard,
        CASE WHEN has_prior_purchase = 1 THEN exp(-days_since_last_purchase / 14) ELSE 0 END AS feat_postbuy_refrac, exp(-topic_t_since_hours / 48) AS feat_topic_novelty,
        ({DAY} - 1) // 7 + 1 AS cal_week_of_month, CAST({DOW} >= 5 AS INTEGER) AS cal_is_weekend, sin(2 * pi() * {DOW} / 7) AS feat_dow_shift, sin(2 * pi() * {HOUR} / 24) AS feat_hour_shift,
        exp(-least(abs({DAY} - 10), abs({DAY} - 25)) / CAST(3 AS DOUBLE)) AS feat_payday_bump,
        exp(-greatest(0, CASE WHEN {MONTH} IN (3, 6, 9, 12) THEN 30 - {DAY} ELSE 30 END) / CAST(5 AS DOUBLE)) AS feat_eoq_bump
        FROM imp0 LEFT JOIN distinct_c USING (message_id) LEFT JOIN roll USING (message_id) LEFT JOIN ctx USING (message_id) LEFT JOIN path USING (message_id)""",
    "olog": "SELECT o_orderkey AS message_id, o_custkey AS client_id, CAST(floor(epoch_us(o_orderdate) / 1000000) AS DOUBLE) / 3600 AS t, CAST(o_orderstatus = 'F' AS INTEGER) AS is_opened, CAST(o_orderstatus = 'O' AS INTEGER) AS is_clicked FROM orders",
    "ogaps": "SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY t, message_id) AS rn, t - lag(t) OVER (PARTITION BY client_id ORDER BY t, message_id) AS gap FROM olog",
    "owin": f"""SELECT a.message_id, b.is_opened AS o, b.is_clicked AS c, b.rn, b.gap, b.t >= a.t - 168 AS week, min(b.rn) OVER (PARTITION BY a.message_id) AS first
        FROM ogaps a LEFT JOIN ogaps b ON {EARLIER} AND b.t >= a.t - 720""",
    "oroll": """SELECT message_id, coalesce(sum(o), 0) AS u_open_cnt_30d, coalesce(avg(o), 0) AS u_open_rate_30d, coalesce(avg(c), 0) AS u_click_rate_30d,
        coalesce(avg(o) FILTER (week) - avg(o), 0) AS u_open_velocity_7d_30d, coalesce(avg(c) FILTER (week) - avg(c), 0) AS u_click_velocity_7d_30d,
        coalesce(stddev_pop(gap) FILTER (rn > first), 0) AS u_cadence_std_30d FROM owin GROUP BY message_id""",
    "scored": SCORED,
    "hashed": f"SELECT *, {HASH} AS h FROM (SELECT *, (message_id * 48271 + 1 * 69621 + 11) % 2147483647 AS x FROM msg)",
    "ranks": "SELECT *, row_number() OVER (PARTITION BY is_purchased ORDER BY h, message_id) - 1 AS r, count(*) OVER (PARTITION BY is_purchased) AS size FROM hashed",
    "pts": """SELECT score, sum(label) AS pos, sum(1 - label) AS neg, sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp,
        sum(sum(label)) OVER () AS p, sum(sum(1 - label)) OVER () AS n FROM scored GROUP BY score""",
    "cm": "SELECT count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM scored",
    "top": "SELECT *, row_number() OVER (ORDER BY score DESC, message_id) AS rk FROM scored",
    "sweep": "SELECT message_id, is_purchased, tau_multiplier, feat_fatigue FROM (" + " UNION ALL ".join(f"SELECT message_id, is_purchased, '{m:.2f}x' AS tau_multiplier, {fatigue(m)} AS feat_fatigue FROM hist0" for m in (0.5, 0.75, 1.0, 1.25, 1.5)) + ")",
}
HEAD = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in CTES.items())
#: The same over a log of all positives and of negatives whose hash is below a rate.
SAMPLED_HEAD = HEAD.replace("FROM msg m LEFT JOIN cust", f"FROM (SELECT * EXCLUDE (x, h) FROM (SELECT *, {HASH} AS h FROM (SELECT *, (message_id * 48271 + 1 * 69621 + 11) % 2147483647 AS x FROM msg)) WHERE is_purchased = 1 OR h < CAST(0.4 AS DOUBLE)) m LEFT JOIN cust")


def sql(body: str, columns: dict[str, str], sampled: bool = False) -> str:
    """The query with its columns in the types of the plans: i long, d double rounded to 6 places, s text."""
    kinds = {"i": "CAST({0} AS BIGINT) AS {0}", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}"}
    return f"{SAMPLED_HEAD if sampled else HEAD} SELECT {', '.join(kinds[k].format(c) for c, k in columns.items())} FROM ({body}) AS q"
