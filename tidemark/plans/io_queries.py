"""Queries of readers, sinks and raw-log cleaning: each writes its files and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import evaluate, history
from tidemark.plans import features, studies
from tidemark.plans.catalog import FLAGS, MEASURED, _reports, logged, msg, query, scored, with_kind
from tidemark.sources import crm, files, row_groups
from tidemark.sources.scratch import scratch, written

def _text_log(s, d):
    """The log as raw text, with flags in several spellings, ids like 12.0 and some bad timestamps."""
    k = F.col("k")
    flag = lambda c: F.when(F.col(c) == 1, F.when(k % 4 == 0, " T").when(k % 4 == 1, "true").when(k % 4 == 2, "1").otherwise("1.0")).otherwise(F.when(k % 2 == 0, "f"))
    sent = F.when(k % 10 == 7, "not a time").otherwise(F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"))
    return msg(s, d).select(F.col("message_id").cast("string").alias("message_id"), F.concat(F.col("client_id").cast("string"), F.lit(".0")).alias("client_id"), F.when(k % 10 == 3, "n/a").otherwise(F.col("campaign_id").cast("string")).alias("campaign_id"), "channel", sent.alias("sent_at"), *(flag(c).alias(c) for c in FLAGS), F.lit("x").alias("stream"))


def _cleaned(df):
    """Raw columns of a log in their types; columns that it lacks get their defaults."""
    df = clean.ensure_columns(clean.require_columns(df, ["message_id", "client_id", "sent_at"]), {"is_complained": F.lit(None).cast("string")})
    at = clean.timestamp_or_null("sent_at")
    return df.select(*(clean.id_or_sentinel(c).alias(c) for c in ("message_id", "client_id", "campaign_id")), clean.epoch_hours(at).alias("t"), *(clean.flag(c).alias(c) for c in FLAGS if c in df.columns))


RAW_SQL = "SELECT message_id, client_id, CASE WHEN k % 10 = 3 THEN -1 ELSE campaign_id END AS campaign_id, CASE WHEN k % 10 <> 7 THEN t END AS t, " + ", ".join(FLAGS) + " FROM msg"
RAW = "i:message_id i:client_id i:campaign_id d:t " + with_kind("i", FLAGS)


@query("csv_log_scan", RAW, RAW_SQL)
def _(s, d):
    path = f"{scratch(s, 'csv')}/log.csv"
    files.write_csv(_text_log(s, d), path, bom=True)
    return _cleaned(files.read_log_csv(s, path, ["message_id", "client_id", "campaign_id", "sent_at", *FLAGS, "absent"]))


@query("csv_fallback", RAW, RAW_SQL)
def _(s, d):
    path = f"{scratch(s, 'csv')}/log.csv"
    files.write_csv(_text_log(s, d), path)
    return _cleaned(files.read_log(s, path))


@query("parquet_parts", RAW, RAW_SQL)
def _(s, d):
    folder, raw = f"{scratch(s, 'parts')}/log", _text_log(s, d)
    parts = [raw.where(F.col("message_id").cast("long") % 3 == i) for i in range(3)]
    for i, part in enumerate(parts):
        files.write_parquet(part, f"{folder}/part{i}")
    return _cleaned(files.read_log(s, folder, ["message_id", "client_id", "campaign_id", "sent_at", *FLAGS]))


@query("resolved_log", RAW, RAW_SQL)
def _(s, d):
    """The log is where the first finished folder of the candidates is, as the environment doesn't name one."""
    folder = scratch(s, "resolved")
    files.write_parquet(_text_log(s, d), f"{folder}/second")
    path = files.resolve("MESSAGE_LOG", [f"{folder}/first", f"{folder}/second"], {}, f"{folder}/none", lambda c: files.exists(s, c))
    return _cleaned(files.read_log(s, path))


@query("campaign_csv", f"i:campaign_id {with_kind('i', features.CAMPAIGN)} d:avg_campaign_duration", "SELECT * FROM camp")
def _(s, d):
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    finish = F.timestamp_add("SECOND", (F.col("duration_h") * 3600).cast("long"), start)
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    raw = crm.raw_campaigns(s, d).select(F.col("campaign_id").alias("id"), "topic", "campaign_type", "channel", form(start).alias("started_at"), F.coalesce(form(finish), F.lit("n/a")).alias("finished_at"))
    path = f"{scratch(s, 'csv')}/campaigns.csv"
    files.write_csv(raw, path)
    return crm.campaigns(crm.campaign_dimension(files.read_dimension(s, path, "campaigns")))


@query("client_csv", "i:client_id d:first_purchase_h", "SELECT client_id, first_purchase_h FROM cust")
def _(s, d):
    path = f"{scratch(s, 'csv')}/clients.csv"
    files.write_csv(crm.clients(s, d).select("client_id", F.date_format("first_purchase_date", "yyyy-MM-dd HH:mm:ss").alias("first_purchase_date")), path)
    read = files.read_dimension(s, path, "clients")
    return read.select("client_id", clean.epoch_hours(clean.timestamp_or_null("first_purchase_date")).alias("first_purchase_h"))


@query("json_report_roundtrip", "s:experiment d:precision d:recall i:tn i:fp i:fn i:tp", MEASURED)
def _(s, d):
    path = f"{scratch(s, 'report')}/report.json"
    r = _reports(s, d)
    nested = r.select(F.map_from_arrays(F.array("experiment"), F.array(F.struct("precision", "recall", F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix")))).alias("m"))
    files.write_documents(nested.select(F.to_json("m").alias("value")), path)
    return studies.report_rows(files.read_reports(s, path, "precision double, recall double, confusion_matrix struct<tn:long,fp:long,fn:long,tp:long>"))


@query("part_quarantine", "s:part i:n", "SELECT 'part' || (message_id % 3) AS part, count(*) AS n FROM msg GROUP BY 1 UNION ALL SELECT 'part3' AS part, 0 AS n")
def _(s, d):
    folder, raw = f"{scratch(s, 'parts')}/log", _text_log(s, d)
    for i in range(3):
        files.write_parquet(raw.where(F.col("message_id").cast("long") % 3 == i), f"{folder}/part{i}")
    s.createDataFrame([("no parquet",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/part3")
    part = lambda c: F.regexp_extract(c, "/(part[0-9])/", 1).alias("part")
    counts = files.counted_parts(s, f"{folder}/part*", f"{folder}-counts")
    return counts.select(part("path"), "n").groupBy("part").agg(F.sum("n").alias("n")).unionByName(files.corrupt_parts(s, f"{folder}/part*", "message_id string").select(part("path"), F.lit(0).cast("long").alias("n")))


@query("counting_checkpoint", "i:n i:new_parts", "SELECT count(*) AS n, 1 AS new_parts FROM msg")
def _(s, d):
    """Two parts are counted; then one more, while the counts of the first are reused."""
    folder, raw = f"{scratch(s, 'parts')}/log", _text_log(s, d)
    part = lambda i: raw.where(F.col("message_id").cast("long") % 3 == i).coalesce(1)
    for i in (0, 1):
        files.write_parquet(part(i), f"{folder}/part{i}")
    before = files.counted_parts(s, f"{folder}/part*", f"{folder}-counts").select("path")
    before = s.createDataFrame(before.collect(), "path string")  # two rows
    files.write_parquet(part(2), f"{folder}/part2")
    after = files.counted_parts(s, f"{folder}/part*", f"{folder}-counts")
    new = after.join(before, "path", "left_anti").agg(F.count("*").alias("new_parts"))
    return after.agg(F.sum("n").alias("n")).join(F.broadcast(new))


@query("resumed_table", "i:message_id i:built", "SELECT message_id, 1 AS built FROM msg")
def _(s, d):
    """A table that is there isn't built again."""
    path = f"{scratch(s, 'resume')}/table"
    first = files.resumed(s, path, lambda: msg(s, d).select("message_id", F.lit(1).alias("built")))
    assert first.columns == ["message_id", "built"]
    return files.resumed(s, path, lambda: msg(s, d).select("message_id", F.lit(2).alias("built")))


@query("timestamp_coercion", "i:message_id d:t", "SELECT message_id, CASE WHEN k % 10 <> 7 THEN t END AS t FROM msg")
def _(s, d):
    return _cleaned(_text_log(s, d))


@query("campaign_duration", "i:campaign_id d:hours", "SELECT campaign_id, avg_campaign_duration AS hours FROM camp")
def _(s, d):
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    raw = crm.raw_campaigns(s, d).select("campaign_id", F.lit("2024-01-01 00:00:00").alias("started_at"), F.timestamp_add("SECOND", (F.col("duration_h") * 3600).cast("long"), start).cast("string").alias("finished_at"))
    return raw.select("campaign_id", clean.duration_hours(clean.hours_between("started_at", "finished_at")).alias("hours"))


@query("default_columns", "i:message_id i:is_complained i:is_opened", "SELECT message_id, 0 AS is_complained, is_opened FROM msg")
def _(s, d):
    raw = clean.require_columns(msg(s, d).drop("is_complained"), ["message_id", "is_opened"])
    return clean.ensure_columns(raw, {"is_complained": F.lit(0), "is_opened": F.lit(9)})


@query("existing_columns", "i:message_id i:is_opened", "SELECT message_id, is_opened FROM msg")
def _(s, d):
    return clean.existing(msg(s, d), ["message_id", "is_opened", "feat_absent"])


@query("dtype_normalisation", "i:message_id i:opened s:channel", "SELECT message_id, is_opened AS opened, channel FROM msg")
def _(s, d):
    return clean.normalised(msg(s, d).select("message_id", (F.col("is_opened") == 1).alias("opened"), "channel"))


@query("null_to_zero", "i:message_id d:opened_h d:purchased_h", "SELECT message_id, coalesce(opened_h, 0) AS opened_h, coalesce(purchased_h, 0) AS purchased_h FROM msg")
def _(s, d):
    return clean.zero_filled(msg(s, d), ["opened_h", "purchased_h"])


@query("raw_log_features", "i:message_id i:total_messages d:feat_fatigue", "SELECT message_id, total_messages, feat_fatigue FROM hist")
def _(s, d):
    """From text to features: a CSV log without bad times, cleaned, live messages only."""
    path = f"{scratch(s, 'csv')}/log.csv"
    sent = msg(s, d).select(F.col("message_id").cast("string").alias("message_id"), F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"))
    files.write_csv(_text_log(s, d).drop("sent_at").join(sent, "message_id"), path)
    raw = files.read_log_csv(s, path)
    df = _cleaned(raw).join(raw.select(clean.id_or_sentinel("message_id").alias("message_id"), "channel"), "message_id")
    return history.fatigue(history.channel_times(history.counters(clean.live(df))))


@query("regression_check", "s:metric d:found d:expected i:same", "SELECT metric, found, found AS expected, 1 AS same FROM (SELECT unnest(['precision', 'recall', 'f1_score', 'accuracy']) AS metric, unnest([tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), (tp + tn) / (tp + tn + fp + fn)]) AS found FROM cm)")
def _(s, d):
    """The metrics of the table's scores against what plain means over its rows give."""
    rows = scored(s, d)
    found = evaluate.classification(evaluate.confusion(rows, 0.5)).first().asDict()
    hit, real = F.col("score") >= 0.5, F.col("label") == 1
    p, r, right = F.avg(F.when(hit, F.col("label"))), F.avg(F.when(real, hit.cast("int"))), F.avg((hit == real).cast("int"))
    expected = rows.agg(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1_score"), right.alias("accuracy")).first().asDict()
    wrong = studies.regression_check(found, expected, 1e-9)
    return s.createDataFrame([(k, found[k], v, int(k not in wrong)) for k, v in expected.items()], "metric string, found double, expected double, same int")


@query("run_all_status", "s:job s:status i:n", "SELECT unnest(['counts', 'fails', 'positives']) AS job, unnest(['ok', 'failed', 'ok']) AS status, unnest([(SELECT count(*) FROM log), NULL, (SELECT sum(is_purchased) FROM msg)]) AS n")
def _(s, d):
    n = {}
    jobs = {"counts": lambda: n.update(counts=logged(s, d).count()), "fails": lambda: clean.require_columns(msg(s, d), ["absent"]), "positives": lambda: n.update(positives=msg(s, d).where("is_purchased = 1").count())}
    return s.createDataFrame([(name, status.split(":")[0], n.get(name)) for name, status, _ in studies.run_all(jobs)], "job string, status string, n long")


#: Rows of a row group, and the group of the second part's first file that is damaged, in the query of row groups.
GROUP_ROWS, DAMAGED = 100, 1
#: Rows of one of its files, about.
FILE_ROWS = 500_000


@query("row_group_quarantine", "i:message_id s:channel i:bad_groups", f"SELECT message_id, channel, 1 AS bad_groups FROM (SELECT *, row_number() OVER (PARTITION BY message_id % 3 ORDER BY message_id) - 1 AS place FROM msg) WHERE NOT (message_id % 3 = 1 AND place // {GROUP_ROWS} = {DAMAGED})")
def _(s, d):
    """Three parts of many row groups, one of them with damaged pages: all other rows come back, and the group is named.

    A part's files are ranges of its ids, so the first file's groups are the part's first.
    """
    folder = scratch(s, "groups")
    rows, part = msg(s, d).select("message_id", "channel"), F.col("message_id") % 3
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}  # a row for each part
    for i in range(3):
        ranges = rows.where(part == i).repartitionByRange(max(1, -(-sizes.get(i, 0) // FILE_ROWS)), "message_id").sortWithinPartitions("message_id")
        ranges.write.option("parquet.block.row.count.limit", GROUP_ROWS).option("compression", "snappy").parquet(f"{folder}/log/part{i}")
    files.damage_row_group(s, f"{folder}/log/part1", DAMAGED)
    found = written(row_groups.scan(s, f"{folder}/log", "message_id long, channel string"), f"{folder}/scanned")
    bad = row_groups.quarantined(found).agg(F.count("*").alias("bad_groups"))
    return row_groups.rows(found).join(F.broadcast(bad))  # one row
