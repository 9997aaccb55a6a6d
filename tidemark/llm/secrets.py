"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Candidates are found by patterns in every whole text. Each candidate value's hash is counted over distinct repositories
(documents) and owners (sources). A value that EXAMPLE_OWNERS or more owners hold is a widely copied example, and so is one
that EXAMPLE_REPOSITORIES or more repositories hold, be they of one owner; any other looks live. The method also adds spans
of kind `owned`: long mixed tokens outside all base spans that look live and that one owner alone has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.spans import listed, tagged, with_spans

EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
#: The base kinds' patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: a shorter run has no longer one inside
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # whole runs of 24 or more
#: What `owned` spans may be: 24 or more token characters with a digit and letters of both cases.
MIXED = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9A-Z_-]*[a-z])(?=[0-9a-z_-]*[A-Z])[A-Za-z0-9_-]{24,}"
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs plus base and extra: arrays of struct<start, rank, end, kind, value>."""
    low = F.lower("text")
    named = low.contains(_WORDS[0])
    for w in _WORDS[1:]:
        named = named | low.contains(w)
    df = with_spans(docs, "__assign", "text", ASSIGN, named, group=2)
    df = with_spans(df, "__access", "text", ACCESS, F.col("text").contains("AKIA"))
    df = with_spans(df, "__hex", "text", HEX)
    df = with_spans(df, "__mixed", "text", MIXED)
    df = df.withColumn("base", F.concat(tagged("__assign", "assign", 0, lambda v: F.char_length(v) >= 6), tagged("__access", "access", 1), tagged("__hex", "hex", 2)))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return df.withColumn("extra", F.filter(tagged("__mixed", "owned", 3), apart)).drop("__assign", "__access", "__hex", "__mixed")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, repositories, owners of candidates (value_hash, doc_id, source); aggregated before it is dealt out."""
    by_doc = found.groupBy("value_hash", "source", "doc_id").agg(F.count("*").alias("n"))
    by_owner = by_doc.groupBy("value_hash", "source").agg(F.count("*").alias("docs"))
    return by_owner.groupBy("value_hash").agg(F.sum("docs").alias("repositories"), F.count("*").alias("owners"))


def judged(candidates: DataFrame, folder: str) -> DataFrame:
    """row, spans: struct<start, rank, end, kind, live> of candidates (row, doc_id, source, base, extra) that have any.

    Candidates of kind owned stay only if they look live and have a single owner. Ownership is written to folder first: a join of plain exchanges
    is one whose hot values are split at run time.
    """
    each = candidates.select("row", "doc_id", "source", F.explode(F.concat("base", "extra")).alias("s")).select("row", "doc_id", "source", "s.start", "s.rank", "s.end", "s.kind", F.sha2("s.value", 256).alias("value_hash"))
    owned = common.written(ownership(each.select("value_hash", "doc_id", "source")), f"{folder}/ownership")
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)
    known = each.join(owned, "value_hash").withColumn("live", live).where("kind <> 'owned' OR owners = 1 AND live")
    return known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "live"))).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, source): counts, digest of base spans, all spans, n_live and n_example.

    A null text is empty; a null source is one owner. Repeated rows are rows of their own but one repository. An empty
    table gives no rows.
    """
    rows = with_candidates(docs.select("doc_id", F.col("text").cast("string").alias("text"), "source"))
    folder = common.scratch(docs.sparkSession, "secrets")
    kept = common.written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "base", "extra"), f"{folder}/candidates")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return kept.join(judged(kept, folder), "row", "left").select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("spans")), F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("spans", lambda s: s["live"])), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("spans", lambda s: ~s["live"])), F.lit(0)).cast("long").alias("n_example"),
    )
