"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidemark.llm import bpe, common, decontaminate, langid, resemblance, secrets, spans

#: File of the byte-level BPE vocabulary in the folder of public tokenizers.
BYTE_BPE, MASK = "byte_bpe_50k.json", "[SECRET]"
#: Words in an encoder's cache: workers keep theirs beside a heap that all stages before have grown.
WORDS_KEPT = 60_000


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sheltered(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all columns but the used ones under names of their own, and what gives a result docs' columns again.

    So no column of an operator can take the place of one that came in. Columns passed by name are new values.
    """
    common.small_batches(docs.sparkSession)
    names = {c: c if c in used else f"__in_{i}" for i, c in enumerate(docs.columns)}
    inside = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return inside, lambda df, **new: df.select(*(new.get(c, F.col(n)).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; without letters or with too narrow a margin they go.

    So null and empty texts go. Repeated rows are judged alike, an empty table stays empty, other columns come through as they are.
    """
    rows, restored = sheltered(docs, "doc_id", "text", "lang")
    return restored(langid.predict(rows, langid.fit(rows)).where("NOT rejected"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest doc_id's (nulls last), and of its texts the one with the least hash.

    Near-duplicates have five-word shingles in common to 0.8 or more, over others too. Different texts that share a doc_id
    stay, copies go, with or without a doc_id; of repeated rows the one with the least hash of its columns stays. Null and
    empty texts are one group; an empty table stays empty. Rows that a sieve of bounded size can't clear of going or of being
    repeated are dealt out, with compressed texts; all others stay where they are read.
    """
    docs, restored = sheltered(docs, "doc_id", "text")
    folder = common.scratch(spark, "near-dedup")
    each = resemblance.components_of(docs).select("component", F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("h0").alias("__h0"), F.col("h1").alias("__h1"))
    key = ["__id", "__none", "__h0", "__h1"]
    each = common.written(each.groupBy("component", *key).agg(F.count("*").alias("copies")), f"{folder}/each")
    first = common.written(each.groupBy("component").agg(F.min(F.struct("__none", "__id", "__h0", "__h1")).alias("f")).select("f.*"), f"{folder}/first")
    gone = common.written(each.select(key).join(first, key, "left_anti"), f"{folder}/gone")
    id_, (h0, h1) = F.col("doc_id").cast("long"), resemblance.text_hashes().values()
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumns({"__id": F.coalesce(id_, F.lit(0)), "__none": id_.isNull(), "__h0": h0, "__h1": h1, "__key": F.xxhash64(h0, F.coalesce(id_, F.lit(0)))})
    asked = gone.union(each.where("copies > 1").select(key)).select(F.xxhash64("__h0", "__id").alias("__key"))
    bits = common.sieve(asked, "__key", f"{folder}/sieve")
    single = common.sifted(rows, "__key", bits, False).select(docs.columns)
    hashed = F.xxhash64(*(f.name for f in docs.schema if not isinstance(f.dataType, MapType)))
    met = common.packed(common.sifted(rows, "__key", bits, True), "text")
    one = met.groupBy(key).agg(F.min_by(F.struct(*docs.columns), hashed).alias("r"))  # repeated rows meet before they are dealt out
    return restored(single.unionByName(common.unpacked(one.join(gone, key, "left_anti").select("r.*"), "text")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have none and stay; repeated rows are judged alike, an empty table stays empty; other columns come
    through as they are.
    """
    rows, restored = sheltered(docs, "text")
    # whether a text is contaminated depends on it alone: its 128 bits of hashes stand for it, and texts aren't dealt out
    key = {"__k0": F.xxhash64("text"), "__k1": F.xxhash64(F.lit(7), "text")}
    found = decontaminate.scan(rows.withColumns(key), common.table(spark, sf_dir, "benchmark"), list(key))
    gone = common.written(found.where("contaminated").select(*key).distinct(), f"{common.scratch(spark, 'contaminated')}/texts")
    return restored(rows.withColumns(key).join(gone, list(key), "left_anti"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; credentials that look live are masked, widely copied examples stay. n_chars follows the text.

    Texts are searched once; what looks live is a table by doc_id and text, which documents are joined with, without being
    dealt out unless it is too much to broadcast. Null and empty texts and repeated rows stay, an empty table stays empty;
    other columns come through as they are.
    """
    given = docs
    docs, restored = sheltered(given, "doc_id", "text", "source")
    # a condition on a column that isn't deterministic isn't pushed into the scan's expressions, where each use is worked out anew
    rows = secrets.with_candidates(docs).withColumn("__once", F.monotonically_increasing_id()).where((F.col("__once") >= 0) & (F.size("base") + F.size("extra") > 0))
    key = {"__id": F.col("doc_id"), "__k0": F.xxhash64("text"), "__k1": F.xxhash64(F.lit(7), "text")}
    folder = common.scratch(spark, "secrets")
    kept = common.written(rows.withColumns(key).select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", *key, "base", "extra"), f"{folder}/candidates")
    live = secrets.judged(kept, folder).select("row", F.filter("spans", lambda s: s["live"]).alias("__live"))
    told = kept.join(live.where(F.size("__live") > 0), "row").dropDuplicates(list(key)).select(*key, "__live")
    told = common.written(told, f"{folder}/live")
    same = key["__id"].eqNullSafe(told["__id"]) & (key["__k0"] == told["__k0"]) & (key["__k1"] == told["__k1"])
    text = F.when(F.col("__live").isNotNull(), spans.replaced("text", F.col("__live"), lambda _: F.lit(MASK))).otherwise(F.col("text"))
    masked = docs.join(told, same, "left").withColumn("__masked", text)
    new = {"text": F.col("__masked")}
    if "n_chars" in given.columns:
        at = docs.columns[given.columns.index("n_chars")]
        new["n_chars"] = F.when(F.col("__live").isNotNull(), F.char_length("__masked").cast(given.schema["n_chars"].dataType)).otherwise(F.col(at))
    return restored(masked, **new)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens and token_ids (little-endian, 32 bits each); decoding each must give its text again.

    Null texts have no tokens; repeated rows stay, an empty table stays empty. A column that came in as n_tokens or token_ids is then called that with
    `_input` behind it.
    """
    rows, _ = sheltered(docs, "text")
    common.small_batches(spark, bpe.AT_ONCE)
    coded = bpe.encode(rows, tokenizer(BYTE_BPE), most=WORDS_KEPT)
    right = F.col("decoded") == F.coalesce("text", F.lit(""))
    n = F.when(right, F.col("n_tokens")).otherwise(F.raise_error(F.lit("decoding doesn't give the text")).cast("long"))
    names = [c if c not in ("n_tokens", "token_ids") else f"{c}_input" for c in docs.columns]
    return coded.select(*(F.col(i).alias(c) for i, c in zip(rows.columns, names, strict=True)), n.alias("n_tokens"), "token_ids")
