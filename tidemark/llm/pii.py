"""Personal data, and information-theoretic sanitisation around it, in DataFrame operations only.

Patterns find the protected entities. Over the corpus, a term's disclosure of an entity is their pointwise mutual
information as a share of the entity's information content: log2(N n_te / (n_t n_e)) / log2(N / n_e), where N counts
distinct texts, n_e those with the entity, n_t those with the term and n_te those with both, anywhere. Beyond REMOVE a term is
removed, beyond GENERALISE generalised: each place of it in documents with the entity, outside of entities, becomes a span
of kind `removed` or `general`. A pair must co-occur in SUPPORT distinct texts: one text says nothing about co-occurrence,
however often it is copied.

As n_te is at most n_e, a term of more than n_e (N / n_e)^(1 - GENERALISE) texts can't disclose the entity; so only rare
terms are paired with the entities of their texts.
In the sanitised text entities are named by their kind, removed terms are gone, generalised ones say what they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.spans import listed, replaced, tagged, with_spans

SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Tables of at most so many terms are broadcast (100 bytes each or so); larger ones are joined by exchanges.
FEW = 500_000
#: As many hashes of repeated texts are broadcast (24 bytes each).
MOST_COPIED = 1_000_000
#: Words of a text that are placed together, and those whose lengths are added up together.
SEGMENT, BLOCK = 1024, 32
#: The base kinds' patterns, in forms without repeated groups that vary in width: those recurse, and a long text overflows the
#: stack. Local parts and numbers begin where their run begins, or where the last match ended. A dot goes on in a domain only
#: before a label. Only whole runs of card digits of 14 to 19 can count, so no longer repetition is tried.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What stands for a generalised term.
GENERAL = "[TERM]"
#: Words: ASCII letters and digits and everything beyond ASCII.
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right is doubled, less 9 beyond 9; the sum is a multiple of 10."""
    places = F.transform(F.split(F.reverse(value), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def with_entities(docs: DataFrame) -> DataFrame:
    """docs plus base: an array of struct<start, rank, end, kind, value>, values in normal form."""
    text = F.col("text")
    df = with_spans(docs, "__email", "text", EMAIL, text.contains("@"))
    df = with_spans(df, "__ip", "text", IP, text.rlike(r"[0-9]\.[0-9]"))
    df = with_spans(df, "__card", "text", CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"))
    df = with_spans(df, "__phone", "text", PHONE, text.contains("+"))
    card = lambda v: F.when(F.char_length(digits(v)).between(14, 19), luhn(digits(v))).otherwise(False)
    base = F.concat(
        tagged("__email", "email", 0, entity=F.lower),
        tagged("__ip", "ip", 1, lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        tagged("__card", "card", 2, card, digits),
        tagged("__phone", "phone", 3, lambda v: F.char_length(digits(v)).between(10, 15), digits),
    )
    return df.withColumn("base", base).drop("__email", "__ip", "__card", "__phone")


def _words(text: str = "text") -> Column:
    return F.explode(F.array_distinct(F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != ""))).alias("term")


def distinct_weight(docs: DataFrame, folder: str) -> DataFrame:
    """docs plus weight: of equal texts each has its share of one, so that sums count distinct texts."""
    key = {"__h0": F.xxhash64("text"), "__h1": F.xxhash64(F.lit(7), "text")}
    copies = docs.select(*(v.alias(k) for k, v in key.items())).groupBy(*key).agg(F.count("*").alias("__copies")).where("__copies > 1")
    repeated = common.few(copies, f"{folder}/copies", MOST_COPIED)
    return docs.withColumns(key).join(repeated, list(key), "left").withColumn("weight", 1.0 / F.coalesce("__copies", F.lit(1))).drop("__copies", *key)


def told_terms(texts: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """entity, term, removed: what discloses. texts: text, entities (struct<entity, n_e>) of distinct texts with frequent entities; docs: text."""
    words = texts.select("entities", _words())
    often = words.groupBy("term").count().where(F.col("count") >= SUPPORT).select("term")
    terms = common.few(often, f"{folder}/terms", FEW)
    weighed = distinct_weight(docs, folder)
    n = round(weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0])
    most = texts.select(F.array_max(F.transform("entities", lambda e: e["n_e"])).alias("m")).agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    bound = lambda n_e: F.pow(n_e.cast("double"), F.lit(GENERALISE)) * float(n) ** (1 - GENERALISE) * (1 + 1e-9)
    counted = weighed.select(_words(), "weight").join(terms, "term", "left_semi").groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("n_t"))
    rare = common.few(counted.where(F.col("n_t") <= bound(F.lit(most))), f"{folder}/rare", FEW)
    met = words.join(rare, "term").select("term", "n_t", F.explode("entities").alias("e")).select("term", "n_t", "e.*").where(F.col("n_t") <= bound(F.col("n_e")))
    together = met.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")).where(F.col("n_te") >= SUPPORT)
    share = F.log2(F.lit(n) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log2(F.lit(n) / F.col("n_e"))
    told = together.where(F.col("n_e") < n).withColumn("share", share).where(F.col("share") >= GENERALISE)
    return common.few(told.select("entity", "term", (F.col("share") >= REMOVE).alias("removed")), f"{folder}/told", FEW)


def placed(texts: DataFrame) -> DataFrame:
    """row, start, end, removed: every place of each row's terms. texts: row, text, gone and dim (terms to remove and to generalise).

    A text's words are cut into segments, each with the code points before it; inside one, lengths are added up by blocks.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    sizes = F.zip_with("words", F.slice(F.split("text", WORD, -1), 1, F.greatest(F.size("words"), F.lit(1))), lambda w, g: F.struct(F.coalesce(F.char_length(g), F.lit(0)).cast("long").alias("gap"), F.coalesce(F.char_length(w), F.lit(0)).cast("long").alias("len")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x["gap"] + x["len"])
    df = texts.select("row", "text", "gone", "dim", words.alias("words")).where(F.size("words") > 0).withColumn("sizes", sizes)
    segments = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / SEGMENT).cast("int"))
    part = lambda c, i: F.slice(c, i * SEGMENT + 1, F.lit(SEGMENT))
    df = df.select("row", "gone", "dim", F.transform(segments, lambda i: F.struct(total(part("sizes", i)).alias("all"), part("words", i).alias("words"), part("sizes", i).alias("sizes"))).alias("parts"))
    df = df.select("row", "gone", "dim", F.explode(F.transform("parts", lambda x, i: F.struct(F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda acc, p: acc + p["all"]).alias("before"), x["words"].alias("words"), x["sizes"].alias("sizes")))).alias("s"))
    low = F.transform("s.words", lambda w: F.lower(w))
    df = df.select("row", "s.before", "s.sizes", low.alias("low"), F.array_intersect(low, F.col("gone")).alias("gone"), F.array_intersect(low, F.col("dim")).alias("dim")).where((F.size("gone") > 0) | (F.size("dim") > 0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / BLOCK).cast("int")), lambda b: total(F.slice("sizes", F.lit(1), b * BLOCK)))
    df = df.select("row", "before", "sizes", "low", "gone", "dim", blocks.alias("blocks"))
    marks = F.filter(F.transform("low", lambda w, i: F.struct(i.alias("i"), F.array_contains("gone", w).alias("removed"), F.array_contains("dim", w).alias("dimmed"))), lambda m: m["removed"] | m["dimmed"])
    df = df.select("row", "before", "sizes", "blocks", F.explode(marks).alias("m"))
    at, block = F.col("m.i"), F.floor(F.col("m.i") / BLOCK).cast("int")
    own = F.element_at("sizes", at + 1)
    start = F.col("before") + F.element_at("blocks", block + 1) + total(F.slice("sizes", block * BLOCK + 1, at - block * BLOCK)) + own["gap"]
    return df.select("row", start.alias("start"), (start + own["len"]).alias("end"), "m.removed")


def disclosing(found: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """row, terms: struct<start, rank, end, kind, value>. found: a written table of row, base, text of documents with entities; docs: text."""
    key = {"h0": F.xxhash64("text"), "h1": F.xxhash64(F.lit(7), "text")}
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    marked = common.written(found.select("row", *(v.alias(k) for k, v in key.items()), entities.alias("entities")), f"{folder}/marked-rows")
    firsts = common.written(marked.groupBy(*key).agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first")), f"{folder}/firsts")  # a row for each distinct text
    each = marked.join(firsts, "row", "left").select("row", "first", F.explode("entities").alias("entity"))
    counts = each.where("first").groupBy("entity").agg(F.count("*").alias("n_e"))
    frequent = common.written(counts.where(F.col("n_e") >= SUPPORT), f"{folder}/frequent")  # no other pair can co-occur so often
    held = each.join(frequent, "entity").groupBy("row").agg(F.first("first").alias("first"), F.collect_list(F.struct("entity", "n_e")).alias("entities"))  # of one document
    texts = common.written(found.join(common.written(held, f"{folder}/held"), "row"), f"{folder}/texts")
    told = told_terms(texts.where("first"), docs, folder)
    met = texts.select("row", F.transform("entities", lambda e: e["entity"]).alias("entities"), _words()).join(told, "term").where(F.array_contains("entities", F.col("entity"))).select("row", "term", "removed")
    worst = met.groupBy("row", "term").agg(F.max("removed").alias("removed"))
    which = lambda removed: F.collect_list(F.when(F.col("removed") == F.lit(removed), F.col("term")))
    marked = common.written(worst.groupBy("row").agg(which(True).alias("gone"), which(False).alias("dim")), f"{folder}/marked")
    places = common.written(placed(texts.join(marked, "row")), f"{folder}/places")
    taken = found.select("row", F.transform("base", lambda s: F.struct(s["start"], s["end"])).alias("taken"))
    apart = ~F.exists("taken", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    span = F.struct("start", F.when(F.col("removed"), 4).otherwise(5).alias("rank"), "end", F.when(F.col("removed"), "removed").otherwise("general").alias("kind"), F.lit("").alias("value"))
    return places.join(taken, "row").where(apart).groupBy("row").agg(F.collect_list(span).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, base and terms (struct<start, rank, end, kind, value>), sanitised, text_sha256.

    sanitised is the text with its spans replaced, null where nothing was found; then text_sha256 has the text's digest. A
    null text is empty. Repeated rows are documents of their own. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_entities(docs)
    folder = common.scratch(docs.sparkSession, "pii")
    # the lambda's variable holds base once; the text is kept only with entities
    both = F.transform(F.array("base"), lambda b: F.struct(b.alias("base"), F.when(F.size(b) > 0, F.col("text")).alias("text"), F.when(F.size(b) == 0, F.sha2("text", 256)).alias("text_sha256")))[0]
    kept = common.written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", both.alias("e")), f"{folder}/entities").select("row", "doc_id", "e.*")
    terms = disclosing(kept.where(F.size("base") > 0).select("row", "base", "text"), docs, folder)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")
    found = kept.join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))
    shown = lambda s: F.when(s["rank"] < 4, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["rank"] == 5, GENERAL).otherwise("")
    text = F.when(F.size("base") > 0, replaced("text", F.array_sort(F.concat("base", "terms")), shown))
    return found.select("doc_id", "base", "terms", text.alias("sanitised"), "text_sha256")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts, digest of base spans, all spans, n_removed and n_generalised terms, digest of the sanitised text.

    Nulls, repeated rows and empty tables as in sanitise().
    """
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return sanitise(docs).select(
        "doc_id",
        *(count("base", kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "terms")).alias("spans"),
        count("terms", "removed").alias("n_removed"),
        count("terms", "general").alias("n_generalised"),
        F.coalesce(F.sha2("sanitised", 256), "text_sha256").alias("sanitised_sha256"),
    )
