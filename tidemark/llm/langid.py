"""Language ID by compression: a text is compressed with each language's zstandard raw-content dictionary.

The language whose dictionary gives the smallest output is chosen; the score is how much smaller that is than the second
(0 to 1), and a text with a narrower margin than MARGIN is rejected, whatever its length: a few words that compress alike
under every dictionary don't tell their language. Texts are lower-cased and reduced to letters and spaces, then compressed
whole, in blocks of BLOCK bytes, so that a long text doesn't serve as its own dictionary.

Dictionaries are fitted on a bounded sample of whole texts: of each language at most SAMPLE documents, those with the smallest
hash of doc_id and text, as many of them in that order as fit a language's share of TOTAL bytes, but one at least. A dictionary
has all of its documents' distinct pieces of PIECE bytes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.common import schema_plus

SAMPLE, PIECE, TOTAL, BLOCK, LEVEL, MARGIN = 200, 64, 32 << 20, 2048, 4, 0.005
_LETTER = regex.compile(r"\p{L}")
_TO_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_TO_LETTERS).split())


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=8).digest()


def pieces_of(text: str) -> list[bytes]:
    """The whole text in pieces."""
    body = letters(text)
    return [body[i : i + PIECE] for i in range(0, len(body), PIECE)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame) -> DataFrame:
    """lang, text of the documents to fit on: of each language at most SAMPLE, without those held out and without repeated rows.

    Twice as many are expected to have a hash below a bound that the language's count gives; so few rows are ranked.
    """
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).alias("h"))
    folder = common.scratch(docs.sparkSession, "languages")
    counts = common.few(usable.groupBy("lang").count(), f"{folder}/counts")  # a row per language
    near = usable.select("lang", "h", F.octet_length("text").alias("size")).join(counts, "lang").where(F.col("h") / float(1 << 62) < 2 * SAMPLE / F.col("count"))
    order = Window.partitionBy("lang").orderBy("h")
    share = F.lit(TOTAL) / F.greatest(F.lit(1), F.lit(counts.count()))
    once = near.groupBy("lang", "h").agg(F.max("size").alias("size")).withColumn("rank", F.row_number().over(order)).where(f"rank <= {SAMPLE}")
    sized = once.withColumn("bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # SAMPLE rows a language
    picked = common.few(sized.where((F.col("rank") == 1) | (F.col("bytes") <= share)).select("lang", "h"), f"{folder}/picked")
    return usable.join(picked, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language, from documents (doc_id, text, lang) that aren't held out; in the order of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.list_(pa.binary()))], ["lang", "pieces"])

    held: dict[str, set[bytes]] = defaultdict(set)
    for r in sampled(docs).mapInArrow(run, "lang string, pieces array<binary>").toLocalIterator():  # TOTAL bytes, or a document a language
        held[r["lang"]].update(map(bytes, r["pieces"]))
    return {lang: b"\n".join(sorted(held[lang], key=_digest)) for lang in sorted(held)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.coders = list(dictionaries), []
        for content in dictionaries.values():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ("und", 0.0) without letters or without languages."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        body = letters(text) or text.encode()
        blocks = [body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
        sizes = [sum(len(coder.compress(x)) for x in blocks) for coder in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return self.langs[best], 1 - sizes[best] / second


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs plus lang_pred, score and rejected; lang_pred is `und`, and rejected, for null texts and those without letters.

    Columns of these names are replaced. Repeated rows get the same, an empty table gives no rows; without any dictionary all
    are `und`. A long text is compressed block by block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # TOTAL bytes at most
    kept = docs.drop("lang_pred", "score", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in common.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = [classifier.predict(t) for t in texts]
            narrow = [x == "und" or s < MARGIN for x, s in found]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array(narrow, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema_plus(kept, lang_pred="string", score="double", rejected="boolean"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text, lang).

    Null and empty texts are `und`, a null doc_id isn't held out; ties go to the first language by name. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
