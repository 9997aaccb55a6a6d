"""What the operators share: table reading, shared scratch tables, Arrow batches in slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tidemark.sources.scratch import scratch, written  # noqa: F401


#: Bytes of a batch that goes to a Python worker. By default 10,000 rows go at once, and JVM and worker hold several batches of them.
BATCH_BYTES = 4 << 20
#: Rows of texts that are read from Parquet at once. By default 4,096 are; arrays for so many long texts are tens of MB each, and the heap grows by them.
READ_ROWS = 256


def small_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, folder: str, most: int = 200_000) -> DataFrame:
    """df as a written table, to be broadcast if a count shows that it has `most` rows at most; they must be short."""
    df = written(df, folder)
    return F.broadcast(df) if df.count() <= most else df


#: Bits of a sieve; it has a 64th as many rows at most.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, key: str, folder: str) -> DataFrame:
    """A table of bits (word, bits), SIEVE_BITS at most, of the column key (a hash) of keys; for sifted()."""
    at = F.pmod(key, F.lit(SIEVE_BITS))
    words = keys.select((at / 64).cast("long").alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b"))
    return written(words.groupBy("__word").agg(F.bit_or("b").alias("__bits")), folder)


def sifted(df: DataFrame, key: str, words: DataFrame, caught: bool) -> DataFrame:
    """The rows of df whose hash (the column key) is among the sieve's, or shares a bit with one that is; else those that surely aren't.

    So only what may match is dealt out for an exact join; the sieve itself is broadcast, as its size is bounded.
    """
    at = F.pmod(key, F.lit(SIEVE_BITS))
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("__bits"), (at % 64).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    met = df.withColumn("__word", (at / 64).cast("long")).join(F.broadcast(words), "__word", "left")
    return met.where(hit if caught else ~hit).drop("__word", "__bits")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of about most_bytes in the text column (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= most_bytes:
            yield batch
            continue
        begin = size = 0
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            if i > begin and size + (n or 0) > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def packed(df: DataFrame, column: str) -> DataFrame:
    """df with a text column compressed, for dealing out; null stays null. unpacked() gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in slices(iter([whole]), column):
                yield _changed(batch, column, pa.array([None if t is None else pack.compress(t) for t in raw(batch, column)], pa.binary()))

    return df.mapInArrow(run, _with_type(df, column, "binary"))


def unpacked(df: DataFrame, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in slices(iter([whole]), column, 1 << 20):
                texts = [None if t is None else unpack.decompress(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
                yield _changed(batch, column, pa.array(texts, pa.binary()).cast(pa.string()))

    return df.mapInArrow(run, _with_type(df, column, "string"))


def _changed(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values if c == column else batch.column(i) for i, c in enumerate(batch.schema.names)], batch.schema.names)


def _with_type(df: DataFrame, column: str, kind: str) -> StructType:
    return StructType([StructField(f.name, DataType.fromDDL(kind)) if f.name == column else f for f in df.schema])


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def schema_plus(df: DataFrame, **types: str) -> StructType:
    """df's schema with more columns."""
    out = StructType(list(df.schema.fields))
    for name, kind in types.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out
