"""Readers and sinks for logs, dimensions and reports."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import count, takewhile
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Columns of the raw log.
LOG_COLUMNS = "message_id campaign_id message_type client_id channel category platform email_provider stream date sent_at is_opened is_clicked is_unsubscribed is_hard_bounced is_blocked is_purchased purchased_at opened_first_time_at clicked_first_time_at unsubscribed_at complained_at".split()

#: Columns of the dimensions' files.
DIMENSIONS = {"campaigns": "id:long campaign_type:string channel:string topic:string started_at:string finished_at:string", "clients": "client_id:long first_purchase_date:string", "holidays": "date:string is_holidays:int"}


def read_log_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV log, everything as text, pruned to the columns asked for that it has."""
    header = spark.read.text(path).limit(1).collect()
    names = [c.strip().strip('"').lstrip("\ufeff") for c in header[0][0].split(",")] if header else LOG_COLUMNS
    rows = spark.read.option("header", True).schema(StructType([StructField(c, StringType()) for c in names])).csv(path)
    return rows.select([c for c in (columns or names) if c in names])


def read_log(spark: SparkSession, path: str, columns: list[str] | None = None, skip_corrupt: bool = False) -> DataFrame:
    """A log in Parquet (a file or a folder of parts) or, by its ending, CSV; corrupt Parquet files can be skipped."""
    if path.rstrip("/").endswith(".csv"):
        return read_log_csv(spark, path, columns)
    rows = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("recursiveFileLookup", True).parquet(path)
    return rows.select([c for c in columns if c in rows.columns]) if columns else rows


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV in UTF-8 with a header line in each part, which bom begins with a byte order mark."""
    named = df.withColumnRenamed(df.columns[0], f"\ufeff{df.columns[0]}") if bom else df
    named.write.mode("overwrite").option("header", True).csv(path)


def read_dimension(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A dimension's CSV file in the types of DIMENSIONS; what doesn't fit its type is null."""
    rows = read_log_csv(spark, path)
    kinds = {c: kind for c, kind in (x.split(":") for x in DIMENSIONS[name].split())}
    return rows.select(*(F.col(c).try_cast(kinds.get(c, "string")).alias(c) for c in rows.columns))


def write_report(df: DataFrame, path: str) -> None:
    """A small nested report as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """A small column of JSON texts as one file of concatenated documents."""
    rows.coalesce(1).write.mode("overwrite").text(path)


def counted_parts(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """path, size, modified, n of each Parquet file under path; counts of unchanged files are taken from folder, where all are kept.

    Files that can't be read aren't counted.
    """
    key = ["path", "size", "modified"]
    meta = lambda df: df.select(*(F.col(f"_metadata.file_{c}").alias(n) for c, n in (("path", "path"), ("size", "size"), ("modification_time", "modified"))))
    rows = meta(spark.read.option("ignoreCorruptFiles", True).schema("message_id string").parquet(path))
    known = [*takewhile(lambda x: exists(spark, x), (f"{folder}/{i}" for i in count()))]
    schema = "path string, size long, modified timestamp, n long"
    done = spark.read.schema(schema).parquet(*known) if known else spark.createDataFrame([], schema)
    new = rows.join(F.broadcast(done), key, "left_anti").groupBy(*key).agg(F.count("*").alias("n"))  # a row per file
    write_parquet(new, f"{folder}/{len(known)}")
    return spark.read.schema(schema).parquet(*known, f"{folder}/{len(known)}")


#: Bytes that a Parquet file without rows has at most: it is nothing but a footer.
ROWLESS = 4 << 20


def _rowless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path of each file (path, content) that is Parquet and has no rows."""
    for batch in batches:
        found = []
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            try:
                if pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata.num_rows == 0:
                    found.append(path.as_py())
            except (OSError, pa.ArrowException):
                continue
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])


def corrupt_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path of each file under path that can't be read as Parquet; one that has no rows can."""
    good = spark.read.option("ignoreCorruptFiles", True).schema(schema).parquet(path).select(F.col("_metadata.file_path").alias("path")).distinct()
    listed = spark.read.format("binaryFile").load(path).select("path")
    plain = lambda df: df.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    rowless = [r[0] for r in plain(listed).join(plain(good), "path", "left_anti").collect()]  # a path for each file without rows
    if not rowless:
        return spark.createDataFrame([], "path string")
    few = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", x) for x in rowless]).where(F.col("length") <= ROWLESS)
    empty = few.where(F.substring("content", 1, 4) == F.lit(b"PAR1")).select("path", "content").mapInArrow(_rowless, "path string")
    return spark.createDataFrame([(x,) for x in rowless], "path string").join(plain(empty), "path", "left_anti")


def damage_row_group(spark: SparkSession, folder: str, number: int) -> None:
    """Overwrite the pages of a row group of the folder's first Parquet file by name, a small one, to try out what reads damaged logs."""
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    file = min((p for p in (f.getPath() for f in system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))) if p.getName().endswith(".parquet")), key=lambda p: p.getName())
    data = bytearray(spark.read.format("binaryFile").load(file.toString()).first()["content"])
    column = pq.ParquetFile(pa.BufferReader(bytes(data))).metadata.row_group(number).column(0)
    begin = min(x for x in (column.data_page_offset, column.dictionary_page_offset) if x is not None)
    data[begin : begin + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    out = system.create(file, True)
    out.write(data)
    out.close()


def resumed(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The finished table at path, else what build gives, written there."""
    if not exists(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at path, so that a study can go on where it stopped."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def parse_documents(text: str) -> dict:
    """All objects of a text of concatenated JSON documents, joined; junk between them is skipped, later keys win."""
    found, at, decoder = {}, text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            found |= value
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return found


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """experiment, r (of this schema) for each object of a report file."""
    whole = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    rows = [(k, json.dumps(v)) for k, v in parse_documents(whole).items()]
    return spark.createDataFrame(rows, "experiment string, body string").select("experiment", F.from_json("body", schema).alias("r"))


def resolve(name: str, candidates: list[str], env: dict[str, str], default: str, there: Callable[[str], bool] = lambda c: Path(c).exists()) -> str:
    """A path from the environment, else the first candidate that is there, else the default."""
    return env.get(name) or next((c for c in candidates if there(c)), default)
