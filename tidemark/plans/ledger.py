"""A study's finished parts and fitted models, found again by what made them.

An entry's name ends in a digest of its parameters and of the study's inputs: the same work is found, changed parameters or
data are not. A table counts once Spark's committer has marked it finished. A model is saved under a name of its own and then
renamed, which is one step, so a study that is stopped at any time finds whole entries only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidemark.sources import files


def digest_of(df: DataFrame) -> str:
    """A digest of a table's columns and rows that doesn't depend on their order; one pass."""
    hashed = F.xxhash64(*(F.to_json(f"`{f.name}`") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema))
    n, bits, low = df.select(hashed.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF))).first()
    return f"{df.schema.simpleString()}:{n}:{bits}:{low}"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, inputs: str):
        """inputs: what the study reads, such as digest_of() its table."""
        self.spark, self.folder, self.inputs = spark, folder.rstrip("/"), inputs
        self.reused: list[str] = []

    def below(self, name: str) -> Ledger:
        """The same, for a part of the study; what it reuses counts here as well."""
        part = Ledger(self.spark, f"{self.folder}/{name}", self.inputs)
        part.reused = self.reused
        return part

    def path(self, name: str, params: dict) -> str:
        key = hashlib.sha256(json.dumps([self.inputs, params], sort_keys=True, default=str).encode()).hexdigest()[:24]
        return f"{self.folder}/{name}-{key}"

    def table(self, name: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
        """The finished table of this name and these parameters, else what build gives, written."""
        path = self.path(name, params)
        if files.exists(self.spark, path):
            self.reused.append(name)
        return files.resumed(self.spark, path, build)

    def model(self, name: str, params: dict, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """The saved model, else what fit gives; scored as loaded from disk in both cases."""
        path = self.path(name, params)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if system.exists(place):
            self.reused.append(name)
        else:
            draft = f"{path}.{uuid.uuid4().hex}"
            fit().save(draft)
            if not system.rename(self.spark._jvm.org.apache.hadoop.fs.Path(draft), place):
                raise OSError(f"{draft} can't be renamed to {path}")
        return PipelineModel.load(path)
