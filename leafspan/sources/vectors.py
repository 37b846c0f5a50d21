"""A cache of computed vectors that several jobs and executors share: found by the content of texts, added to in versions that appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = "key string, text string, vector array<double>, bucket string, version string"


@dataclass(frozen=True)
class VectorCache:
    """Vectors of one model and dimension under a folder. Rows are addressed by a hash of their text and laid out by its first digits, so that a look-up reads
    the buckets it needs. A version counts once its row is in the list of versions, which is written last."""

    spark: SparkSession
    folder: str
    model: str
    dimension: int

    def _path(self, part: str) -> str:
        return f"{self.folder.rstrip('/')}/model={self.model}/dimension={self.dimension}/{part}"

    @staticmethod
    def key(text: Column) -> Column:
        return F.sha2(text, 256)

    def versions(self) -> list[str]:
        """Published versions; one for each add(), so few."""
        try:
            return sorted(r.version for r in self.spark.read.schema("version string").parquet(self._path("versions")).collect())
        except AnalysisException:  # nothing was published yet
            return []

    def known(self) -> DataFrame:
        """key, text, vector, bucket of all published rows; of a text that two versions have, one."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], DATA).drop("version")
        rows = self.spark.read.schema(DATA).option("basePath", self._path("data")).parquet(self._path("data")).where(F.col("version").isin(versions))
        return rows.groupBy("bucket", "key").agg(F.first("text").alias("text"), F.first("vector").alias("vector"))

    def missing(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """The distinct texts that have no vector yet: key, text. Nulls have none and need none."""
        own = texts.select(F.col(text_col).alias("text")).where("text is not null").distinct().withColumn("key", self.key(F.col("text")))
        return own.join(self.known().select("key"), "key", "left_anti")

    def add(self, vectors: DataFrame) -> int:
        """Add rows of text and vector as one version, and say how many. Vectors of another dimension are refused before anything is published; rows of
        a version that was not, as its job failed, are never read."""
        version = uuid.uuid4().hex
        key = self.key(F.col("text"))
        rows = vectors.select(key.alias("key"), "text", F.col("vector").cast("array<double>").alias("vector"), F.substring(key, 1, 2).alias("bucket"), F.lit(version).alias("version"))
        rows.repartition("bucket").write.partitionBy("version", "bucket").mode("append").parquet(self._path("data"))
        own = self.spark.read.schema(DATA).option("basePath", self._path("data")).parquet(self._path(f"data/version={version}")) if not vectors.isEmpty() else None
        if own is None:
            return 0
        n, bad = own.agg(F.count("*"), F.count_if(F.coalesce(F.size("vector") != self.dimension, F.lit(True)))).first()
        if bad:
            raise ValueError(f"{bad} vectors are not of dimension {self.dimension}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(self._path("versions"))
        return n

    def vectors(self, texts: DataFrame, compute: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
        """texts with a column vector; compute (key, text → text, vector) sees only texts that the cache lacks, and what it makes is added."""
        missing = self.missing(texts, text_col)
        if not missing.isEmpty():
            self.add(compute(missing))
        known = self.known().select(F.col("key").alias("__key"), "vector")
        return texts.join(known, self.key(F.col(text_col)) == F.col("__key"), "left").drop("__key")
