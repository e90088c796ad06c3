"""Shared helpers: table access, the shared scratch folder, fixed ASCII classes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word class of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the files stay outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only in local mode may that setting be missing; a folder of our own is used then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/tracewright"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go with its end, as nothing reads them again; the setting is put back."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_END, before) if before else spark.conf.unset(SHUFFLES_END)


def _written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """df as a table at path.  Its shuffle files go when the table stands."""
    with shuffles_end(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, losing executors costs nothing."""
    return _written(df, scratch(df.sparkSession), **options)


class Tables:
    """Named tables of one computation, stored in one folder; drop() removes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.shared = spark, scratch(spark), []

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        return _written(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.folder}/{name}")

    def share(self, value: Any) -> Broadcast:
        """value for all tasks, until drop_all()."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def drop_all(self) -> None:
        """Nothing of the computation is read any more."""
        self._delete(self.folder)
        for x in self.shared:
            x.destroy()
        self.shared = []

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python some megabytes at a time, however long they are.  A setting of the user's own stays."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # Spark's default
        spark.conf.set(BATCH_BYTES, "4m")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text being empty; other columns, whatever their names, stay out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
