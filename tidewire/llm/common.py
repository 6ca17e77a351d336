"""Scratch tables in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows at most: texts can be long, and Python workers hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs in one process, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables that cut lineage: written to the shared folder and read again, so a lost executor costs nothing.

    ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        bounded_batches(spark)
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        # the table holds all that the shuffles led to, so their files can go once it is written
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEAN_UP, before) if before is not None else self.spark.conf.unset(CLEAN_UP)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _at(self, path: str):
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Tables that are whole: their writer has marked them."""
        root, files = self._at(self.root)
        found = [x.getPath().getName() for x in files.listStatus(root)] if files.exists(root) else []
        return sorted(x for x in found if files.exists(self._at(f"{self.path(x)}/_SUCCESS")[0]))

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._at(self.path(name))
            files.delete(path, True)


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: Column) -> Column:
    """128-bit key of a text: rows with equal texts have equal keys."""
    return F.md5(column)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), 0)


def in_blocks(items: Column, size: int = 128) -> Column:
    """An array as an array of arrays of ``size`` items; the last may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1), lambda b: F.slice(items, b * size + 1, F.lit(size)))


def starts_of(sizes: Column) -> Column:
    """Sum of the items before each item of an array of ints, summed in blocks: long arrays take little more than linear time."""

    def total(own: Column) -> Column:
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, total)
        before = let(sums, lambda t: F.transform(t, lambda _, b: total(F.slice(t, 1, b))))
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda own, b: F.transform(own, lambda _, i: F.get(at, b) + total(F.slice(own, 1, i))))))

    none = F.array().cast("array<int>")
    return let(sizes, lambda s: F.when(F.size(s) > 0, let(in_blocks(s), summed)).otherwise(none))
