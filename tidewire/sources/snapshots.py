"""A table of whole versions in a folder that all executors share: one atomic pointer, batches that do no harm when they come again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """Versions are folders of Parquet files; the highest whole pointer file names the one that counts.

    A version is written first, then its pointer, as a file that is moved into place. A run that ends between the two
    leaves a folder that nobody reads and the next run writes anew. The pointer also has the number of the last batch that
    went in, so a batch that comes again (its number is no greater) changes nothing. Versions before the last ``keep`` are
    dropped; readers that started on an older one must end before. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keep: int = 2):
        self.spark, self.folder, self.schema, self.keep = spark, folder, schema, keep

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        path, files = self._at("pointers")
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(x) for x in names if x.isdigit())

    def _pointer(self, version: int) -> dict:
        path, files = self._at(f"pointers/{version}")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self) -> dict:
        """version and batch that count now; version 0 is an empty table."""
        known = self._pointers()
        return {"version": known[-1]} | self._pointer(known[-1]) if known else {"version": 0, "batch": None}

    def read(self) -> DataFrame:
        version = self.state()["version"]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/version-{version}") if version else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: int, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Writes ``change`` of the current rows as the next version, unless the batch is in already; says whether it was written."""
        now = self.state()
        if now["batch"] is not None and batch <= now["batch"]:
            return False
        version = now["version"] + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        change(self.read()).select(*columns).write.mode("overwrite").parquet(f"{self.folder}/version-{version}")
        self._publish(version, batch)
        for old in self._pointers()[: -self.keep]:
            for name in (f"pointers/{old}", f"version-{old}"):
                path, files = self._at(name)
                files.delete(path, True)
        return True

    def _publish(self, version: int, batch: int) -> None:
        draft, files = self._at(f"pointers/_{version}")
        stream = files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"batch": batch}).encode()))
        finally:
            stream.close()
        if not files.rename(draft, self._at(f"pointers/{version}")[0]):
            raise OSError(f"version {version} of {self.folder} could not be published")
