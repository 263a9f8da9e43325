"""Tables that change together, a batch at a time.

A batch writes each of its tables to a folder of its own and becomes visible by one manifest, a
small file that names the run and its tables. The manifest is created exclusively:
of two writers of one batch one wins, and a batch that is repeated changes nothing. A writer that
dies before its manifest leaves files that no reader looks at. Readers see all tables of a batch
or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class BatchStore:
    """Tables under ``root``, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(configuration)

    def _manifest(self, batch: str):
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"not a name for a batch: {batch!r}")
        return self._path(f"{self.root}/commits/{batch}.json")

    def is_committed(self, batch: str) -> bool:
        return self._read(self._manifest(batch)) is not None

    def _read(self, path) -> dict | None:
        """A manifest; None if there is none, or one whose writer has not finished it."""
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]]) -> dict:
        """Write a batch's tables to a folder nobody reads yet; its manifest."""
        run = uuid.uuid4().hex
        for name, table in tables.items():
            writer = table.write.mode("errorifexists")
            if partition_by.get(name):
                writer = writer.partitionBy(*partition_by[name])
            writer.parquet(self._folder(name, run))
        return {"run": run, "tables": sorted(tables)}

    def _folder(self, name: str, run: str) -> str:
        return f"{self.root}/{name}/batch_run={run}"

    def publish(self, batch: str, manifest: dict) -> bool:
        """Make a written batch visible; False, and its files gone, if another was first."""
        data = (json.dumps(manifest) + "\n").encode()
        path = self._manifest(batch)
        try:
            stream = self._files.create(path, False)
        except Exception as error:
            if "AlreadyExists" not in str(error) and "exists" not in str(error):
                raise
            for name in manifest["tables"]:
                self._files.delete(self._path(self._folder(name, manifest["run"])), True)
            return False
        stream.write(data)
        stream.close()
        return True

    def commit(
        self, batch: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None
    ) -> bool:
        """Write and publish; False if the batch was committed before."""
        if self.is_committed(batch):
            return False
        return self.publish(batch, self.write(tables, partition_by or {}))

    def manifests(self) -> dict[str, dict]:
        """Committed batches by name: one small file each, whatever their data."""
        folder = self._path(f"{self.root}/commits")
        if not self._files.exists(folder):
            return {}
        names = [str(f.getPath().getName()) for f in self._files.listStatus(folder)]
        names = sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and n[0] not in "._")
        found = {name: self._read(self._manifest(name)) for name in names}
        return {name: manifest for name, manifest in found.items() if manifest is not None}

    def read(self, name: str, schema: str) -> DataFrame:
        """A table over all committed batches, in the columns of ``schema`` (DDL)."""
        wanted = StructType.fromDDL(schema)
        folders = [self._folder(name, m["run"]) for m in self.manifests().values() if name in m["tables"]]
        if not folders:
            return self.spark.createDataFrame([], wanted)
        read = self.spark.read.schema(wanted).option("basePath", f"{self.root}/{name}")
        return read.parquet(*folders).select(*wanted.fieldNames())
