"""Small JSON files that one writer makes, whole or not at all, on any file system that Hadoop knows."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of such files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names of the files, in order; those still being written begin with an underscore and are left out."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for x in self._fs.listStatus(self._at("")) if not (n := x.getPath().getName()).startswith(("_", ".")))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def size(self, name: str) -> int:
        """Bytes of a file or folder in this one."""
        return self._fs.getContentSummary(self._at(name)).getLength()

    def claim(self, name: str, content: object) -> bool:
        """Make a file with this content; False if there is one of that name.  Of several writers, one succeeds."""
        self._fs.mkdirs(self._at(""))
        aside = self._at(f"_claim-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(json.dumps(content).encode())
        out.close()
        context = self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._at(name), plain)  # does not overwrite
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def content(self, name: str) -> object:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def contents(self) -> dict[str, object]:
        """All files with their content."""
        if not self.names():
            return {}
        rows = self.spark.read.text(self.path, wholetext=True).select("_metadata.file_name", "value").collect()
        return {r["file_name"]: json.loads(r["value"]) for r in rows}

    def delete(self, name: str = "") -> None:
        """Delete a file or folder in this one, or all of it."""
        self._fs.delete(self._at(name), True)
