"""Small files in any store that Spark reads, from the driver: entries that are written once, replaced files, moves."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """Hadoop's file system of a path; for metadata of a few kB, never for rows."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """What a folder has, sorted; nothing if there is none."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(folder)))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self.path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _whole(self, name: str, found: dict) -> str:
        """Write beside ``name``, so that what has that name is never a part of it."""
        folder, _, last = name.rpartition("/")
        beside = f"{folder}/.{last}.{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(beside), True)
        stream.write(bytearray(json.dumps(found, indent=1).encode()))
        stream.hsync()
        stream.close()
        return beside

    def put(self, name: str, found: dict) -> bool:
        """Write a file unless there is one of that name: False then. In one step where the store renames in one step without replacing."""
        beside = self._whole(name, found)
        if not self._rename(beside, name, False):
            self.delete(beside)
            return False
        return True

    def replace(self, name: str, found: dict) -> None:
        self._rename(self._whole(name, found), name, True)

    def move(self, source: str, to: str) -> None:
        """Move a file; one that was moved before counts as done."""
        if self.exists(source):
            self._fs.mkdirs(self.path(to.rpartition("/")[0]))
            self._rename(source, to, True)
        elif not self.exists(to):
            raise FileNotFoundError(source)

    def _rename(self, source: str, to: str, over: bool) -> bool:
        from py4j.protocol import Py4JJavaError

        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, int(over))
        if over:
            options[0] = kind.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self.path(source), self.path(to), options)
        except Py4JJavaError as error:
            if over or "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self.path(folder))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
