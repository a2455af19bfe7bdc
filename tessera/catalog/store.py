"""Small files of the catalog on any file system that Spark reads."""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import SparkSession

from tessera.sql.errors import ConflictError

#: File systems of objects: a file appears whole when it is closed, and the store itself refuses a second one (S3A: with
#: conditional creation on, its default where the store has it).
OBJECTS = frozenset("s3a s3 gs abfs abfss wasb wasbs oss".split())


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, without those that begin with a dot or an underscore."""
        at = self.path(folder)
        found = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(n for n in found if n[0] not in "._")

    def ages(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder with seconds since their last change."""
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path(folder))]

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> None:
        """Exclusive: raises ConflictError if the file is there already. Readers see whole files only.

        The text goes to a file of its own first, which then gets the name in one step that fails if it is taken: a hard
        link on local disks, a rename on HDFS; object stores create the file itself so.
        """
        folder, _, last = name.rpartition("/")
        final, raw = self.path(name), bytearray(json.dumps(value).encode())
        self.fs.mkdirs(final.getParent())
        real = self.fs.resolvePath(final.getParent())
        scheme = real.toUri().getScheme()
        if scheme in OBJECTS:
            with self.taken(name):
                self.write(self.fs.createFile(final).overwrite(False).build(), raw)
            return
        own = self.path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        self.write(self.fs.create(own, False), raw)
        try:
            if scheme == "file":
                to = lambda p: self.jvm.java.io.File(real.toUri().getPath(), p.getName()).toPath()
                with self.taken(name):
                    self.jvm.java.nio.file.Files.createLink(to(final), to(own))
            elif not self.fs.rename(own, final):
                raise self.conflict(name)
        finally:
            self.fs.delete(own, False)

    @staticmethod
    def write(stream, raw: bytearray) -> None:
        try:
            stream.write(raw)
        finally:
            stream.close()

    @staticmethod
    def conflict(name: str) -> ConflictError:
        return ConflictError(f"{name} was committed by another transaction")

    @contextlib.contextmanager
    def taken(self, name: str):
        try:
            yield
        except Exception as e:  # py4j wraps what the file system throws
            if "FileAlreadyExists" in str(e) or "PreconditionFailed" in str(e) or "already exists" in str(e):
                raise self.conflict(name) from None
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
