"""Numbered records in a folder, each created once: whoever comes second is told so.

A record is one JSON line in a file named by its number.  It is complete before it has its name, and gets it only
if nobody has it: by a hard link where the folder is a local or mounted one, else by a rename without
overwriting, which the file system of a cluster does in one step.  (An object store without conditional
writes gives no such promise.)
"""

import json
import os
import uuid

from pyspark.sql import SparkSession

from ..sources.scratch import delete_folder


class RecordExists(Exception):
    """Another job has created this record."""


class Records:
    """Records in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _hadoop(self, folder: str | None = None):
        """(class holder, path of the folder, its file system)"""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(folder or self.folder)
        return hadoop, path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    @staticmethod
    def _name(number: int) -> str:
        return f"{number:020d}.json"

    def numbers(self) -> list[int]:
        """The numbers of all records, rising."""
        names = [name for name, _ in self.listed(self.folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        """A record; None if it is not there."""
        hadoop, path, system = self._hadoop()
        file = hadoop.Path(path, self._name(number))
        if not system.exists(file):
            return None
        stream = system.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, number: int, record: dict) -> None:
        """Write a record; raises RecordExists, and changes nothing, if there is one of this number."""
        hadoop, path, system = self._hadoop()
        system.mkdirs(path)
        target, text = self._name(number), json.dumps(record)
        draft = f".draft-{uuid.uuid4().hex}"
        if system.getScheme() == "file":
            home = path.toUri().getPath()
            with open(f"{home}/{draft}", "x", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(f"{home}/{draft}", f"{home}/{target}")
            except FileExistsError:
                raise RecordExists(f"{self.folder}/{target}") from None
            finally:
                os.unlink(f"{home}/{draft}")
            return
        stream = system.create(hadoop.Path(path, draft), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        context = hadoop.FileContext.getFileContext(system.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        plain = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # never overwrite
        try:
            context.rename(hadoop.Path(path, draft), hadoop.Path(path, target), plain)
        except Exception as error:
            system.delete(hadoop.Path(path, draft), False)
            if system.exists(hadoop.Path(path, target)):
                raise RecordExists(f"{self.folder}/{target}") from error
            raise

    def delete(self, number: int) -> None:
        delete_folder(self.spark, f"{self.folder}/{self._name(number)}")

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds) of what lies in a folder; nothing if it is not there."""
        _, path, system = self._hadoop(folder)
        if not system.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(path))
