"""A commit log in a folder: numbered entries, each created if its number is free and never changed afterwards.

Whoever writes entry n has seen entries 0 to n - 1; of two who write the same number one is refused. That is all that claims and
fencing need: a holder whose lease ran out finds its next number taken by the one who took over, and cannot commit. Entries are
written beside and renamed into place without overwriting (on a local folder: linked), so none is ever read half. This needs a
file system whose rename without overwriting is atomic, as HDFS has.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        folder = self._fs.Path(path.rstrip("/"))
        self._system = folder.getFileSystem(self._conf)
        self.path = self._system.makeQualified(folder).toString()
        self._seen: dict[int, dict] = {}

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _place(self, temporary: str, name: str) -> bool:
        """Give a file its name unless another has it."""
        url = urlparse(self.path)
        if url.scheme == "file":
            local = unquote(url.path)
            try:
                os.link(f"{local}/{temporary}", f"{local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.remove(f"{local}/{temporary}")
            return True
        kind = getattr(self._fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._fs.FileContext.getFileContext(self._at(name).toUri(), self._conf).rename(self._at(temporary), self._at(name), options)
        except Exception as e:
            self._system.delete(self._at(temporary), False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def append(self, number: int, entry: dict) -> bool:
        """Whether the entry now is number ``number``; False if another is."""
        self._system.mkdirs(self._fs.Path(self.path))
        temporary, name = f".{uuid.uuid4().hex}.tmp", f"{number:012d}.json"
        if self._system.exists(self._at(name)):
            return False
        out = self._system.create(self._at(temporary), False)
        try:
            out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            out.close()
        if not self._place(temporary, name):
            return False
        self._seen[number] = entry
        return True

    def entries(self) -> list[dict]:
        """All entries in order. Entries never change, so only new ones are read."""
        if not self._system.exists(self._fs.Path(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self._system.listStatus(self._fs.Path(self.path)))
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]
        if numbers != list(range(len(numbers))):
            raise ValueError(f"the log at {self.path} lacks an entry")
        for k in numbers:
            if k not in self._seen:
                stream = self._system.open(self._at(f"{k:012d}.json"))
                try:
                    self._seen[k] = json.loads(self._io.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return [self._seen[k] for k in numbers]
