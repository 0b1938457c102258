"""Tables whose versions are committed as a whole.

Data files are written first, to a folder of their own; a version exists once its manifest, a file of a few hundred bytes, is renamed to its number.
A rename to a number that is taken fails, so of two writers that begin at one version only the first commits, and readers see a version entirely
or not at all. A job that dies leaves files that no manifest names, which vacuum() removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from peerlens.operators import linkage

from .sinks import file_system, write_small


class Conflict(Exception):
    """Another writer has committed the version that was to be written."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self._at = file_system(spark, path)

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/versions")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict:
        (line,) = self.spark.read.text(f"{self.path}/versions/{version:020d}.json").collect()
        return json.loads(line["value"])

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last one if none is named."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.path} has no version {version if version is not None else 0}")
        m = self.manifest(known[-1] if version is None else version)
        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(*[f"{self.path}/{p}" for p in m["parts"]])

    def commit(self, df: DataFrame, append: bool = False, after: int | None = None) -> int:
        """Writes df as the version after `after` (the last one by default), with the parts of that one if it is an append; the new number."""
        known = self.versions()
        last = (known[-1] if known else 0) if after is None else after
        part = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        parts = [*(self.manifest(last)["parts"] if append and last else []), part]
        temporary, final = self._at(f"{self.path}/_{uuid.uuid4().hex}"), self._at(f"{self.path}/versions/{last + 1:020d}.json")
        write_small(self.fs, temporary, json.dumps({"version": last + 1, "parts": parts, "schema": df.schema.jsonValue()}))
        self.fs.mkdirs(final.getParent())
        jvm, none = self.spark._jvm, self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, none)
        except Exception as e:
            self.fs.delete(temporary, False)
            self.fs.delete(self._at(f"{self.path}/{part}"), True)
            if last + 1 in self.versions():
                raise Conflict(f"version {last + 1} of {self.path} exists") from e
            raise
        return last + 1

    def change(self, made: Callable[[DataFrame], DataFrame], tries: int = 3) -> int:
        """Commits made(last version); after a conflict it is made again of the version that was committed meanwhile."""
        for left in reversed(range(tries)):
            last = self.versions()[-1]
            try:
                return self.commit(made(self.read(last)), after=last)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def upsert(self, new: DataFrame, key: str, policies: dict[str, str], tries: int = 3) -> int:
        return self.change(lambda old: linkage.upsert(old, new, key, policies), tries)

    def vacuum(self, keep: int = 2) -> None:
        """Forgets all but the last `keep` versions, with the data that only they or no version names. No writer may be at work."""
        known = self.versions()
        for v in known[:-keep]:
            self.fs.delete(self._at(f"{self.path}/versions/{v:020d}.json"), False)
        named = {p for v in known[-keep:] for p in self.manifest(v)["parts"]}
        for s in self.fs.listStatus(self._at(f"{self.path}/data")):
            if f"data/{s.getPath().getName()}" not in named:
                self.fs.delete(s.getPath(), True)
