"""Tables as numbered snapshots in one folder, committed by compare-and-set.

A snapshot is a folder of Parquet files and a small commit file that names it. Version n exists once ``_commits/n.json`` does; the
file is written aside and moved to its place by a rename that fails if the place is taken, so of several writers that started from
version n - 1 one commits and the others see a conflict, read the new version and apply their change again. Readers never see half a
snapshot, and a lost writer leaves only files that no commit names. Needs a file system whose rename is atomic and does not replace
(HDFS), or a local disk, where a hard link takes the place of the rename; object stores without such a rename are not supported.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed first, as often as there were tries."""


class Table:
    """A versioned table of rows with a key column."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commit_file(self, version: int) -> str:
        return f"{self.folder}/_commits/{version:012d}.json"

    def version(self) -> int:
        """The latest version; 0 before the first."""
        at = self._path(f"{self.folder}/_commits")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def commit(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._commit_file(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError(f"{self.folder} has no version")
        return self.spark.read.parquet(f"{self.folder}/{self.commit(version)['data']}")

    def put(self, rows: DataFrame, base: int) -> bool:
        """Commit rows as version base + 1; False if that version is taken, and then the rows' files are deleted."""
        data = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        aside, place = self._path(f"{self.folder}/_aside/{uuid.uuid4().hex}"), self._path(self._commit_file(base + 1))
        self._fs.mkdirs(place.getParent())
        out = self._fs.create(aside)
        out.write(json.dumps({"data": data, "base": base}).encode())
        out.close()
        if not self._fs.exists(place) and self._claim(aside, place):
            return True
        self._fs.delete(aside, False)
        self._fs.delete(self._path(f"{self.folder}/{data}"), True)
        return False

    def _claim(self, aside, place) -> bool:
        """Put aside at place if nothing is there: by rename, or on a local disk, whose rename replaces, by a hard link."""
        if self._fs.getScheme() != "file":
            return self._fs.rename(aside, place)
        java = self.spark.sparkContext._jvm.java
        local = lambda p: java.io.File(p.toUri().getPath()).toPath()
        try:
            java.nio.file.Files.createLink(local(place), local(aside))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        self._fs.delete(aside, False)
        return True

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 3, pause: float = 0.1) -> int:
        """Apply change to the latest rows and commit, again on the new rows after a conflict; the version committed."""
        for i in range(tries):
            base = self.version()
            if self.put(change(self.read(base)), base):
                return base + 1
            time.sleep(pause * (i + 1))
        raise Conflict(f"{self.folder}: {tries} tries lost")


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with those of new in place of rows of the same key, and as new rows; of several new ones of a key the last in column order."""
    cols = [c for c in rows.columns if c != key]
    one = new.groupBy(key).agg(F.max(F.struct(*cols)).alias("_n")).select(key, "_n.*").select(*rows.columns)
    return rows.join(one.select(key), key, "left_anti").unionByName(one)


def set_status(status: str, run_id: int, progress: dict[str, str] | None = None, now: str | None = None, error: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A change for Table.update over rows (run_id, status, progress map, started_at, completed_at, error): status with its time stamps.

    started_at is set by the first "crawling", completed_at by "complete" and "failed"; progress is merged, new entries winning.
    """

    def change(rows: DataFrame) -> DataFrame:
        own = F.col("run_id") == run_id
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        put = lambda old, new: F.when(own, new).otherwise(F.col(old))
        out = {"status": put("status", F.lit(status))}
        if progress:
            add = {**progress, "current_step": status}
            new = F.create_map(*[F.lit(x) for kv in add.items() for x in kv])
            old = F.map_filter(F.coalesce("progress", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*add))
            out["progress"] = put("progress", F.map_concat(old, new))
        if status == "crawling":
            out["started_at"] = put("started_at", F.coalesce("started_at", at))
        if status in ("complete", "failed"):
            out["completed_at"] = put("completed_at", at)
        if error:
            out["error"] = put("error", F.lit(error))
        return rows.withColumns(out)

    return change
