"""Versioned tables of immutable files, and processing of what changed between versions.

A version is a manifest: the data files it is made of and the deletion vectors
(file, row index) that apply to them. A commit writes new files first and then
publishes its manifest under the next number, which only one commit can take.
What a commit wrote but never published is invisible. ``changes`` follows the
manifests from one version to another: added files, dropped files and new
deletion vectors yield record deltas, and nothing else is read. Versions that
only rewrite files (``compact``) change no record. A record that was both
added and removed on the way nets out.

A job that consumes a table keeps the version it has processed in the manifest
of its own output, so output and progress are published together: a run that
fails before is repeated whole, one that succeeded is never repeated.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another commit published this version first."""


@dataclass(frozen=True)
class Manifest:
    """One version: file names, folders of deletion vectors, processed versions of other tables, and whether records changed in it."""

    version: int
    files: tuple[str, ...] = ()
    deletions: tuple[str, ...] = ()
    processed: dict[str, int] = field(default_factory=dict)
    changed: bool = True


class VersionedTable:
    """A table below ``path`` on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests -------------------------------------------------------------

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def latest(self) -> Manifest:
        """The newest published version; version 0 is the empty table."""
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return Manifest(0)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return self.manifest(max(numbers)) if numbers else Manifest(0)

    def _next(self) -> int:
        """The number of the version that is published next."""
        return self.latest().version + 1

    def manifest(self, version: int) -> Manifest:
        if version == 0:
            return Manifest(0)
        stream = self._fs.open(self._at(self._name(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        d = json.loads(text)
        return Manifest(d["version"], tuple(d["files"]), tuple(d["deletions"]), d["processed"], d.get("changed", True))

    def _publish(self, m: Manifest) -> Manifest:
        """Put the manifest in its place, whole and only if the number is free.

        On a file system of the machine or mounted on it a hard link does that
        in one step, or without links a file that is created only if there is
        none; elsewhere a rename that doesn't overwrite, which is atomic on
        HDFS. A store without any of these must have one writer at a time.
        """
        draft, name = f"{self.path}/drafts/{uuid.uuid4().hex}", self._name(m.version)
        out = self._fs.create(self._at(draft), False)
        try:
            out.write(bytearray(json.dumps(asdict(m)).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._at(f"{self.path}/manifests"))
        try:
            if self._fs.getScheme() == "file":
                here = lambda p: self._at(p).toUri().getPath()
                try:
                    os.link(here(draft), here(name))
                except FileExistsError:
                    raise
                except OSError:  # no links here
                    with open(here(name), "xb") as f:
                        f.write(json.dumps(asdict(m)).encode())
            else:
                hadoop = self.spark._jvm.org.apache.hadoop.fs
                context = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
                context.rename(self._at(draft), self._at(name), none)
        except Exception as e:
            if self._fs.exists(self._at(name)):
                raise CommitConflict(f"version {m.version} exists") from e
            raise
        finally:
            self._fs.delete(self._at(draft), False)
        return m

    # data --------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str) -> tuple[str, list[str]]:
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{folder}"))]
        return folder, sorted(f"{folder}/{n}" for n in names if n.endswith(".parquet"))

    def _scan(self, files: tuple[str, ...] | list[str]) -> DataFrame:
        """Rows of the files with their places."""
        if not files:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_row"))
        df = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))
        return df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, folders: tuple[str, ...] | list[str]) -> DataFrame | None:
        return self.spark.read.schema("_file string, _row long").parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def _alive(self, files, folders) -> DataFrame:
        rows, dead = self._scan(files), self._vectors(folders)
        return rows if dead is None else rows.join(dead, ["_file", "_row"], "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        m = self.latest() if version is None else self.manifest(version)
        return self._alive(m.files, m.deletions).drop("_file", "_row")

    def commit(self, added: DataFrame | None = None, removed: DataFrame | None = None, keys: list[str] | None = None, processed: dict[str, int] | None = None, replace: bool = False) -> Manifest:
        """Publish the next version: without the rows whose keys are in ``removed``, or with ``replace`` without all rows, and with the rows ``added``."""
        last = self.latest()
        files, deletions = ([], []) if replace else (list(last.files), list(last.deletions))
        if removed is not None and files:
            gone = self._alive(last.files, last.deletions).join(removed.select(*keys).distinct(), keys, "left_semi")
            deletions.append(self._write(gone.select("_file", "_row"), "deletions")[0])
        if added is not None:
            files += self._write(added.select(*self.schema.fieldNames()), "data")[1]
        changed = bool(added is not None or removed is not None or replace)
        return self._publish(Manifest(self._next(), tuple(files), tuple(deletions), last.processed | (processed or {}), changed))

    def compact(self) -> Manifest:
        """Publish the same rows in new files without deletion vectors."""
        last = self.latest()
        return self._publish(Manifest(self._next(), tuple(self._write(self.read(last.version), "data")[1]), (), last.processed, False))

    def _net(self, deltas: DataFrame) -> DataFrame:
        """Deltas without the pairs of one added and one removed equal record."""
        names = self.schema.fieldNames()
        plain = not any("map" in f.dataType.simpleString() for f in self.schema)
        key = [F.col(n) for n in names] if plain else [F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("_key")]
        rest = [] if plain else [F.first(n).alias(n) for n in names]
        n = F.sum(F.when(F.col("change") == "added", 1).otherwise(-1))
        left = deltas.groupBy(*key).agg(n.alias("_n"), *rest).filter("_n != 0")
        change = F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change")
        return left.select(*names, change, F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_k")).drop("_k")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Record deltas (the table's columns, change = added or removed) between two versions, from what their manifests and those between say."""
        last = self.latest() if until is None else self.manifest(until)
        before = self.manifest(since)
        new: list[str] = []
        out: list[DataFrame] = []
        for version in range(since + 1, last.version + 1):
            m = self.manifest(version)
            if m.changed:
                had, has = set(before.files), set(m.files)
                new += [f for f in m.files if f not in had]
                if dropped := [f for f in before.files if f not in has]:
                    out.append(self._alive(dropped, before.deletions))
                vectors = [d for d in m.deletions if d not in set(before.deletions)]
                if vectors and had & has:
                    out.append(self._scan([f for f in before.files if f in has]).join(self._vectors(vectors), ["_file", "_row"], "left_semi"))
            before = m
        added = self._scan(new).withColumn("change", F.lit("added")).drop("_file", "_row")
        if not out:
            return added
        deltas = added
        for part in out:
            deltas = deltas.unionByName(part.withColumn("change", F.lit("removed")).drop("_file", "_row"))
        return self._net(deltas)


def run_incremental(source: VersionedTable, target: VersionedTable, work: Callable[[DataFrame], DataFrame], removed_keys: list[str] | None = None) -> Manifest:
    """Process what source changed since target's last commit, and commit result and progress together.

    ``work`` turns record deltas into rows to add. With ``removed_keys``, rows
    of target with the keys of changed records are deleted first.
    """
    done = target.latest()
    now = source.latest()
    since = done.processed.get(source.path, 0)
    if now.version == since:
        return done
    delta = source.changes(since, now.version)
    return target.commit(work(delta), delta if removed_keys else None, removed_keys, {source.path: now.version})
