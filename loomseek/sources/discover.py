"""Finding source files below roots, and their digests.

Symbolic links are skipped, files and folders alike. Includes (none: all) and
excludes match the path below the root. A file below two roots is an error.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.config import Root
from loomseek.errors import ConfigurationError

SUFFIX = ".org"


def _selected(root: Root, path: str) -> bool:
    inside = os.path.relpath(path, root.path)
    wanted = not root.includes or any(re.search(p, inside) for p in root.includes)
    return wanted and not any(re.search(p, inside) for p in root.excludes)


def discover(roots: tuple[Root, ...]) -> list[tuple[str, str]]:
    """(path, root name) of every selected file, by path; for folders that the driver can list."""
    found: dict[str, str] = {}
    for root in roots:
        if not root.name or not os.path.isdir(root.path):
            raise ConfigurationError(f"no such root: {root.name} {root.path}")
        for folder, folders, files in os.walk(root.path, followlinks=False):
            folders[:] = [d for d in folders if not os.path.islink(os.path.join(folder, d))]
            for name in files:
                path = os.path.join(folder, name)
                if not name.lower().endswith(SUFFIX) or os.path.islink(path) or not os.path.isfile(path) or not _selected(root, path):
                    continue
                if path in found:
                    raise ConfigurationError(f"{path} lies below two roots: {found[path]}, {root.name}")
                found[path] = root.name
    return sorted(found.items())


def root_for(path: str, roots: tuple[Root, ...]) -> Root | None:
    """The root that selects a path; None if none does or the path is a link."""
    if os.path.realpath(path) != os.path.abspath(path) or not path.lower().endswith(SUFFIX):
        return None
    mine = [r for r in roots if os.path.abspath(path).startswith(os.path.realpath(r.path).rstrip("/") + "/") and _selected(r, path)]
    if len(mine) > 1:
        raise ConfigurationError(f"{path} lies below {len(mine)} roots")
    return mine[0] if mine else None


def in_roots(path: str, folders: list[str]) -> bool:
    """Whether an existing file's real path lies in one of the folders; nothing lies in no folder."""
    real = os.path.realpath(path)
    return os.path.exists(path) and any(real.startswith(os.path.realpath(f).rstrip("/") + "/") for f in folders)


def _plain(path: Column) -> Column:
    """A file's URI as the path that Python opens."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def read_files(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """(path, content, digest) of the files; digest is SHA-256 of the bytes.

    A list is read by Spark's source; a table of paths, of any length, where
    its rows are, which needs folders that are mounted on the workers. Files
    that are gone are left out.
    """
    if not isinstance(paths, DataFrame):
        if not paths:
            return spark.createDataFrame([], "path string, content binary, digest string")
        df = spark.read.format("binaryFile").load(paths)
        return df.select(_plain(F.col("path")).alias("path"), "content", F.sha2("content", 256).alias("digest"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():  # one file at a time
                try:
                    with open(path, "rb") as f:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])
                except FileNotFoundError:
                    continue

    return paths.select("path").mapInArrow(read, "path string, content binary").select("path", "content", F.sha2("content", 256).alias("digest"))


@F.pandas_udf(T.BooleanType())
def _is_linked(path: pd.Series, folder: pd.Series) -> pd.Series:
    """Whether a link lies between a folder and a path below it."""

    def one(p: str, root: str) -> bool:
        while len(p) > len(root):
            if os.path.islink(p):
                return True
            p = os.path.dirname(p)
        return False

    return pd.Series([one(p, r.rstrip("/")) for p, r in zip(path, folder)], dtype=bool)


def selected(path: Column, root: Root) -> Column:
    """Whether a path below the root passes its patterns and no link leads to it."""
    folder = root.path.rstrip("/")
    inside = F.substr(path, F.lit(len(folder) + 2))
    parts = [~_is_linked(path, F.lit(folder))] + [~F.rlike(inside, F.lit(p)) for p in root.excludes]
    if root.includes:
        parts.append(reduce(lambda a, b: a | b, [F.rlike(inside, F.lit(p)) for p in root.includes]))
    return reduce(lambda a, b: a & b, parts)


def scan_root(spark: SparkSession, root: Root | str) -> DataFrame:
    """(path, content, digest) of all source files of a root on any file system, listed by the cluster."""
    folder = root if isinstance(root, str) else root.path
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[oO][rR][gG]").load(folder)
    df = df.withColumn("path", _plain(F.col("path")))
    if not isinstance(root, str):
        df = df.filter(selected(F.col("path"), root))
    return df.select("path", "content", F.sha2("content", 256).alias("digest"))


def manifest(spark: SparkSession, roots: tuple[Root, ...]) -> DataFrame:
    """(path, root, digest) of every selected file."""
    named = spark.createDataFrame(discover(roots), "path string, root string")
    return read_files(spark, named).select("path", "digest").join(named, "path").select("path", "root", "digest")


@F.pandas_udf(T.BooleanType())
def lies_in(path: pd.Series, folders: pd.Series) -> pd.Series:
    """Whether the files exist and their real paths lie in one of the folders."""
    return pd.Series([p is not None and in_roots(p, list(f)) for p, f in zip(path, folders)], dtype=bool)
