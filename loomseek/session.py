"""Session, shared folder and table access used by every operator."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomseek import __version__
from loomseek.errors import ConfigurationError


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomseek")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a session, unless they find it by themselves."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    context = spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or (context.master.startswith("local[") and os.getcwd() == root) or getattr(context, "_loomseek_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="loomseek-"), "loomseek.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)  # the driver serves it to every executor
    context._loomseek_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    A local session that has none, as in tests, gets one; on a cluster a
    folder of this machine would be no shared one, so that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomseek-"))
        got = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return got.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; ``sweep`` removes it."""
    path = f"{shared_dir(spark)}/loomseek-{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Paths in use by each application.
_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session, to be called when all results made so far have been read; gives their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage.

    The written table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table of ``cut`` behind df, when nothing that is still to be read depends on it."""
    spark = df.sparkSession
    _delete(spark, df.written_at)
    _written[spark.sparkContext.applicationId].remove(df.written_at)


def stored(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], None]) -> str:
    """Path of a table derived from files, which ``write`` makes once for all queries; new if a file changes.

    The path is named by the files' names, sizes and times. A table counts
    only when it is complete: it is written beside its place and then moved.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    known = []
    for p in inputs:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        files = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else [fs.getFileStatus(at)]
        known += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    digest = hashlib.sha256("\n".join([__version__, *sorted(known)]).encode()).hexdigest()[:20]
    path = f"{shared_dir(spark)}/loomseek-stored-{name}-{digest}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        draft = f"{path}-{uuid.uuid4().hex[:12]}"
        write(draft)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), at):
            if not fs.exists(at):
                raise OSError(f"{draft} can't be moved to {path}")
            _delete(spark, draft)
    return path


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a data folder, pruned to the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
