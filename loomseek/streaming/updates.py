"""Updates of the index as files change, and of vectors as texts appear."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomseek.config import Config, Root
from loomseek.operators import chunking
from loomseek.operators.store import Store
from loomseek.sources import discover, orgfile


def last_per_path(batch: DataFrame, by: str = "modificationTime") -> DataFrame:
    """Each path's newest row of a micro-batch."""
    rest = [c for c in batch.columns if c != "path"]
    return batch.groupBy("path").agg(F.max_by(F.struct(*rest), F.col(by)).alias("r")).select("path", "r.*")


def watch(store: Store, root: Root, checkpoint: str, trigger: dict | None = None, parse: Callable[[DataFrame], DataFrame] = orgfile.project) -> StreamingQuery:
    """Index files of a root as they appear or change, by the root's patterns and without links.

    The checkpoint keeps what was seen; a batch that is repeated after a
    failure replaces the same rows again. A file source does not report
    deletions: the periodic reconcile finds those.
    """
    fields = "path string, modificationTime timestamp, length bigint, content binary"
    files = store.spark.readStream.format("binaryFile").schema(fields).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[oO][rR][gG]").load(root.path)

    def apply(batch: DataFrame, _: int) -> None:
        plain = batch.withColumn("path", discover._plain(F.col("path"))).filter(discover.selected(F.col("path"), root))
        last = last_per_path(plain).select("path", "content", F.sha2("content", 256).alias("digest"))
        known = store.sources.read().select("path", "digest")
        new = last.join(known, ["path", "digest"], "left_anti").persist()
        if new.limit(1).count():
            store.record(store.replace(new, new.select("path", F.lit(root.name).alias("root")), parse))
        new.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def apply_changes(store: Store, paths: list[str]) -> dict[str, str]:
    """Update a list of saved paths, each once: gone files are deleted, a failure leaves the rows as they are."""
    out = {}
    for path in dict.fromkeys(paths):
        try:
            if not discover.os.path.exists(path):
                store.delete(store.spark.createDataFrame([(path,)], "path string"))
                out[path] = "removed"
            else:
                out[path] = "updated" if store.update_file(path) else "skipped"
        except Exception as e:
            store.errors.append({"path": path, "message": str(e).split("\n")[0]})
            out[path] = "failed"
    return out


def reconcile_every(store: Store, stop: Event, seconds: float | None = None, after: Callable[[dict], None] | None = None) -> int:
    """Reconcile at once and then at intervals until ``stop`` is set; gives the number of runs.

    A run that fails is recorded and the next one is tried.
    """
    runs = 0
    while True:
        try:
            counts = store.reconcile()
        except Exception as e:
            counts = {"error": str(e).split("\n")[0]}
            store.errors.append({"path": None, "message": counts["error"]})
        runs += 1
        if after:
            after(counts)
        if stop.wait(store.config.reconcile_seconds if seconds is None else seconds):
            return runs


class EmbedQueue:
    """Closes the gap between chunks and vectors, one bounded batch at a time."""

    def __init__(self, store: Store, embed: Callable[[Column], Column]):
        self.store, self.embed = store, embed

    def pause(self) -> None:
        self.store.queue = "paused"

    def resume(self) -> None:
        self.store.queue = "idle"

    def toggle(self) -> None:
        self.resume() if self.store.queue == "paused" else self.pause()

    def tick(self) -> int:
        """Embed one batch; 0 if paused, failed or nothing is pending."""
        if self.store.queue == "paused":
            return 0
        self.store.queue = "running"
        try:
            return self.store.embed_pending(self.embed)
        except Exception as e:
            self.store.errors.append({"path": None, "message": str(e).split("\n")[0]})
            return 0
        finally:
            if self.store.queue == "running":
                self.store.queue = "idle"

    def drain(self) -> int:
        total = 0
        while n := self.tick():
            total += n
        return total


def chunk_stream(targets: DataFrame, stored: DataFrame, checkpoint: str, out: str, config: Config = Config()) -> StreamingQuery:
    """Chunk rows of a stream of target rows in a parquet folder, exactly once.

    ``stored`` are the targets of all files: a file's outline and title are
    taken from there, so the chunks are those that a batch would give.
    """
    about = chunking.file_outlines(stored, config.outline_depth)
    rows = chunking.windowed(chunking.passage_rows(targets.join(about, "path"), config), config)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
