"""The stored index: versioned tables of sources, targets, chunks and vectors.

A source is replaced as a whole: its old rows become deletion vectors and its
new ones files, in the tables of sources, targets, chunks, postings and
lengths. What holds is the catalog: one manifest that names a version of each
table, so all tables change in one commit, and what an interrupted replacement
wrote is never seen. Vectors are keyed by model and text, are never deleted by
a replacement and so survive moves and rebuilds. A failed file keeps its old
rows; a failed scan deletes nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek import schema
from loomseek.config import Config
from loomseek.errors import EngineError, SourceError
from loomseek.operators import chunking, textindex
from loomseek.operators.manifest import Manifest, VersionedTable
from loomseek.session import cut
from loomseek.sources import discover, orgfile

SCHEMA_VERSION = 5

#: Steps from one version of the stored tables to the next, as functions of a store.
MIGRATIONS: dict[int, Callable] = {}
#: Messages of errors kept; the counts are complete.
MOST_ERRORS = 1000


class Member(VersionedTable):
    """A table of the store: its newest version is the one that the catalog names."""

    def __init__(self, catalog: VersionedTable, name: str, schema, order: tuple[str, ...] = ()):
        super().__init__(catalog.spark, f"{catalog.path.rsplit('/', 1)[0]}/{name}", schema)
        self.catalog, self.name, self.order = catalog, name, order

    def latest(self) -> Manifest:
        return self.manifest(self.catalog.latest().processed.get(self.name, 0))

    def _next(self) -> int:
        return super().latest().version + 1

    def _write(self, df: DataFrame, kind: str) -> tuple[str, list[str]]:
        return super()._write(df.sortWithinPartitions(*self.order) if self.order and kind == "data" else df, kind)


def diff(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, root, digest, status) of every path: added, changed, unchanged or removed. Unchanged needs the same root too."""
    a, b = found.select("path", "root", "digest").alias("a"), indexed.select("path", "root", "digest").alias("b")
    same = F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.root").eqNullSafe(F.col("b.root"))
    status = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(
        F.coalesce("a.path", "b.path").alias("path"), F.coalesce("a.root", "b.root").alias("root"), F.coalesce("a.digest", "b.digest").alias("digest"), status.alias("status")
    )


def removed(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that are indexed and no longer found."""
    return indexed.select("path").join(found.select("path"), "path", "left_anti")


@dataclass
class Store:
    spark: SparkSession
    path: str
    config: Config = field(default_factory=Config)
    last: dict = field(default_factory=dict)
    last_at: datetime.datetime | None = None
    errors: list[dict] = field(default_factory=list)
    queue: str = "idle"

    def __post_init__(self):
        self.catalog = VersionedTable(self.spark, f"{self.path}/catalog", schema.source())
        of = lambda name, s, *order: Member(self.catalog, name, s, order)
        self.sources, self.targets = of("sources", schema.source()), of("targets", schema.target())
        self.chunks, self.vectors = of("chunks", schema.chunk()), of("vectors", schema.vector())
        self.postings, self.lengths = of("postings", schema.posting(), "term"), of("lengths", schema.length())

    # changes ---------------------------------------------------------------------

    def _commit(self, *changes: tuple[Member, DataFrame | None, DataFrame | None, list[str]], version: int = SCHEMA_VERSION) -> None:
        """Change tables (table, added, removed, keys) in one commit."""
        named = {t.name: t.commit(added, gone, keys).version for t, added, gone, keys in changes}
        self.catalog.commit(processed=named | {"schema": version})

    def _text_index(self, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of target rows, with their paths."""
        paths = targets.select("key", "path")
        return textindex.postings(targets).join(paths, "key"), textindex.doc_stats(targets).join(paths, "key")

    def replace(self, files: DataFrame, roots: DataFrame, parse: Callable[[DataFrame], DataFrame] = orgfile.project, again: DataFrame | None = None) -> DataFrame:
        """Replace all rows of the given (path, content, digest) files; gives the (path, message) that failed.

        ``again`` has the files' digests read anew: a file that changed while
        it was parsed fails.
        """
        rows = cut(parse(files), "parsed")  # parsed before the files are read again
        failed = rows.filter("kind = 'error'").select("path", F.coalesce("title", F.lit("the file can't be parsed")).alias("message"))
        if again is not None:
            read = rows.groupBy("path").agg(F.first("digest").alias("digest"))
            moved = read.join(again.select("path", F.col("digest").alias("later")), "path", "left").filter(~F.col("digest").eqNullSafe(F.col("later")))
            failed = failed.unionByName(moved.select("path", F.lit("the file changed while it was read").alias("message")))
        bad = cut(failed.groupBy("path").agg(F.min("message").alias("message")), "failed")
        good = rows.filter("kind != 'error'").join(bad, "path", "left_anti")
        paths = good.select("path").distinct()
        done = good.groupBy("path").agg(F.first("digest").alias("digest")).join(roots, "path")
        index, lengths = self._text_index(good)
        by = ["path"]
        self._commit(
            (self.targets, good, paths, by), (self.chunks, chunking.chunks(good, self.config), paths, by), (self.sources, done, paths, by),
            (self.postings, index, paths, by), (self.lengths, lengths, paths, by),
        )
        return bad

    def delete(self, paths: DataFrame) -> None:
        """Remove all rows of the paths."""
        self._commit(*((t, None, paths, ["path"]) for t in (self.targets, self.chunks, self.sources, self.postings, self.lengths)))

    def reconcile(self, parse: Callable[[DataFrame], DataFrame] = orgfile.project) -> dict:
        """Bring the index in line with the roots; gives counts by status."""
        counts = dict.fromkeys(("added", "changed", "unchanged", "removed", "failed"), 0)
        self.errors = []
        try:
            found = cut(discover.manifest(self.spark, self.config.roots), "found")
        except EngineError as e:
            self.errors.append({"path": None, "message": str(e)})
            self.last = counts | {"scan_error": str(e)}
            return self.last
        changes = cut(diff(found, self.sources.read()), "changes")
        for r in changes.groupBy("status").count().collect():
            counts[r["status"]] = r["count"]
        if counts["added"] + counts["changed"]:
            read = discover.read_files(self.spark, changes.filter("status in ('added', 'changed')"))
            bad = self.replace(read, found.select("path", "root"), parse, read.select("path", "digest"))
            for r in changes.join(bad, "path").groupBy("status").count().collect():
                counts[r["status"]] -= r["count"]
                counts["failed"] += r["count"]
            self.record(bad)
        if counts["removed"]:
            self.delete(changes.filter("status = 'removed'").select("path"))
        self.last, self.last_at = counts, datetime.datetime.now(datetime.timezone.utc)
        return counts

    def record(self, bad: DataFrame) -> None:
        """Keep the messages of failed (path, message) rows."""
        self.errors += [{"path": r["path"], "message": r["message"]} for r in bad.orderBy("path").limit(MOST_ERRORS).collect()]

    def update_file(self, path: str) -> bool:
        """Index one file anew; False if no root selects it, an error if it can't be parsed or changes meanwhile."""
        root = discover.root_for(path, self.config.roots)
        if root is None:
            return False
        read = discover.read_files(self.spark, self.spark.createDataFrame([(path,)], "path string"))
        bad = self.replace(read, self.spark.createDataFrame([(path, root.name)], "path string, root string"), again=read.select("path", "digest"))
        if failed := bad.first():
            raise SourceError(f"{path}: {failed['message']}")
        return True

    def add_vectors(self, rows: DataFrame) -> None:
        """Add (model_id, text_digest, vector) rows, replacing those of the same model and text."""
        sized = rows.select("model_id", "text_digest", F.size("vector").alias("dim"), "vector").dropDuplicates(["model_id", "text_digest"])
        self._commit((self.vectors, sized, sized, ["model_id", "text_digest"]))

    def rechunk(self, version: int = SCHEMA_VERSION) -> None:
        """Chunks of the stored targets, without reading any source."""
        rows = self.targets.read()
        self._commit((self.chunks, chunking.chunks(rows, self.config), self.chunks.read().select("path").distinct(), ["path"]), version=version)

    def reindex(self, version: int = SCHEMA_VERSION) -> None:
        """Text index of the stored targets."""
        index, lengths = self._text_index(self.targets.read())
        old = self.lengths.read().select("path").distinct()
        self._commit((self.postings, index, old, ["path"]), (self.lengths, lengths, old, ["path"]), version=version)

    def stored_version(self) -> int:
        """The version of the stored tables; the present one if nothing is stored."""
        m = self.catalog.latest()
        return m.processed.get("schema", 0) if m.version else SCHEMA_VERSION

    def migrate(self, version: int | None = None) -> int:
        """Run the steps from a version of the stored tables to the present one; each is published with its version, so an interrupted migration goes on."""
        version = self.stored_version() if version is None else version
        while version < SCHEMA_VERSION:
            MIGRATIONS[version](self, version + 1)
            version += 1
        return version

    def search_index(self) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths in step with the targets."""
        return self.postings.read(), self.lengths.read().select("key", "tokens")

    # state -----------------------------------------------------------------------

    def pending(self) -> DataFrame:
        return chunking.pending(self.chunks.read(), self.vectors.read(), self.config.model)

    def embed_pending(self, embed, batch: int | None = None) -> int:
        """Embed the next pending texts; gives their number."""
        todo = next_batch(self.pending(), batch or self.config.embed_batch)
        rows = todo.select(F.lit(self.config.model).alias("model_id"), "text_digest", embed(F.col("text")).alias("vector")).persist()
        n = rows.count()
        if n:
            self.add_vectors(rows)
        rows.unpersist()
        return n

    def status(self, semantic: str = "unavailable") -> dict:
        """Facts about the index; reads only."""
        sources = self.sources.read().count()
        cover = chunking.coverage(self.chunks.read(), self.vectors.read(), self.config.model).first()
        state = "unavailable" if not self.config.roots else "degraded" if self.errors or self.last.get("scan_error") else "ready"
        return {
            "schema_version": 1, "state": state, "roots": [{"id": r.name, "path": r.path} for r in self.config.roots], "database": self.path,
            "indexed_sources": sources, "indexed_targets": self.targets.read().count(), "last_reconcile_at": self.last_at, "last_reconcile_counts": self.last,
            "semantic_state": semantic, "semantic_model": self.config.model, "semantic_coverage_chunks": cover["covered"], "semantic_coverage_total": cover["total"],
            "semantic_queue_state": self.queue, "errors": list(self.errors),
        }

    def show_errors(self) -> DataFrame:
        return self.spark.createDataFrame([(e["path"], e["message"]) for e in self.errors], "path string, message string")


def _drop_old_columns(store: Store, version: int) -> None:
    """Rewrite the targets with the columns that they have now."""
    m = store.targets.compact()
    store.catalog.commit(processed={"targets": m.version, "schema": version})


MIGRATIONS |= {
    0: Store.reindex,  # the text index is made anew, once
    1: lambda store, version: store._commit(version=version),  # chunks and vectors appear, empty
    2: Store.rechunk,  # chunks of what was indexed before there were any
    3: Store.rechunk,  # without noise and without chunks of too few words
    4: _drop_old_columns,
}


def summary(status: dict) -> str:
    """A status in one line."""
    if status["semantic_state"] == "ready":
        part = f"semantic ready ({status['semantic_model']}) {status['semantic_coverage_chunks'] or 0}/{status['semantic_coverage_total'] or 0} embedded, queue {status['semantic_queue_state']}"
    elif status["semantic_state"] == "not-installed":
        part = f"semantic not installed ({status['semantic_model']})"
    else:
        part = "semantic unavailable"
    return f"{status['state']} | {part}"


def next_batch(pending: DataFrame, size: int) -> DataFrame:
    """The first pending texts in the order of their digests."""
    return pending.orderBy("text_digest").limit(size)


def latest(rows: DataFrame, keys: list[str], by: str, *columns: str) -> DataFrame:
    """Each key's row with the greatest ``by`` (null comes before all), with the columns asked for only."""
    rest = [c for c in columns or rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by)).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest))


def resolve(results: DataFrame, targets: DataFrame, current: DataFrame) -> DataFrame:
    """(key, status) of result rows (key, org_id, path, digest) against the indexed targets and the sources' digests.

    A result with an id is first looked up by it: none left is missing, more
    than one ambiguous. Then the indexed digest (else missing) and the
    source's (else stale) must be the result's.
    """
    ids = targets.filter("org_id is not null").groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "path", "digest")).alias("t"))
    r = results.select("key", "org_id", "path", "digest").join(ids, "org_id", "left")
    now = F.when(F.col("org_id").isNotNull(), F.col("t")).otherwise(F.struct("key", "path", "digest"))
    r = r.select("key", "org_id", "n", now.alias("now"))
    have = targets.select(F.col("key").alias("tkey"), F.col("digest").alias("tdigest"))
    disk = current.select(F.col("path").alias("dpath"), F.col("digest").alias("ddigest"))
    r = r.join(have, F.col("now.key") == F.col("tkey"), "left").join(disk, F.col("now.path") == F.col("dpath"), "left")
    by_id = F.col("org_id").isNotNull()
    status = (
        F.when(by_id & F.col("n").isNull(), "missing")
        .when(by_id & (F.col("n") > 1), "ambiguous")
        .when(~F.col("tdigest").eqNullSafe(F.col("now.digest")) | F.col("tkey").isNull(), "missing")
        .when(~F.col("ddigest").eqNullSafe(F.col("now.digest")), "stale")
        .otherwise("ok")
    )
    return r.select("key", status.alias("status"))


def ordinals(targets: DataFrame) -> DataFrame:
    """(key, n): a heading's place among its file's headings, from 1.

    Rows are divided by ranges of path and position, numbered inside a part,
    and shifted by what the parts before hold of the path, so a file of any
    size is shared by many tasks.
    """
    rows = targets.filter("kind = 'heading'").select("key", "path", "position")
    ranged = cut(rows.repartitionByRange("path", "position").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("path", "part").count().select("path", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    place = Window.partitionBy("part", "path").orderBy("position")
    return ranged.withColumn("n", F.row_number().over(place)).join(shift, ["path", "part"]).select("key", (F.col("n") + F.col("shift")).cast("int").alias("n"))


def table_outlines(targets: DataFrame, most: int = 500, max_level: int | None = None) -> DataFrame:
    """(path, title, headings, heading_count, truncated) from target rows; headings is an array of (position, level, title).

    Only the first ``most`` headings of a file are brought together.
    """
    heading = F.struct("position", "level", "title")
    first = Window.partitionBy("path").orderBy("position", "level", "title")
    shown = targets.filter("kind = 'heading'").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    lists = shown.groupBy("path").agg(F.sort_array(F.collect_list(heading)).alias("headings"))
    if max_level is not None:
        lists = lists.withColumn("headings", F.filter("headings", lambda h: h["level"] <= max_level))
    is_file, count = F.when(F.col("kind") == "file", F.col("title")), F.count(F.when(F.col("kind") == "heading", 1)).cast("int")
    rows = targets.groupBy("path").agg(F.max(is_file).alias("title"), count.alias("heading_count")).join(lists, "path", "left")
    none = F.array().cast(lists.schema["headings"].dataType)
    return rows.select("path", "title", F.coalesce("headings", none).alias("headings"), "heading_count", (F.col("heading_count") > most).alias("truncated"))
