"""Records that are new or changed since the last successful run (problem 6).

A ``Ledger`` is a persistent pair of versioned tables (``manifest``): the state
of all records, of which every look publishes a new version, and the records
handed to runs. What a run must process is the difference between the state's
manifests since the version that the last successful run had processed; its
rows and that version are published in one commit, so a run that fails before
it is repeated whole and none is repeated after it.

The inputs here are plain tables, so ``pending`` starts a ledger whose first
version is what the log says was processed, and marks it as processed; the
present state is the second version, and a run takes up the difference.

Sources: the observation of a path with the latest seen_at counts (of equal
ones the greatest digest); a null digest there means unreadable and is no
case, nor is the path gone. Of the log, the row of the highest run that ended
ok counts, failed outcomes left out (of equal ones the latest logged). Texts: a digest counts as
done if some vector of the model is not null, has exactly dim values and only
finite ones. Null paths and null text digests are left out; case of hex digits
is ignored; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.operators.manifest import Manifest, VersionedTable, run_incremental
from loomseek.session import fresh_path

STATE = T.StructType([T.StructField(n, T.StringType()) for n in ("tab", "rec_key", "root", "digest")])


def observed(sources: DataFrame) -> DataFrame:
    """Newest observation o of each path, readable or not."""
    return sources.filter("path is not null").groupBy("path").agg(F.max(F.struct("seen_at", F.col("digest").isNotNull().alias("readable"), F.lower("digest").alias("digest"), "root")).alias("o"))


def seen_now(sources: DataFrame) -> DataFrame:
    """Newest readable observation of each path."""
    return observed(sources).filter("o.readable").select(F.lit("sources").alias("tab"), F.col("path").alias("rec_key"), "o.root", "o.digest")


def logged(run_log: DataFrame, index_runs: DataFrame) -> DataFrame:
    """What the last successful run left of each path; removed paths are left out."""
    ok = index_runs.filter("state = 'ok'").select("run_id").distinct()
    rows = run_log.filter("path is not null and (outcome is null or outcome != 'failed')").join(ok, "run_id", "left_semi")
    last = rows.groupBy("path").agg(F.max(F.struct("run_id", "logged_at", "outcome", F.lower("digest").alias("digest"), "root")).alias("o"))
    return last.filter("o.outcome is null or o.outcome != 'removed'").select(F.lit("sources").alias("tab"), F.col("path").alias("rec_key"), "o.root", "o.digest")


def usable_rows(vectors: DataFrame, model: str) -> DataFrame:
    """Rows of vectors of the model that are not null, have exactly dim values, and only finite ones."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = (F.col("model_id") == model) & F.col("vector").isNotNull() & (F.size("vector") == F.col("dim")) & finite
    return vectors.filter(good & F.col("text_digest").isNotNull())


def usable(vectors: DataFrame, model: str) -> DataFrame:
    """Digests that have a usable vector of the model."""
    return usable_rows(vectors, model).select("text_digest").distinct()


def texts(rows: DataFrame) -> DataFrame:
    """State rows of text digests."""
    return rows.select(F.lit("chunks").alias("tab"), F.col("text_digest").alias("rec_key"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("digest"))


DELTA = T.StructType([*STATE.fields, T.StructField("change", T.StringType()), T.StructField("state_version", T.LongType())])


class Ledger:
    """What is known of all records below ``path``, and what was handed to runs; both outlive the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.state = VersionedTable(spark, f"{path}/state", STATE)
        self.taken = VersionedTable(spark, f"{path}/taken", DELTA)

    def look(self, present: DataFrame) -> Manifest:
        """Publish the present state as the next version."""
        return self.state.commit(present, replace=True)

    def processed(self) -> int:
        """The version of the state that the last successful run processed."""
        return self.taken.latest().processed.get(self.state.path, 0)

    def start_at(self, version: int) -> None:
        """Take a version for processed without a run."""
        self.taken.commit(processed={self.state.path: version})

    def run(self, work: Callable[[DataFrame], object] = lambda deltas: None) -> int:
        """Hand what changed since the last successful run to ``work``, and commit it with the version if work returns; gives the commit's version."""
        now = self.state.latest().version

        def take(deltas: DataFrame) -> DataFrame:
            rows = deltas.withColumn("state_version", F.lit(now).cast("long"))
            work(rows)
            return rows

        return run_incremental(self.state, self.taken, take).version

    def rows(self, version: int) -> DataFrame:
        """The deltas that one run took up, whatever version its commit has."""
        return self.taken.read(version).filter(F.col("state_version") == self.taken.manifest(version).processed.get(self.state.path, 0))


def present(sources: DataFrame, chunks: DataFrame, done: DataFrame) -> DataFrame:
    """The state found now. A path that can't be read keeps the state it had in ``done``."""
    had = done.filter("tab = 'sources'").select(F.col("rec_key").alias("path"), F.struct("root", "digest").alias("had"))
    seen = observed(sources).join(had, "path", "left").filter("o.readable or had is not null")
    now = F.when(F.col("o.readable"), F.struct("o.root", "o.digest")).otherwise(F.col("had"))
    paths = seen.select("path", now.alias("now")).select(F.lit("sources").alias("tab"), F.col("path").alias("rec_key"), "now.root", "now.digest")
    return paths.unionByName(texts(chunks.filter("text_digest is not null").select("text_digest").distinct()))


def pending(sources: DataFrame, run_log: DataFrame, index_runs: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str = "lantern-s") -> DataFrame:
    """Deltas (tab, rec_key, root, digest, change) between the processed state and the present one."""
    spark = sources.sparkSession
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    first = ledger.look(logged(run_log, index_runs).unionByName(texts(usable(vectors, model))))
    ledger.start_at(first.version)
    ledger.look(present(sources, chunks, ledger.state.read(first.version)))
    ledger.run()
    return ledger.taken.read().drop("state_version")


def found(*tables: DataFrame) -> DataFrame:
    """(tab, rec_key) of the records that the next run must process."""
    return pending(*tables).filter("change = 'added'").select("tab", "rec_key").distinct()
