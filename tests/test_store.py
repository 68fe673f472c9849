"""Indexing of Org files: discovery, parsing, replacement, status and resolution."""

import os

import pytest
from pyspark.sql import functions as F

from loomseek.config import Config, Root
from loomseek.errors import ConfigurationError
from loomseek.functions.vectors import hash_embedder
from loomseek.operators import store as S
from loomseek.plans import search, tools
from loomseek.sources import discover, orgfile
from loomseek.streaming import updates

ONE = """#+TITLE: First note
#+PROPERTY: STATUS open
#+TODO: TODO NEXT | DONE CANCELLED
intro words of the file
* TODO [#A] Same heading :work:urgent:
SCHEDULED: <2024-01-02 Tue>
:PROPERTIES:
:ID: abc-1
:KIND: task
:END:
body one about the archive budget
| a | table |
#+begin_src sh
not a paragraph
#+end_src
** Child
:PROPERTIES:
:KIND: child
:END:
child text here with several more words
* DONE Last
"""
TWO = "* Same heading\nother body that mentions the archive too\n"


@pytest.fixture
def notes(tmp_path):
    d = tmp_path / "notes"
    d.mkdir()
    (d / "one.org").write_text(ONE)
    (d / "two.org").write_text(TWO)
    return d


def make(spark, notes, tmp_path, **config):
    c = Config(roots=(Root("fixture", str(notes)),), **config)
    return S.Store(spark, str(tmp_path / "index"), c)


def test_parse_records():
    rows = orgfile.records("/x/one.org", "d", ONE)
    assert [r["kind"] for r in rows] == ["file", "heading", "heading", "heading"]
    f, a, b, c = rows
    assert f["title"] == "First note" and f["body"] == "intro words of the file" and f["properties"] == {"STATUS": "open"} and f["position"] == 1
    assert a["title"] == "Same heading" and a["org_id"] == "abc-1" and a["key"] == "/x/one.org@d#heading:1"
    assert a["body"] == "body one about the archive budget"
    assert b["outline_path"] == ["Same heading", "Child"] and b["properties"] == {"STATUS": "open", "ID": "abc-1", "KIND": "child"} and b["org_id"] is None
    assert ONE[a["position"] - 1 :].startswith("* TODO") and c["level"] == 1


def test_outline():
    o = orgfile.outline("/x/one.org", ONE)
    first, child, last = o["headings"]
    assert first["todo_keyword"] == "TODO" and not first["closed"] and first["priority"] == "A" and first["tags"] == ["work", "urgent"]
    assert last["todo_keyword"] == "DONE" and last["closed"] and o["heading_count"] == 3 and not o["truncated"]
    capped = orgfile.outline("/x/one.org", ONE, most=2, max_level=1)
    assert [h["title"] for h in capped["headings"]] == ["Same heading"] and capped["heading_count"] == 3 and capped["truncated"]


def test_paragraphs():
    text = """one
two
#+begin_quote
quoted text
#+end_quote
#+begin_example
raw
#+end_example
:LOGBOOK:
- State "DONE" and a note
CLOCK: [2024-01-01 Mon]
:END:
[fn:1] the note
goes on
\\begin{equation}
x = 1
\\end{equation}
last #+end_quote
#+begin_src never closed
"""
    assert orgfile.paragraphs(text.split("\n")).split("\n") == ["one", "two", "quoted text", 'State "DONE" and a note', "the note", "goes on", "last #+end_quote", "#+begin_src never closed"]
    assert orgfile.paragraphs(["#+begin_a"] * 3000 + [":x:"] * 3000)


def test_odd_texts_parse():
    assert [r["title"] for r in orgfile.records("/x/e.org", "d", "")] == ["e"]
    assert len(orgfile.records("/x/b.org", "d", "#+begin_src\nnever closed\n* H\n")) == 2
    assert len(orgfile.records("/x/l.org", "d", "* h\n" + "word " * 200_000)) == 2


def test_reconcile_counts_and_replace(spark, notes, tmp_path):
    s = make(spark, notes, tmp_path)
    assert s.reconcile() == {"added": 2, "changed": 0, "unchanged": 0, "removed": 0, "failed": 0}
    hits = search.exact_title(s.targets.read(), "Same heading").collect()
    assert len(hits) == 2 and len({h["key"] for h in hits}) == 2
    assert s.reconcile()["unchanged"] == 2
    (notes / "two.org").write_text("* Other\nnew words\n")
    os.remove(notes / "one.org")
    assert s.reconcile() == {"added": 0, "changed": 1, "unchanged": 0, "removed": 1, "failed": 0}
    assert {r["title"] for r in s.targets.read().collect()} == {"two", "Other"}
    assert s.chunks.read().filter("path like '%one.org'").count() == 0


def test_failures_keep_rows(spark, notes, tmp_path):
    s = make(spark, notes, tmp_path)
    s.reconcile()
    (notes / "two.org").write_text("* Changed\n")
    before = s.targets.read().count()

    def broken(files):
        rows = orgfile.project(files)
        return rows.withColumn("kind", F.lit("error"))

    assert s.reconcile(broken)["failed"] == 1
    assert s.targets.read().count() == before and s.status()["state"] == "degraded" and s.show_errors().count() == 1
    gone = S.Store(spark, s.path, Config(roots=(Root("fixture", str(notes / "missing")),)))
    assert "scan_error" in gone.reconcile()
    assert gone.targets.read().count() == before


def test_failed_write_publishes_nothing(spark, notes, tmp_path, monkeypatch):
    s = make(spark, notes, tmp_path)
    s.reconcile()
    version = s.targets.latest().version
    monkeypatch.setattr(type(s.targets), "_publish", lambda self, m: (_ for _ in ()).throw(OSError("disk")))
    (notes / "two.org").write_text("* Changed\n")
    with pytest.raises(OSError):
        s.reconcile()
    monkeypatch.undo()
    assert s.targets.latest().version == version and s.targets.read().filter("title = 'Same heading'").count() == 2
    assert s.reconcile()["changed"] == 1


def test_discovery_rules(tmp_path):
    d = tmp_path / "r"
    (d / "sub").mkdir(parents=True)
    for n in ("a.org", "b.ORG", "c.txt", "sub/skip.org"):
        (d / n).write_text("x")
    os.symlink(d / "a.org", d / "link.org")
    os.symlink(d / "sub", d / "linked")
    found = discover.discover((Root("r", str(d), excludes=("skip",)),))
    assert [os.path.basename(p) for p, _ in found] == ["a.org", "b.ORG"]
    assert [os.path.basename(p) for p, _ in discover.discover((Root("r", str(d), includes=("^sub/",)),))] == ["skip.org"]
    with pytest.raises(ConfigurationError):
        discover.discover((Root("r", str(d)), Root("s", str(d / "sub"))))
    with pytest.raises(ConfigurationError):
        discover.root_for(str(d / "sub/skip.org"), (Root("r", str(d)), Root("s", str(d / "sub"))))
    assert discover.root_for(str(d / "link.org"), (Root("r", str(d)),)) is None
    assert discover.in_roots(str(d / "a.org"), [str(d)]) and not discover.in_roots(str(d / "a.org"), [])


def test_update_file_status_and_vectors(spark, notes, tmp_path):
    s = make(spark, notes, tmp_path, model="fake")
    assert s.update_file(str(notes / "one.org")) and not s.update_file(str(tmp_path / "elsewhere.org"))
    assert s.sources.read().count() == 1
    s.reconcile()
    status = s.status("ready")
    assert status["state"] == "ready" and status["semantic_coverage_chunks"] == 0 and status["semantic_coverage_total"] == s.chunks.read().count()
    assert "0/" in S.summary(status) and S.summary(s.status()) == "ready | semantic unavailable"
    q = updates.EmbedQueue(s, hash_embedder(32))
    q.pause()
    assert q.tick() == 0 and s.queue == "paused"
    q.toggle()
    distinct = s.chunks.read().select("text_digest").distinct().count()
    assert q.drain() == distinct and s.pending().count() == 0
    # a move keeps the vectors
    os.rename(notes / "two.org", notes / "moved.org")
    s.reconcile()
    assert s.pending().filter("text like '%mentions the archive%'").count() == 0
    assert s.vectors.read().count() == distinct
    s.rechunk()
    assert s.migrate(3) == S.SCHEMA_VERSION and s.chunks.read().count() > 0


def hits(s, query):
    from loomseek.operators import textindex

    return {r["key"] for r in textindex.search(s.targets.read(), query, *s.search_index()).collect()}


def test_text_index_is_kept_in_step(spark, notes, tmp_path):
    from loomseek.operators import textindex

    s = make(spark, notes, tmp_path)
    s.reconcile()
    both = hits(s, "archive")
    assert len(both) == 2 and hits(s, "budg") < both
    (notes / "two.org").write_text("* Other\nnew words of a budget\n")
    s.reconcile()
    assert len(hits(s, "archive")) == 1 and len(hits(s, "budget")) == 2 and hits(s, "new words")
    os.remove(notes / "one.org")
    s.reconcile()
    assert not hits(s, "archive") and s.lengths.read().count() == s.targets.read().count() == 2
    direct = {r["key"]: round(r["bm25"], 9) for r in textindex.search(s.targets.read(), "budget").collect()}
    assert direct == {r["key"]: round(r["bm25"], 9) for r in textindex.search(s.targets.read(), "budget", *s.search_index()).collect()}
    s.reindex()
    assert len(hits(s, "budget")) == 1


def test_replacement_is_one_commit(spark, notes, tmp_path, monkeypatch):
    s = make(spark, notes, tmp_path)
    s.reconcile()
    before = {t: getattr(s, t).read().count() for t in ("sources", "targets", "chunks", "postings")}
    (notes / "two.org").write_text("* Changed\n** More\n** And more words to be indexed here now\n")
    publish = S.VersionedTable._publish
    # the process is lost after some tables were written, before the catalog was
    monkeypatch.setattr(S.VersionedTable, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("lost")) if self.path.endswith(("catalog", "sources")) else publish(self, m))
    with pytest.raises(OSError):
        s.reconcile()
    monkeypatch.undo()
    s = make(spark, notes, tmp_path)
    assert {t: getattr(s, t).read().count() for t in before} == before
    assert s.reconcile()["changed"] == 1 and s.targets.read().filter("path like '%two.org'").count() == 4
    assert s.chunks.read().filter("path like '%two.org'").select("key").distinct().count() == s.chunks.read().filter("path like '%two.org'").count()


def test_file_that_changes_meanwhile_fails(spark, notes, tmp_path):
    from loomseek.errors import SourceError

    s = make(spark, notes, tmp_path)
    s.reconcile()
    read = discover.read_files(spark, spark.createDataFrame([(str(notes / "two.org"),)], "path string"))
    later = read.select("path", F.lit("other").alias("digest"))
    bad = s.replace(read, read.select("path", F.lit("fixture").alias("root")), again=later).collect()
    assert [os.path.basename(r["path"]) for r in bad] == ["two.org"] and s.targets.read().filter("path like '%two.org'").count() == 2
    with pytest.raises(SourceError):
        s.replace = lambda *a, **k: bad_rows  # noqa: B023
        bad_rows = spark.createDataFrame([("x", "lost")], "path string, message string")
        s.update_file(str(notes / "two.org"))


def test_migrations(spark, notes, tmp_path):
    s = make(spark, notes, tmp_path)
    assert s.stored_version() == S.SCHEMA_VERSION
    s.reconcile()
    want = {t: getattr(s, t).read().count() for t in ("targets", "chunks", "postings", "lengths")}
    # as an old store: no text index, no chunks
    none = lambda t: t.read().select("path").distinct()
    s._commit((s.chunks, None, none(s.chunks), ["path"]), (s.postings, None, none(s.postings), ["path"]), (s.lengths, None, none(s.lengths), ["path"]), version=0)
    assert s.stored_version() == 0 and not hits(s, "archive")
    MIGRATION = S.MIGRATIONS[3]
    S.MIGRATIONS[3] = lambda store, version: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            s.migrate()
    finally:
        S.MIGRATIONS[3] = MIGRATION
    assert s.stored_version() == 3 and s.chunks.read().count() == want["chunks"]
    assert s.migrate() == S.SCHEMA_VERSION == s.stored_version()
    assert {t: getattr(s, t).read().count() for t in want} == want and s.targets.latest().deletions == ()


def test_scan_by_the_cluster_follows_the_rules(spark, tmp_path):
    d = tmp_path / "r"
    (d / "sub").mkdir(parents=True)
    for n in ("a.org", "b.ORG", "c.txt", "sub/skip.org", "sub/with space+.org"):
        (d / n).write_text("x")
    os.symlink(d / "a.org", d / "link.org")
    root = Root("r", str(d), excludes=("skip",))
    got = sorted(r["path"] for r in discover.scan_root(spark, root).collect())
    assert got == [p for p, _ in discover.discover((root,))] and len(got) == 3
    assert [r["digest"] for r in discover.manifest(spark, (root,)).select("digest").distinct().collect()] == [discover.scan_root(spark, str(d)).first()["digest"]]
    assert discover.scan_root(spark, Root("r", str(d), includes=("^sub/",))).count() == 2


def test_allowed_roots_on_disk(spark, tmp_path):
    from loomseek.operators.filters import Filters

    (tmp_path / "in").mkdir()
    (tmp_path / "out.org").write_text("x")
    (tmp_path / "in" / "a.org").write_text("x")
    os.symlink(tmp_path / "out.org", tmp_path / "in" / "link.org")
    rows = spark.createDataFrame([(str(tmp_path / p),) for p in ("in/a.org", "in/link.org", "in/gone.org", "out.org")] + [(None,)], "path string")
    got = rows.filter(Filters(allowed_roots=(str(tmp_path / "in"),), on_disk=True).column()).collect()
    assert [os.path.basename(r["path"]) for r in got] == ["a.org"]
    assert rows.filter(Filters(allowed_roots=(str(tmp_path / "in"),)).column()).count() == 3 and rows.filter(Filters(allowed_roots=(), on_disk=True).column()).count() == 0


def test_embedding_service(spark, tmp_path):
    from loomseek.config import PRESETS, Preset
    from loomseek.plans.embedding import EmbeddingService, self_test

    preset = Preset("small", 64, "mean", "query ", "", 4, "m/small")
    e = EmbeddingService(spark, str(tmp_path / "e"), preset, hash_embedder(64))
    ask = lambda **r: e.handle({"id": 1, **r})
    assert ask(op="hello")["result"]["dimension"] == 64 and ask(op="hello")["result"]["model_id"] == "m/small" and PRESETS["bge-m3"].model_id
    assert ask(op="nothing")["error"]["type"] == "QueryError" and ask(op="embed")["error"]["type"] == "TypeError"
    assert ask(op="search", query="x")["result"] == {"results": []}
    got = ask(op="embed", texts=["apple pie", "one two three four five", ""], kind="passage")["result"]
    assert got["truncated"] == 1 and len(got["vectors"]) == 3
    assert ask(op="load", items=[{"digest": d, "vector": v} for d, v in zip("abc", got["vectors"])])["result"] == {"loaded": 3}
    assert ask(op="load", items=[{"digest": "z", "vector": "AAAAAA=="}])["error"]["type"] == "QueryError"
    found = ask(op="search", query="apple", k=2)["result"]["results"]
    assert found[0]["digest"] == "a" and len(found) == 2
    assert [r["digest"] for r in ask(op="search", query="apple", digests=["b", "q"])["result"]["results"]] == ["b"]
    at = e.prepared()
    assert e.prepared() == at
    assert ask(op="unload", digests=["a", "q"])["result"] == {"unloaded": 1} and e.prepared() != at
    assert "a" not in {r["digest"] for r in ask(op="search", query="apple")["result"]["results"]}
    assert self_test(e, "weld test", "a weld test of it", "quarterly sales report")


def test_intermediate_tables_go(spark, tmp_path):
    from loomseek import session

    df = session.cut(spark.range(5), "some")
    path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.sweep(spark) >= 1 and not os.path.exists(path)
    (tmp_path / "in.parquet").write_text("x")
    made = []
    write = lambda p: (made.append(p), spark.range(3).write.parquet(p))
    at = session.stored(spark, "t", [str(tmp_path / "in.parquet")], write)
    assert session.stored(spark, "t", [str(tmp_path / "in.parquet")], write) == at and len(made) == 1 and spark.read.parquet(at).count() == 3
    (tmp_path / "in.parquet").write_text("xy")
    assert session.stored(spark, "t", [str(tmp_path / "in.parquet")], write) != at


def test_one_file_with_most_headings(spark):
    rows = [(f"k{i}", "/big" if i % 7 else f"/p{i}", "heading", f"T{i}", i, 1 + i % 3) for i in range(700)] + [("f", "/big", "file", "Big", 0, 0), ("e", "/empty", "file", "Empty", 0, 0), ("n", None, "heading", "N", 5, 1)]
    t = spark.createDataFrame(rows, "key string, path string, kind string, title string, position int, level int").repartition(5)
    got = {r["key"]: r["n"] for r in S.ordinals(t).collect()}
    big = [f"k{i}" for i in range(700) if i % 7]
    assert [got[k] for k in big] == list(range(1, 601)) and {got[f"k{i}"] for i in range(0, 700, 7)} == {1} and S.ordinals(t.limit(0)).count() == 0
    out = {r["path"]: r for r in S.table_outlines(t, 10, 2).collect()}
    assert out["/big"]["heading_count"] == 600 and out["/big"]["truncated"] and out["/big"]["title"] == "Big"
    assert [h["title"] for h in out["/big"]["headings"]] == [f"T{i}" for i in range(1, 12) if i % 7 and i % 3 != 2]
    assert out["/empty"]["headings"] == [] and out["/empty"]["heading_count"] == 0 and out[None]["heading_count"] == 1


def test_lookup_divides_hot_keys(spark):
    from loomseek.operators.joins import divide, hot_keys, lookup

    rows = spark.createDataFrame([("hot", str(i)) for i in range(200)] + [("cold", "x"), (None, "y"), ("other", "z")], "k string, id string")
    facts = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    hot = hot_keys(rows, "k", 10, 50)
    assert [tuple(r) for r in hot.collect()] == [("hot", 9)] and divide(rows, hot, "k", "id").filter("k = 'hot'").select("part").distinct().count() == 9
    assert lookup(rows, facts, "k", "id").count() == 201 and lookup(rows.limit(0), facts, "k", "id").count() == 0
    got = lookup(rows, facts, "k", "id", 10, 50)
    assert got.columns == ["k", "id", "v"] and got.count() == 201 and got.filter("k = 'cold' and v = 2").count() == 1


def test_resolve(spark):
    t = spark.createDataFrame([("k1", "i1", "/a", "d1"), ("k2", "i2", "/b", "d2"), ("k3", "i2", "/c", "d3"), ("k4", None, "/d", "d4"), ("k5", None, "/e", "d5")], "key string, org_id string, path string, digest string")
    now = spark.createDataFrame([("/a", "d1"), ("/d", "changed"), ("/e", "d5")], "path string, digest string")
    asked = t.unionByName(spark.createDataFrame([("k9", "gone", "/z", "d9"), ("k8", None, "/d", "old")], t.schema))
    got = {r["key"]: r["status"] for r in S.resolve(asked, t, now).collect()}
    assert got == {"k1": "ok", "k2": "ambiguous", "k3": "ambiguous", "k4": "stale", "k5": "ok", "k9": "missing", "k8": "missing"}


def test_tools(spark, notes, tmp_path):
    import json

    s = make(spark, notes, tmp_path)
    s.reconcile()
    c = search.Corpus(s.targets.read(), current=discover.manifest(spark, s.config.roots), config=s.config)
    got = json.loads(tools.search_tool(c)({"query": "archive", "property_key": "", "limit": 5}))
    assert got["completeness"] == "complete" and {r["title"] for r in got["results"]} == {"Same heading"} and got["freshness"] == "sources-checked-current"
    assert "link" in got["results"][0] and got["results"][0]["match-reason"].startswith("lexical #")
    assert "error" in json.loads(tools.search_tool(c)({}))
    assert "error" in json.loads(tools.search_tool(search.Corpus(s.targets.read()))({"query": "x"}))
    filtered = json.loads(tools.search_tool(c)({"query": "Same heading", "property_filters": [{"key": "kind", "op": "not_equals", "value": "TASK"}]}))
    assert [os.path.basename(r["path"]) for r in filtered["results"]] == ["two.org"]
    out = json.loads(tools.outline_tool([str(notes)])({"files": [str(notes / "one.org"), str(notes / "nope.org"), "/etc/hostname"]}))
    assert len(out["outlines"]) == 1 and len(out["errors"]) == 2 and out["outlines"][0]["headings"][0]["closed"] is None
    assert tools.outline_files([str(notes / "nope.org"), str(notes / "two.org")])["errors"][0]["path"].endswith("nope.org")
    rows = orgfile.outlines(discover.read_files(spark, [str(notes / "one.org")])).collect()
    assert rows[0]["heading_count"] == 3 and rows[0]["headings"][1]["outline_path"] == ["Same heading", "Child"]


def test_stale_source_is_seen_even_if_filtered(spark, notes, tmp_path):
    from loomseek.operators.filters import Filters

    s = make(spark, notes, tmp_path)
    s.reconcile()
    (notes / "two.org").write_text(TWO + "more\n")
    c = search.Corpus(s.targets.read(), current=discover.manifest(spark, s.config.roots), config=s.config)
    got = search.search_api(c, "Same heading", filters=Filters(exclude_titles=("same heading",)), modes=["exact"])
    assert got.freshness == "stale-source-present" and got.results.count() == 0


def test_watch_and_pending_changes(spark, notes, tmp_path):
    s = make(spark, notes, tmp_path)
    root = Root("fixture", str(notes), excludes=("^skip",))
    go = lambda: updates.watch(s, root, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(120)
    (notes / "skipped.org").write_text("* No\n")
    os.symlink(notes / "one.org", notes / "link.org")
    go()
    assert s.sources.read().count() == 2 and s.targets.read().count() == 6
    (notes / "three.org").write_text("* Third\n")
    go()
    assert s.sources.read().count() == 3 and s.targets.read().count() == 8
    os.remove(notes / "three.org")
    (notes / "two.org").write_text("* Newer\n")
    got = updates.apply_changes(s, [str(notes / "three.org"), str(notes / "two.org"), str(notes / "two.org"), "/nowhere/x.org"])
    assert list(got.values())[:2] == ["removed", "updated"] and len(got) == 3
    assert s.sources.read().count() == 2 and s.targets.read().filter("title = 'Newer'").count() == 1


def test_reconcile_at_intervals(spark, notes, tmp_path):
    from threading import Event

    s, stop, seen = make(spark, notes, tmp_path), Event(), []

    def after(counts):
        seen.append(counts)
        if len(seen) == 2:
            stop.set()

    assert updates.reconcile_every(s, stop, 0.01, after) == 2
    assert seen[0]["added"] == 2 and seen[1]["unchanged"] == 2
