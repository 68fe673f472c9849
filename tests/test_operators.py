"""Chunking, vectors, versioned tables and incremental state."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.config import Config
from loomseek.functions import text
from loomseek.functions import vectors as V
from loomseek.operators import chunking, incremental, scoring
from loomseek.operators.manifest import CommitConflict, VersionedTable, run_incremental
from loomseek.streaming import updates


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def brute_windows(t, most, overlap):
    import re

    out, cur, n = [], [], 0
    for p in [p.strip() for p in re.split(r"\n[ \t]*\n", t or "") if p.strip()]:
        cur.append(p)
        n += len(p) + 1
        if n >= most:
            out.append("\n\n".join(cur))
            cur, n = ([p], len(p) + 1) if overlap else ([], 0)
    return out + (["\n\n".join(cur)] if cur else [])


@pytest.mark.parametrize("t", ["", None, "one", "aaaa\n\nbbbb\n \ncccc\n\ndddd", "x" * 50, "\n\n".join(f"p{i} " + "w" * i for i in range(30))])
def test_windows(spark, t):
    for most, overlap in ((40, 10), (12, 0), (5, 3)):
        assert one(spark, t, lambda c: text.windows(c, most, overlap)) == brute_windows(t, most, overlap)
    assert one(spark, "x" * 50, lambda c: text.windows(c, 40, 10, dedup=True)) == ["x" * 50]


def test_noise_words_and_aliases(spark):
    assert one(spark, "see https://a.b/c now", text.strip_noise) == "see  now"
    assert one(spark, 'state "DONE" from "TODO" [2024-01-01 Mon]', text.strip_noise) == ""
    assert one(spark, "[2024-01-01 Mon 10:00] met", text.strip_noise) == "met"
    assert one(spark, None, text.strip_noise) == ""
    assert one(spark, "ab abc äöü 123 x-ray", text.word_count) == 3
    assert one(spark, 'a "b c"  d', text.aliases) == ["a", "b c", "d"] and one(spark, None, text.aliases) == []
    assert one(spark, 'a "open b', text.aliases) == [] and one(spark, r'"say \"x\" now" y"z w"', text.aliases) == ['say "x" now', "y", "z w"] and one(spark, '""', text.aliases) == [""]
    assert one(spark, "Über die STRASSE, ok?", text.tokens) == ["uber", "die", "strasse", "ok"] == text.tokenize("Über die STRASSE, ok?")
    assert one(spark, "KEY   some value", lambda c: F.concat_ws("|", *text.parse_keyword(c))) == "KEY|some value"


def test_chunks(spark):
    rows = [("f#file", "f", "file", "Title of this file", "body words of some file", 1, 0, []), ("f#1", "f", "heading", "Head", "tiny", 20, 1, ["Head"]), ("f#2", "f", "heading", "Deep", None, 30, 3, ["Head", "Deep"]), ("g#1", "g", "heading", "Alone", "enough words here to be kept as chunk", 1, 1, [])]
    t = spark.createDataFrame(rows, "key string, path string, kind string, title string, body string, position bigint, level int, outline_path array<string>")
    texts = {r["key"]: r["text"] for r in chunking.passages(t).collect()}
    assert texts["f#file"] == "Title of this file\nHead\nbody words of some file"
    assert texts["f#1"] == "Title of this file\n\nHead\n\ntiny" and texts["g#1"].startswith("Alone\n\nenough")
    got = {r["key"] for r in chunking.chunks(t).collect()}
    assert got == {"f#file#chunk:0", "g#1#chunk:0"}  # f#1 has five words of three letters
    v = spark.createDataFrame([("m", r["text_digest"], [1.0]) for r in chunking.chunks(t).filter("target_key = 'g#1'").collect()], "model_id string, text_digest string, vector array<float>")
    c = chunking.chunks(t)
    cover = chunking.coverage(c, v, "m").first()
    assert cover["covered"] == 1 and cover["total"] == c.count() and chunking.pending(c, v, "m").count() == cover["total"] - 1
    assert chunking.coverage(c.limit(0), v, "m").first()["total"] == 0


def vectors_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "digest bigint, vector array<float>")


def brute_score(x, q, lam=0.5, k=10):
    x = x.astype(np.float32).astype(float)
    mean = x.mean(0)
    c = x - mean
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    s = c @ c.T
    np.fill_diagonal(s, -np.inf)
    hub = np.array([np.mean(np.sort(r)[::-1][: min(k, len(x) - 1)]) if len(x) > 1 else 0.0 for r in s])
    qq = q - mean
    qq = qq / max(np.linalg.norm(qq), 1e-12)
    raw = c @ qq - lam * hub
    return hub, raw, (raw - np.median(raw)) / (raw.std() or 1e-9)


@pytest.mark.parametrize("n,block", [(1, 1024), (11, 4), (23, 7), (23, 1024)])
def test_hub_and_score(spark, n, block):
    rng = np.random.default_rng(n)
    x, q = rng.normal(size=(n, 6)), rng.normal(size=6)
    rows = vectors_of(spark, x).repartition(3)
    mean = scoring.mean_array(rows)
    cent = scoring.centred(rows, mean)
    hub = scoring.hubs(cent, block=block)
    want_hub, raw, z = brute_score(x, q)
    got = dict(hub.collect())
    assert np.allclose([got[i] for i in range(n)], want_hub, atol=1e-9)
    s = {r["digest"]: r for r in scoring.score(cent, hub, mean, list(q)).collect()}
    assert np.allclose([s[i]["score"] for i in range(n)], raw, atol=1e-6)
    if n > 1:
        assert np.allclose([s[i]["z"] for i in range(n)], z, atol=1e-4)
    else:
        assert s[0]["z"] == 0


def test_gate_and_restriction(spark):
    x = np.random.default_rng(1).normal(size=(12, 5))
    rows = vectors_of(spark, x)
    mean = scoring.mean_array(rows)
    cent = scoring.centred(rows, mean)
    hub = scoring.hubs(cent)
    hard = Config(semantic_min_z=100.0)
    q = [1.0] * 5
    assert scoring.top(scoring.score(cent, hub, mean, q), 50, hard).count() == 0
    few = rows.filter("digest < 6").select("digest")
    assert scoring.top(scoring.score(cent, hub, mean, q, digests=few), 50, hard).count() == 6
    assert scoring.score(cent, hub, mean, q, digests=rows.filter("digest > 99").select("digest")).count() == 0
    assert scoring.top(scoring.score(cent, hub, mean, q), 2, Config(semantic_min_z=-99.0)).count() == 2
    none = rows.limit(0)
    assert scoring.hubs(scoring.centred(none, [])).count() == 0


def test_semantic_provider(spark):
    from loomseek.operators.filters import Filters
    from loomseek.plans.search import Corpus, search_api, semantic_provider
    from test_search import targets

    words = ["apple pie recipe", "car engine repair", "garden plants water", "tax form letter", "apple tart recipe"]
    t = targets(spark, [{"title": w, "body": w, "level": 1 + i % 2} for i, w in enumerate(words)])
    ch = t.selectExpr("key || '#chunk:0' as key", "key as target_key", "path", "0 as ord", "body as text", "sha2(body, 256) as text_digest")
    v = ch.select(F.lit("m").alias("model_id"), "text_digest", V.hash_embedder(64)("text").alias("vector"))
    c = Config(model="m", semantic_min_z=0.0)
    p = semantic_provider(lambda q: list(V.embed_text(q, 64)), v, ch, t, c)
    got = search_api(Corpus(t, semantic=p, config=c), "apple recipe", modes=["semantic", "lexical"])
    assert {r["title"] for r in got.results.filter("rank <= 2").collect()} == {words[0], words[4]} and got.used == ["semantic", "lexical"]
    assert "semantic #" in got.results.first()["match_reason"]
    pre = semantic_provider(lambda q: list(V.embed_text(q, 64)), v, ch, t, c, prefilter=True)
    assert pre("apple recipe", Filters(exclude_titles=(words[0],)), 5).filter("key = 'k000'").count() == 0


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = df.select(V.normalize(F.col("v")).alias("n"), V.decode_vector(V.encode_vector("v")).alias("d")).collect()
    assert got[0]["n"] == pytest.approx([0.6, 0.8]) and got[1]["n"] == [0.0, 0.0] and got[0]["d"] == [3.0, 4.0] and got[2]["d"] is None
    assert np.allclose(V.embed_text("A a b", 16), V.embed_text("a A B", 16)) and V.embed_text("", 4).tolist() == [0, 0, 0, 0]


KV = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KV)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), KV)
    assert t.read().count() == 0 and t.changes(0).count() == 0
    t.commit(rows(spark, (1, "a"), (2, "b"), (2, "b")))
    t.commit(rows(spark, (2, "c"), (3, None)), rows(spark, (2, None)), ["k"])
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted([(1, "a"), (2, "c"), (3, None)], key=str)
    assert t.read(1).count() == 3
    assert sorted((r["k"], r["change"]) for r in t.changes(1, 2).collect()) == [(2, "added"), (2, "removed"), (2, "removed"), (3, "added")]
    assert sorted(r["k"] for r in t.changes(0, 2).filter("change = 'added'").collect()) == [1, 2, 3]
    t.compact()
    assert t.read().count() == 3 and t.latest().deletions == ()
    last = t.latest()
    with pytest.raises(CommitConflict):
        t._publish(last)
    # a compaction changes no record, also if records change after it
    assert t.changes(2, 3).count() == 0 and t.changes(0, 3).count() == 3
    t.commit(rows(spark, (9, "z")), rows(spark, (1, None)), ["k"])
    assert sorted(map(tuple, t.changes(2).collect())) == [(1, "a", "removed"), (9, "z", "added")]
    assert sorted((r["k"], r["change"]) for r in t.changes(1).collect()) == [(1, "removed"), (2, "added"), (2, "removed"), (2, "removed"), (3, "added"), (9, "added")]
    # what comes and goes between two versions is no change; nor is an equal row in a new file
    t.commit(rows(spark, (7, "q")))
    t.commit(rows(spark, (2, "c"), (3, None), (9, "z"), (9, "z")), replace=True)
    assert sorted(map(tuple, t.changes(4).collect())) == [(9, "z", "added")] and t.read().count() == 4


def test_changes_of_maps(spark, tmp_path):
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("m", T.MapType(T.StringType(), T.StringType()))])
    t = VersionedTable(spark, str(tmp_path / "t"), kind)
    t.commit(spark.createDataFrame([(1, {"a": "x"}), (2, None)], kind))
    t.commit(spark.createDataFrame([(1, {"a": "x"}), (3, {"a": None})], kind), replace=True)
    assert sorted((r["k"], r["m"], r["change"]) for r in t.changes(1).collect()) == [(2, None, "removed"), (3, {"a": None}, "added")]


def test_two_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from loomseek.operators.manifest import Manifest

    t = VersionedTable(spark, str(tmp_path / "t"), KV)

    def publish(i):
        try:
            return t._publish(Manifest(1, (), (), {"writer": i})).processed["writer"]
        except CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(publish, range(40)) if i is not None]
    assert len(won) == 1 and t.latest().processed == {"writer": won[0]}


def test_two_writers_without_links(spark, tmp_path, monkeypatch):
    from loomseek.operators import manifest

    monkeypatch.setattr(manifest.os, "link", lambda a, b: (_ for _ in ()).throw(PermissionError("no links")))
    t = VersionedTable(spark, str(tmp_path / "t"), KV)
    t._publish(manifest.Manifest(1, (), (), {"writer": 1}))
    with pytest.raises(CommitConflict):
        t._publish(manifest.Manifest(1, (), (), {"writer": 2}))
    assert t.latest().processed == {"writer": 1}


def test_ledger(spark, tmp_path):
    at = f"file://{tmp_path}/ledger"
    state = lambda *r: spark.createDataFrame([("chunks", k, None, d) for k, d in r], incremental.STATE)
    ledger = incremental.Ledger(spark, at)
    ledger.look(state(("a", "1"), ("b", "1")))
    seen = lambda version: sorted((r["rec_key"], r["digest"], r["change"]) for r in ledger.rows(version).collect())
    first = ledger.run()
    assert seen(first) == [("a", "1", "added"), ("b", "1", "added")]
    ledger.look(state(("a", "1"), ("b", "2")))

    def fails(deltas):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(fails)
    ledger = incremental.Ledger(spark, at)  # another session
    ledger.look(state(("a", "1"), ("b", "2"), ("c", "1")))
    ledger.state.compact()
    taken = []
    second = ledger.run(lambda d: taken.append(d.count()))
    assert seen(second) == [("b", "1", "removed"), ("b", "2", "added"), ("c", "1", "added")] and taken == [3] and ledger.processed() == 4
    assert ledger.run() == second and ledger.taken.read().count() == 5
    ledger.look(state(("a", "1"), ("b", "2"), ("c", "1")))
    assert seen(ledger.run()) == []


def test_incremental_runs_survive_failure(spark, tmp_path):
    src, out = VersionedTable(spark, str(tmp_path / "s"), KV), VersionedTable(spark, str(tmp_path / "o"), KV)
    work = lambda d: d.filter("change = 'added'").select("k", F.upper("v").alias("v"))
    src.commit(rows(spark, (1, "a")))
    run_incremental(src, out, work, ["k"])
    src.commit(rows(spark, (1, "b"), (2, "x")), rows(spark, (1, None)), ["k"])

    def fails(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_incremental(src, out, fails, ["k"])
    # written but never published
    keep, out._publish = out._publish, lambda m: (_ for _ in ()).throw(OSError())
    with pytest.raises(OSError):
        run_incremental(src, out, work, ["k"])
    out._publish = keep
    assert sorted(map(tuple, out.read().collect())) == [(1, "A")]
    run_incremental(src, out, work, ["k"])
    run_incremental(src, out, work, ["k"])
    assert sorted(map(tuple, out.read().collect())) == [(1, "B"), (2, "X")] and out.latest().version == 2


def at(day):
    return datetime.datetime(2024, 1, day)


def test_pending_records(spark):
    sources = spark.createDataFrame([("/new", "r", "D1", at(1), 9), ("/same", "r", "AB", at(1), 9), ("/same", "r", "AB", at(1), 9), ("/late", "r", "new", at(3), 9), ("/late", "r", "old", at(1), 9), ("/bad", "r", None, at(2), 9), ("/bad", "r", "x", at(1), 9), ("/moved", "q", "d", at(1), 9), ("/back", "r", "d", at(1), 9), (None, "r", "d", at(1), 9)], "path string, root string, digest string, seen_at timestamp, change int")
    log = spark.createDataFrame([(1, "/same", "r", "ab", "added", at(1)), (2, "/same", "r", "zz", "failed", at(2)), (3, "/same", "r", "zz", "changed", at(3)), (1, "/late", "r", "new", "added", at(1)), (1, "/moved", "r", "d", "added", at(1)), (1, "/back", "r", "d", "added", at(1)), (2, "/back", "r", None, "removed", at(2)), (3, "/new", "r", "d1", "added", at(3))], "run_id int, path string, root string, digest string, outcome string, logged_at timestamp")
    runs = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "failed")], "run_id int, state string")
    chunks = spark.createDataFrame([("t1",), ("t1",), ("t2",), ("t3",), ("t4",), (None,)], "text_digest string")
    nan = float("nan")
    vectors = spark.createDataFrame([("lantern-s", "t1", 2, [1.0, 0.0]), ("lantern-s", "t2", 2, [1.0]), ("lantern-s", "t3", 2, [1.0, nan]), ("other", "t4", 2, [1.0, 1.0]), ("lantern-s", None, 1, None)], "model_id string, text_digest string, dim int, vector array<float>")
    got = {(r["tab"], r["rec_key"]) for r in incremental.found(sources, log, runs, chunks, vectors).collect()}
    assert got == {("sources", "/new"), ("sources", "/moved"), ("sources", "/back"), ("chunks", "t2"), ("chunks", "t3"), ("chunks", "t4")}
    none = incremental.found(*(d.limit(0) for d in (sources, log, runs, chunks, vectors)))
    assert none.count() == 0


def test_removed_records(spark):
    sources = spark.createDataFrame([("/same", "r", "AB", at(1)), ("/bad", "r", None, at(2)), ("/bad", "r", "d", at(1)), ("/moved", "q", "d", at(1)), ("/new", "r", "d", at(1))], "path string, root string, digest string, seen_at timestamp")
    log = spark.createDataFrame([(1, p, "r", d, "added", at(1)) for p, d in (("/same", "ab"), ("/bad", "d"), ("/moved", "d"), ("/gone", "d"))] + [(1, "/left", "r", "d", "removed", at(1))], "run_id int, path string, root string, digest string, outcome string, logged_at timestamp")
    runs = spark.createDataFrame([(1, "ok")], "run_id int, state string")
    chunks = spark.createDataFrame([("t1",), ("t2",), (None,)], "text_digest string")
    vectors = spark.createDataFrame([("lantern-s", "t1", 1, [1.0]), ("lantern-s", "t9", 1, [1.0]), ("lantern-s", "t9", 1, [1.0])], "model_id string, text_digest string, dim int, vector array<float>")
    got = {(r["rec_key"], r["root"], r["change"]) for r in incremental.pending(sources, log, runs, chunks, vectors).collect()}
    assert got == {("/new", "r", "added"), ("/moved", "q", "added"), ("/moved", "r", "removed"), ("/gone", "r", "removed"), ("t2", None, "added"), ("t9", None, "removed")}


def test_chunk_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("f", "p", "file", "Title of it", "some words of the file's own body", 1, 0, []), ("k1", "p", "heading", "Head", "several words that make this chunk long enough", 2, 1, ["Head"]), ("k2", "p", "heading", "T", "short", 3, 2, ["T"])]
    t = spark.createDataFrame(rows, "key string, path string, kind string, title string, body string, position bigint, level int, outline_path array<string>")
    t.write.parquet(str(src))
    stream = spark.readStream.schema(t.schema).parquet(str(src))
    for _ in range(2):
        updates.chunk_stream(stream, t, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "text_digest").collect()))
    assert got == sorted(map(tuple, chunking.chunks(t).select("key", "text_digest").collect())) and len(got) == 2
