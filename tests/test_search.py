"""Providers, filters, budgets, fusion and result-sets."""

import pytest

from loomseek import schema
from loomseek.config import Config
from loomseek.errors import QueryError
from loomseek.functions import text
from loomseek.operators import fusion, textindex
from loomseek.operators.filters import Filters, PropertyFilter
from loomseek.plans import search
from loomseek.plans.search import Corpus, search_api


def targets(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"key": f"k{i:03d}", "path": f"/r/{i:03d}.org", "kind": "heading", "title": None, "body": None, "org_id": None, "position": 1, "digest": "d", "level": 1, "outline_path": [], "properties": {}}
        full.append(tuple((d | r)[c] for c in schema.target().fieldNames()))
    return spark.createDataFrame(full, schema.target())


def titles(result):
    return [r["title"] for r in result.results.orderBy("rank").collect()]


def test_filter_before_limit(spark):
    t = targets(spark, [{"title": "Topic", "properties": {"STATUS": "closed"}}] * 105 + [{"title": "Topic", "properties": {"STATUS": "open"}}])
    got = search_api(Corpus(t, config=Config(page_size=20)), "Topic", 1, filters=Filters(property_filters=(PropertyFilter("status", "equals", "OPEN"),)), modes=["exact"])
    assert [r["key"] for r in got.results.collect()] == ["k105"] and got.completeness == "complete" and got.work_examined == 106


def test_budget_makes_incomplete(spark):
    t = targets(spark, [{"title": "Topic", "properties": {"S": "x"}}] * 12)
    f = Filters(property_filters=(PropertyFilter("s", "missing"),))
    got = search_api(Corpus(t, config=Config(work_budget=5)), "Topic", 5, filters=f, modes=["exact"])
    assert got.results.count() == 0 and got.completeness == "incomplete" and got.degraded == "incomplete" and got.truncated and got.work_examined == 5


def test_limit_overflow_truncates(spark):
    t = targets(spark, [{"title": "Topic"}] * 4)
    got = search_api(Corpus(t), "Topic", 2, modes=["exact"])
    assert got.completeness == "truncated" and got.results.count() == 2 and got.truncated
    many = targets(spark, [{"title": "Topic"}] * 60)
    assert search_api(Corpus(many), "Topic", 2, modes=["exact"]).completeness == "truncated"


def test_fuzzy_cap_is_not_the_budget(spark):
    t = targets(spark, [{"title": f"Topic {'x' * 40} {i}"} for i in range(10)])
    assert search_api(Corpus(t, config=Config(fuzzy_candidates=5)), "Topic", modes=["fuzzy"]).completeness == "complete"
    assert search_api(Corpus(t, config=Config(work_budget=5)), "Topic", modes=["fuzzy"]).completeness == "incomplete"


def test_typo(spark):
    t = targets(spark, [{"title": "Knowledge Graph"}, {"title": "Something else"}, {"title": None}])
    got = search_api(Corpus(t), "Knowlege Grahp", fuzzy=True)
    assert titles(got) == ["Knowledge Graph"] and got.results.first()["match_type"] == "fuzzy"


def test_alias(spark):
    t = targets(spark, [{"title": "Store", "kind": "file", "properties": {"ALIASES": 'aistore ai.store OD "ai story"'}}, {"title": "Plain", "kind": "file"}, {"title": "H", "properties": {"ALIASES": "od"}}])
    c = Corpus(t, config=Config(alias_properties=("ALIASES",)))
    for q in ("od", "AI Story", "ai.store"):
        got = search_api(c, q, modes=["exact"])
        assert titles(got) == ["Store"] and got.work_examined == 1 and got.used == ["exact"]
    assert titles(search_api(c, "story", modes=["exact"])) == []
    assert search_api(Corpus(targets(spark, [{"title": "P", "kind": "file"}] * 20), config=c.config), "zz", modes=["exact"]).work_examined == 0
    both = search_api(Corpus(targets(spark, [{"title": "OD", "kind": "file", "properties": {"ALIASES": "OD"}}]), config=c.config), "OD", modes=["exact"]).results.first()
    assert both["score"] == pytest.approx(2 / 61) and len(both["modes"]) == 2


def test_property_filters(spark):
    t = targets(spark, [{"title": "a", "properties": {"Kind": "Note"}}, {"title": "b"}, {"title": "c", "properties": None}, {"title": "d", "properties": {"KIND": None}}])
    run = lambda *a, **k: sorted(r["title"] for r in t.filter(Filters(property_filters=(PropertyFilter("KIND", *a, **k),)).column()).collect())
    assert run("equals", "note") == ["a"] and run("not-equals", "note") == ["b", "c", "d"]
    assert run("in", values=("x", "NOTE")) == ["a"] and run("not_in", values=("note",)) == ["b", "c", "d"]
    assert run("exists") == ["a", "d"] and run("missing") == ["b", "c"] and run("in") == []
    assert t.filter(Filters(property_equals=(("Kind", "note"),)).column()).count() == 0
    with pytest.raises(QueryError):
        run("like", "x")
    levels = targets(spark, [{"title": "f", "kind": "file", "level": 0}, {"title": "h", "level": 3}])
    assert [r["title"] for r in levels.filter(Filters(max_heading_level=2).column()).collect()] == ["f"]
    assert levels.filter(Filters(allowed_roots=()).column()).count() == 0 and levels.filter(Filters(allowed_roots=("/r",)).column()).count() == 2


def test_empty_roots_reject_all(spark):
    got = search_api(Corpus(targets(spark, [{"title": "Topic"}])), "Topic", filters=Filters(allowed_roots=()))
    assert got.results.count() == 0 and got.completeness == "complete" and got.freshness == "index-checked"


def test_provider_errors_and_empty_corpus(spark):
    empty = Corpus(targets(spark, []))
    got = search_api(empty, "any thing", fuzzy=True)
    assert got.completeness == "complete" and got.to_dict()["results"] == []
    got = search_api(Corpus(targets(spark, [{"title": "Topic"}])), "Topic", modes=["semantic", "exact"])
    assert got.completeness == "incomplete" and got.degraded == "provider-error" and got.used == ["exact"] and got.provider_errors[0]["provider"] == "semantic" and titles(got) == ["Topic"]
    with pytest.raises(QueryError):
        search_api(empty, "x", modes=["guess"])
    with pytest.raises(QueryError):
        search_api(empty, None)
    assert search_api(empty, "   ", fuzzy=True).used == ["exact"]
    assert search.default_modes(empty) == ["exact", "lexical", "fuzzy"]


def test_fusion_values(spark):
    rows = [("a", "semantic", 0, 0, 0.9, 9.0), ("b", "semantic", 0, 1, 0.5, 2.5), ("b", "exact", 1, 0, 100.0, None), ("c", "lexical", 3, 0, 94.0, None), ("c", "fuzzy", 4, 0, 84.0, None), ("d", "other", 5, 0, 1.0, None)]
    df = spark.createDataFrame(rows, "key string, mode string, seq int, rank int, raw_score double, z double")
    got = {r["key"]: r for r in fusion.fuse([df]).withColumn("why", fusion.match_reason()).withColumn("via", fusion.modes_summary()).collect()}
    assert got["a"]["score"] == pytest.approx(1 / 61) and got["b"]["score"] == pytest.approx(0.5 / 62 + 1 / 61) and got["c"]["score"] == pytest.approx(1.1 / 61)
    assert got["b"]["pinned"] and not got["a"]["pinned"] and got["b"]["match_type"] == "exact" and got["c"]["match_type"] == "lexical" and got["d"]["score"] == 0
    assert got["b"]["why"] == "exact #1 + semantic #2 z2.5" and got["b"]["via"] == "exact+sem2" and got["c"]["via"] == "lex+fuzzy"
    tie = spark.createDataFrame([("t", "exact", 1, 0, 1.0, None), ("t", "exact", 2, 0, 1.0, None), ("t", "semantic", 0, 0, 1.0, 5.0)], df.schema)
    assert fusion.fuse([tie]).first()["match_type"] == "exact"


def test_rank_margin_and_link(spark):
    t = targets(spark, [{"title": "A", "org_id": "id1"}, {"title": "B", "position": 7}])
    h = spark.createDataFrame([("k000", "exact", 1, 0, 1.0, None), ("k001", "lexical", 3, 1, 1.0, None)], "key string, mode string, seq int, rank int, raw_score double, z double")
    a, b = fusion.finish(fusion.fuse([h]), t, 10).orderBy("rank").collect()
    assert a["link"] == "[[id:id1][A]]" and b["link"] == "[[file:/r/001.org::7][B]]" and a["margin"] == pytest.approx(a["score"] - b["score"]) and b["margin"] == pytest.approx(b["score"])


def test_display_rows(spark):
    t = targets(spark, [{"title": "Topic", "path": "/r/deep/one.org"}, {"title": "Other", "body": "a topic here"}])
    now = spark.createDataFrame([("/r/deep/one.org", "d"), ("/r/001.org", "newer")], "path string, digest string")
    got = sorted(tuple(r) for r in fusion.display(search_api(Corpus(t, current=now), "Topic").results).collect())
    assert got == [("k000", "Topic", "heading", "one.org", "exact", "yes", "exact+lex"), ("k001", "Other", "heading", "001.org", "lexical", "stale", "lex")]


def test_groups(spark):
    rows = [("k1", "/f", "Head", "heading", "fuzzy", False, 0.4, 2), ("k2", "/f", "Head", "heading", "fuzzy", False, 0.5, 1), ("k3", "/f", "Head", "heading", "exact", True, 0.9, 3)]
    df = spark.createDataFrame(rows, "key string, path string, title string, kind string, match_type string, pinned boolean, score double, rank int")
    got = sorted((r["lead_key"], r["n"], tuple(r["keys"])) for r in fusion.group_results(df).collect())
    assert got == [("k2", 2, ("k2", "k1")), ("k3", 1, ("k3",))]


def test_bm25_as_sqlite(spark):
    import sqlite3

    docs = [("Fruit list", "apples and pears, the apple pie"), ("Über café", "Straße naïve x_y apple-tart"), (None, "nothing here"), ("apple", None), ("Списки", "яблоко й ё"), ("", "ai.store and AI stores")] + [(f"filler {i}", "plain words " * (i + 1)) for i in range(8)]
    t = targets(spark, [{"title": a, "body": b} for a, b in docs])
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, body)")
    con.executemany("insert into f(rowid, title, body) values (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(docs)])
    index, stats = textindex.postings(t), textindex.doc_stats(t)
    for q in ("apple", "app", "fruit apple", "uber cafe", "ai.store", "list apple", "яблоко", "й", '"apple', "plain words", "the apple"):
        want = {f"k{i:03d}": round(-s, 9) for i, s in con.execute("select rowid, bm25(f) from f where f match ?", (textindex.match_expression(q),))}
        for got in (textindex.search(t, q), textindex.search(t, q, index, stats)):
            assert {r["key"]: round(r["bm25"], 9) for r in got.collect()} == want, q
    assert textindex.search(t, "apple [").count() == 0
    assert textindex.match_expression('say "hi') == '"say"* AND """hi"*'


def test_snippets():
    assert textindex.snippet_text("An apple a day", ["apple"]) == "An [apple] a day"
    long = "word " * 30 + "apple " + "tail " * 30
    s = textindex.snippet_text(long, ["apple"])
    assert s.startswith("…") and s.endswith("…") and "[apple]" in s and len(s.strip("…").split()) == 16
    assert textindex.snippet_text(None, ["x"]) == "" and textindex.snippet_text("w " * 20, ["x"]).endswith("…")


def test_trigrams():
    g = text.trigrams("Ab")
    assert g == ["  a", " ab", "ab ", "b  "] and len(text.trigrams("x".join(map(str, range(200))))) == 32


def test_a_word_reads_one_bucket(spark, tmp_path):
    import re

    t = targets(spark, [{"title": w, "body": f"{w} stands here"} for w in ("archive", "architect", "budget", "a")])
    at = str(tmp_path / "index")
    textindex.write_index(textindex.postings(t), at)
    index, stats = spark.read.parquet(at), textindex.doc_stats(t)
    for query, found in (("arch", 2), ("archive", 1), ("a", 3), ("archive.stands", 1), ("budget here", 1), ("zzz", 0)):
        got = textindex.search(t, query, index, stats)
        assert {r["key"] for r in got.collect()} == {r["key"] for r in textindex.search(t, query).collect()} and got.count() == found
        filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", got._jdf.queryExecution().toString())
        assert len(query) == 1 or all("bucket" in f for f in filters if f) and any("bucket" in f for f in filters), query
