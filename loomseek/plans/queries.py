"""Registered queries of the core, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.config import PRESETS, Config
from loomseek.functions import text
from loomseek.functions import vectors as V
from loomseek.operators import budget, chunking, fusion, incremental, scoring, store, textindex
from loomseek.operators.filters import Filters, PropertyFilter
from loomseek.plans import corpora, search
from loomseek.session import table
from loomseek.sources import orgfile

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
INBOX = "/notes/personal/inbox/everything.org"
PHRASE = "red plate"
TITLE = "И что"
TYPO = "rde plate"
MODEL = "lantern-s"
NAMES_ASKED = ("den", "fenêtre", "delay", "with and", "est", "is", "la", "les", "son", "together", "print", "common", "journal", "wekelijks", "frase projeto", "sentence", "recipe narrow")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid answer over notes: exact, lexical and fuzzy, fused."""
    return search.search_api(corpus(spark, folder), "archive budget", 20, fuzzy=True).results.drop("properties")


def corpus(spark: SparkSession, folder: str, current: bool = False) -> search.Corpus:
    """The notes with their index, with ``current`` also the digests that their sources have now."""
    index, stats = corpora.text_index(spark, folder)
    now = incremental.seen_now(table(spark, folder, "sources")).select(F.col("rec_key").alias("path"), "digest") if current else None
    return search.Corpus(corpora.notes(spark, folder), index, stats, now)


# incremental processing ------------------------------------------------------


@query
def p6_found(spark, folder):
    return incremental.found(*(table(spark, folder, t) for t in ("sources", "run_log", "index_runs", "chunks", "vectors")))


@query
def p6_changes(spark, folder):
    return incremental.pending(*(table(spark, folder, t) for t in ("sources", "run_log", "index_runs", "chunks", "vectors"))).distinct()


# scans, lookups, projections ---------------------------------------------------


@query
def point_lookup_path(spark, folder):
    return corpora.notes(spark, folder, "key", "path", "kind", "level").filter(F.col("path") == INBOX).select("key", "kind", "level")


@query
def point_lookup_id(spark, folder):
    return corpora.notes(spark, folder, "key", "org_id").filter("org_id is not null and org_id < '8'")


@query
def point_lookup_key(spark, folder):
    return corpora.notes(spark, folder, "key", "path", "kind", "title").filter(F.col("key") == f"{INBOX}#file")


@query
def point_lookup_digest(spark, folder):
    return corpora.passages(spark, folder, "key", "text_digest").filter("text_digest < '08'")


@query
def presets(spark, folder):
    """The known models."""
    return spark.createDataFrame([(p.name, p.model_id, p.dimension, p.most_tokens, p.pooling, p.query_prefix, p.passage_prefix) for p in PRESETS.values()], "name string, model_id string, dimension int, most_tokens int, pooling string, query_prefix string, passage_prefix string")


@query
def keyword_values(spark, folder):
    line = F.concat(F.upper("lang"), F.lit(" \t "), "word", F.lit(" and more"))
    key, value = text.parse_keyword(line)
    return table(spark, folder, "common_words").filter("lang is not null and word is not null").select("word", key.alias("key"), value.alias("value")).distinct()


@query
def status_counts(spark, folder):
    """What the status of the index counts."""
    indexed = _states(spark, folder)[1].agg(F.count(F.lit(1)).alias("indexed_sources"))
    targets = corpora.notes(spark, folder, "key").agg(F.count(F.lit(1)).alias("indexed_targets"))
    cover = chunking.coverage(corpora.passages(spark, folder), incremental.usable_rows(table(spark, folder, "vectors"), MODEL), MODEL)
    return indexed.select("indexed_sources", targets.scalar().alias("indexed_targets"), cover.select("covered").scalar().alias("covered"), cover.select("total").scalar().alias("total"))


@query
def snippet_prefix160(spark, folder):
    return corpora.notes(spark, folder, "key", "body").select("key", F.substring("body", 1, 160).alias("snippet"))


@query
def context_lines(spark, folder):
    return corpora.notes(spark, folder, "key", "kind", "title", "outline_path").select("key", text.context_line().alias("context"))


@query
def links(spark, folder):
    return corpora.notes(spark, folder, "key", "org_id", "title", "path", "position").select("key", text.link().alias("link"))


@query
def path_codec(spark, folder):
    joined = corpora.notes(spark, folder, "key", "outline_path").withColumn("joined", text.join_path(F.col("outline_path")))
    return joined.select("key", "joined", F.size(text.split_path(F.col("joined"))).alias("parts"))


@query
def properties_json(spark, folder):
    rows = corpora.notes(spark, folder, "key", "properties").filter("properties is not null")
    back = text.parse_properties(F.to_json("properties"))
    return rows.select("key", F.try_element_at(back, F.lit("CATEGORY")).alias("category"), F.size(back).alias("n"))


# filters -------------------------------------------------------------------------


def _filtered(filters: Filters) -> Query:
    return lambda spark, folder: corpora.notes(spark, folder, "key", "path", "kind", "title", "level", "properties").filter(filters.column()).select("key")


def _property(op: str, key: str = "category", value: str | None = None, values: tuple[str, ...] = ()) -> Query:
    return _filtered(Filters(property_filters=(PropertyFilter(key, op, value, values),)))


QUERIES |= {
    "filter_equals": _property("equals", value="Ideas"),
    "filter_not_equals": _property("not-equals", value="ideas"),
    "filter_in": _property("in", values=("ideas", "REFS")),
    "filter_not_in": _property("not-in", values=("ideas", "refs")),
    "filter_exists": _property("exists", "Effort"),
    "filter_missing": _property("missing", "effort"),
    "filter_property_equals": _filtered(Filters(property_equals=(("CATEGORY", "ideas"), ("LANGUAGE", "en")))),
    "filter_legacy_pair": _filtered(Filters(property_key="CATEGORY", property_value="ideas")),
    "filter_max_level": _filtered(Filters(max_heading_level=1)),
    "filter_exclude_titles": _filtered(Filters(exclude_titles=("И ЧТО", "note"))),
    "filter_allowed_roots": _filtered(Filters(allowed_roots=("/notes/personal", "/notes/lab/"))),
    "filter_no_roots": _filtered(Filters(allowed_roots=())),
}


def _accounted(limit: int, most: int, level: int) -> Query:
    def run(spark, folder):
        rows = corpora.notes(spark, folder, "key", "path", "kind", "level", "position")
        n = budget.number(rows, [F.asc("path"), F.asc("position"), F.asc("key")], most, F.coalesce(F.col("level") >= level, F.lit(False)))
        return budget.account(n, limit, most, 100)

    return run


QUERIES |= {"accounting_extra": _accounted(20, 2000, 2), "accounting_budget": _accounted(50, 300, 4), "accounting_complete": _accounted(100000, 100000000, 1)}


@query
def freshness(spark, folder):
    now = incremental.seen_now(table(spark, folder, "sources")).select(F.col("rec_key").alias("path"), F.col("digest").alias("now"))
    rows = corpora.notes(spark, folder, "key", "path", "digest").join(now, "path", "left")
    return rows.select("key", F.col("now").eqNullSafe(F.lower("digest")).alias("source_current"))


# exact, alias, fuzzy -----------------------------------------------------------------


@query
def exact_title(spark, folder):
    return search.exact_title(corpora.parts(spark, folder), PHRASE, 100).select("key", "path", "position")


@query
def exact_title_notes(spark, folder):
    return corpora.notes(spark, folder, "key", "title").filter(F.col("title") == TITLE).select("key")


@query
def alias_match(spark, folder):
    rows = corpora.notes(spark, folder, "key", "kind", "path", "properties")
    files = search.alias_rows(rows, ("ALIASES",))
    hit = F.lit(False)
    for q in NAMES_ASKED:
        hit = hit | search.alias_match(("ALIASES",), f" {q.title()} ")
    return files.filter(hit).select("key")


@query
def alias_names(spark, folder):
    rows = corpora.notes(spark, folder, "key", "properties")
    return rows.select("key", F.posexplode(text.aliases(text.prop(F.col("properties"), "ALIASES"))).alias("n", "alias"))


@query
def fuzzy_prefilter(spark, folder):
    return search.fuzzy_candidates(corpora.parts(spark, folder), TYPO).select("key")


@query
def fuzzy_titles(spark, folder):
    rows = search.fuzzy_scored(corpora.parts(spark, folder), TYPO, 500)
    return rows.orderBy(*search.fuzzy_order()).limit(50).select("key", F.round("similarity", 6).alias("similarity"), F.round(F.col("similarity") * 0.84, 6).alias("raw_score"))


# lexical ---------------------------------------------------------------------------------


@query
def doc_lengths(spark, folder):
    return textindex.doc_stats(corpora.notes(spark, folder, "key", "title", "body"))


@query
def corpus_stats(spark, folder):
    s = textindex.corpus_stats(textindex.doc_stats(corpora.notes(spark, folder, "key", "title", "body")))
    return s.select("n", F.round("avg_tokens", 6).alias("avg_tokens"))


@query
def doc_freq(spark, folder):
    return textindex.doc_freq(corpora.text_index(spark, folder)[0])


def _lexical(q: str) -> Query:
    def run(spark, folder):
        rows = corpora.notes(spark, folder, "key", "title", "body")
        return textindex.search(rows, q, *corpora.text_index(spark, folder)).select("key", F.round("bm25", 8).alias("bm25"))

    return run


QUERIES |= {
    "lexical_one": _lexical("archive"),
    "lexical_and": _lexical("budget Réunion"),
    "lexical_prefix": _lexical("cal"),
    "lexical_phrase": _lexical("of.the index"),
    "lexical_no_token": _lexical("archive ["),
}


@query
def lexical_scan(spark, folder):
    """The phrase query answered from the texts, without postings."""
    return textindex.search(corpora.notes(spark, folder, "key", "title", "body"), "of.the index").select("key", F.round("bm25", 8).alias("bm25"))


@query
def lexical_snippets(spark, folder):
    rows = corpora.notes(spark, folder, "key", "title", "body")
    best = textindex.search(rows, "archive", *corpora.text_index(spark, folder)).orderBy(F.desc("bm25"), "key").limit(100)
    return best.join(rows, "key").select("key", textindex.snippet(F.col("body"), "archive").alias("snippet"))


# vectors -------------------------------------------------------------------------------


@query
def vector_mean(spark, folder):
    return scoring.mean_vector(corpora.embedded(spark, folder)).select("pos", F.round("mean", 6).alias("mean"))


def _centred(spark, folder):
    rows = corpora.embedded(spark, folder)
    mean = scoring.mean_array(rows)
    return rows, mean, scoring.centred(rows, mean)


@query
def centred_norms(spark, folder):
    rows, mean, cent = _centred(spark, folder)
    return cent.select("digest", F.round(V.norm(F.col("c")), 6).alias("norm"), F.round(F.get("c", F.lit(0)), 6).alias("first"))


@query
def hubs(spark, folder):
    return corpora.prepared_vectors(spark, folder)[2].select("digest", F.round("hub", 6).alias("hub"))


def _scored(spark, folder, digests: str | None = None):
    mean, cent, hub = corpora.prepared_vectors(spark, folder)
    asked = corpora.embedded(spark, folder).filter("digest = 7").first()["vector"]
    pool = cent.filter(digests).select("digest") if digests else None
    return scoring.score(cent, hub, mean, asked, digests=pool)



def _shown(df: DataFrame) -> DataFrame:
    return df.select("digest", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), F.round("z", 4).alias("z"))


@query
def semantic_scores(spark, folder):
    return _shown(_scored(spark, folder))


@query
def semantic_topk(spark, folder):
    return _shown(scoring.top(_scored(spark, folder), 50, Config(semantic_min_z=2.0)))


@query
def semantic_small_pool(spark, folder):
    return _shown(scoring.top(_scored(spark, folder, "digest < 7"), 50))


@query
def vector_codec(spark, folder):
    rows = corpora.embedded(spark, folder).withColumn("coded", V.encode_vector("vector"))
    return rows.select("digest", F.length("coded").alias("size"), (V.decode_vector("coded") == F.col("vector")).alias("same"))


@query
def hash_embed(spark, folder):
    """Whole texts, normalised counts of their tokens."""
    rows = corpora.passages(spark, folder, "text_digest", "text").groupBy("text_digest").agg(F.min("text").alias("text"))
    return rows.select("text_digest", F.posexplode(V.hash_embedder(64)("text")).alias("pos", "x")).filter("x > 0").select("text_digest", "pos", F.round("x", 4).alias("x"))


@query
def semantic_targets(spark, folder):
    """The best chunk of each target for a query, in the vectors of the model in use."""
    vectors = corpora.note_vectors(spark, folder)
    mean, cent, hub = corpora.prepared_notes(spark, folder)
    asked = vectors.orderBy("digest").first()["vector"]
    best = scoring.top(scoring.score(cent, hub, mean, asked), 50, Config(semantic_min_z=1.0))
    got = scoring.target_hits(best, table(spark, folder, "chunks"))
    return got.select("target_key", F.round("score", 6).alias("score"), F.round("z", 4).alias("z"))


@query
def normalized_norm(spark, folder):
    return corpora.embedded(spark, folder).select("digest", F.round(V.norm(V.normalize(F.col("vector"))), 6).alias("norm"))


# fusion ----------------------------------------------------------------------------------


def _hits(spark, folder) -> dict[str, DataFrame]:
    rows = corpora.parts(spark, folder)
    exact = rows.filter(F.col("title") == PHRASE).orderBy("path", "position").limit(50)
    lexical = textindex.search(rows, PHRASE).join(rows, "key").orderBy(F.desc("bm25"), "path", "position").limit(50)
    fuzzy = search.fuzzy_scored(rows, PHRASE, 500).orderBy(*search.fuzzy_order()).limit(50)
    semantic = scoring.top(_scored(spark, folder), 10, Config(semantic_min_z=2.0)).withColumn("key", F.concat(F.lit("part:"), F.col("digest").cast("string"))).join(rows.select("key"), "key", "left_semi")
    return {
        "exact": fusion.hits(exact, "exact", fusion.EXACT, [F.asc("path"), F.asc("position")]),
        "lexical": fusion.hits(lexical, "lexical", fusion.LEXICAL, [F.desc("bm25"), F.asc("path"), F.asc("position")]),
        "fuzzy": fusion.hits(fuzzy, "fuzzy", fusion.FUZZY, search.fuzzy_order(), F.col("similarity") * 0.84),
        "semantic": fusion.hits(semantic, "semantic", fusion.SEMANTIC, [F.desc("score"), F.asc("key")], F.col("score"), F.col("z")),
    }


def _answer(spark, folder, *modes: str) -> DataFrame:
    h = _hits(spark, folder)
    return fusion.finish(fusion.fuse([h[m] for m in modes]), corpora.parts(spark, folder), 100)


@query
def fused_two_modes(spark, folder):
    return _answer(spark, folder, "exact", "lexical").select("rank", "key", F.round("score", 8).alias("score"), F.round("margin", 8).alias("margin"), "pinned", "match_type", "match_reason")


@query
def fused_four_modes(spark, folder):
    got = _answer(spark, folder, "semantic", "exact", "lexical", "fuzzy")
    return got.select("rank", "key", F.round("score", 8).alias("score"), F.round("margin", 8).alias("margin"), "pinned", "match_type", F.size("modes").alias("n_modes"), "link")


@query
def fused_modes(spark, folder):
    h = _hits(spark, folder)
    got = fusion.fuse([h[m] for m in ("semantic", "exact", "lexical", "fuzzy")])
    return got.select("key", F.explode(fusion.modes()).alias("m")).select("key", "m.mode", "m.rank", F.round("m.raw_score", 6).alias("raw_score"), F.round("m.z", 4).alias("z"))


@query
def group_fuzzy(spark, folder):
    got = _answer(spark, folder, "lexical", "fuzzy").withColumn("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return fusion.group_results(got).select("lead_key", "title", "n", F.array_join("keys", " ").alias("keys"), "rank")


@query
def fused_display(spark, folder):
    """Rows of a results list, with the contributions in short."""
    got = _answer(spark, folder, "semantic", "exact", "lexical", "fuzzy").withColumn("source_current", F.col("rank") % 2 == 1)
    return fusion.display(got)


def _facts(got: search.ResultSet, spark: SparkSession) -> DataFrame:
    """What a result-set says about itself, as one row."""
    row = (got.completeness, got.freshness, got.truncated, got.work_examined, str(got.degraded), " ".join(got.used), len(got.provider_errors), got.limit)
    return spark.createDataFrame([row], "completeness string, freshness string, truncated boolean, work_examined int, degraded string, used string, n_errors int, row_limit int")


#: query, limit, deepest level, budget of rows to examine
SEARCHES = {"archive": ("archive budget", 20, 3, 2000), "title": (TITLE, 5, 2, 2000), "narrow": ("de la", 10, 1, 120)}


def _searched(name: str, spark: SparkSession, folder: str) -> search.ResultSet:
    q, limit, level, most = SEARCHES[name]
    c = corpus(spark, folder, True)
    c.config = Config(work_budget=most)
    return search.search_api(c, q, limit, fuzzy=True, filters=Filters(max_heading_level=level))


def _search_rows(name: str) -> Query:
    def run(spark, folder):
        got = _searched(name, spark, folder).results
        return got.select("rank", "key", "match_type", "match_reason", "via", F.round("score", 8).alias("score"), "source_current")

    return run


QUERIES |= {f"search_{n}": _search_rows(n) for n in SEARCHES} | {f"facts_{n}": lambda spark, folder, n=n: _facts(_searched(n, spark, folder), spark) for n in SEARCHES}


@query
def search_notes(spark, folder):
    got = search.search_api(corpus(spark, folder), "archive budget", 20, fuzzy=True, filters=Filters(max_heading_level=3)).results
    return got.select("rank", "key", "match_type", "match_reason", "via", F.round("score", 8).alias("score"))


# chunks -----------------------------------------------------------------------------------


@query
def chunk_noise_strip(spark, folder):
    return corpora.notes(spark, folder, "key", "body").select("key", text.strip_noise(F.col("body")).alias("clean"))


@query
def chunk_word_count(spark, folder):
    return corpora.passages(spark, folder, "key", "text").select("key", text.word_count(F.col("text")).alias("words"), text.digest(F.col("text")).alias("digest"))


@query
def chunk_min_words(spark, folder):
    return corpora.notes(spark, folder, "key", "title", "body").filter(text.word_count(F.concat_ws(" ", "title", text.strip_noise(F.col("body")))) < 6).select("key")


@query
def file_outlines(spark, folder):
    return chunking.file_outlines(corpora.notes(spark, folder, "path", "kind", "level", "position", "title"))


@query
def chunk_passages(spark, folder):
    return chunking.passages(corpora.notes(spark, folder, "key", "path", "kind", "title", "body", "level", "position", "outline_path")).select("key", "text")


@query
def chunks(spark, folder):
    rows = corpora.notes(spark, folder, "key", "path", "kind", "title", "body", "level", "position", "outline_path")
    return chunking.chunks(rows).select("key", "target_key", "ord", "text_digest")


@query
def coverage(spark, folder):
    return chunking.coverage(corpora.passages(spark, folder), table(spark, folder, "vectors").filter("vector is not null"), MODEL)


@query
def pending_texts(spark, folder):
    return chunking.pending(table(spark, folder, "chunks"), table(spark, folder, "vectors").filter("vector is not null"), MODEL).select("text_digest")


@query
def pending_batch(spark, folder):
    """The next texts to embed."""
    return store.next_batch(chunking.pending(table(spark, folder, "chunks"), incremental.usable_rows(table(spark, folder, "vectors"), MODEL), MODEL), 32)


@query
def shared_texts(spark, folder):
    rows = corpora.passages(spark, folder, "key", "text_digest").groupBy("text_digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))
    return rows.filter("n > 1")


# Org files ---------------------------------------------------------------------------------


def org_files(spark, folder) -> DataFrame:
    """(path, content, digest) of one Org file for each document."""
    d, n = F.col("doc_id").cast("string"), F.col("doc_id")
    parts = [
        F.lit("#+TITLE: Note "), d, F.lit("\n#+PROPERTY: LANG "), F.coalesce("lang", F.lit("none")), F.lit("\nintro of "), d, F.lit("\nmore of it\n\nsecond paragraph\n* TODO [#A] Head "), d,
        F.lit(" :tag"), (n % 7).cast("string"), F.lit(":work:\nSCHEDULED: <2024-01-02 Tue>\n:PROPERTIES:\n:ID: id-"), d, F.lit("\n:KIND: k"), (n % 3).cast("string"),
        F.lit("\n:END:\nbody of the head\n| a | table |\n#+begin_src sh\necho x\n#+end_src\nafter it\n** Child\n:PROPERTIES:\n:LANG: own\n:END:\n- item one\n- [X] item two\n[fn:1] a note\n* DONE Last\n"),
    ]
    rows = table(spark, folder, "documents", "doc_id", "lang").select(F.concat(F.lit("/docs/"), d, F.lit(".org")).alias("path"), F.concat(*parts).alias("content"))
    return rows.select("path", F.col("content").cast("binary").alias("content"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query
def org_records(spark, folder):
    rows = orgfile.project(org_files(spark, folder))
    props = [text.prop(F.col("properties"), k).alias(a) for k, a in (("LANG", "lang"), ("KIND", "kind_of"))]
    return rows.select("key", "kind", "title", "body", "org_id", "position", "level", F.array_join("outline_path", " / ").alias("outline"), *props)


@query
def org_outlines(spark, folder):
    rows = orgfile.outlines(org_files(spark, folder), 2)
    line = lambda h: F.concat_ws("|", h["level"].cast("string"), h["title"], h["todo_keyword"], h["closed"].cast("string"), h["priority"], F.array_join(h["tags"], ","), h["org_id"], F.array_join(h["outline_path"], " / "))
    return rows.select("path", "title", "heading_count", "truncated", F.array_join(F.transform("headings", line), "\n").alias("headings"))


# index maintenance --------------------------------------------------------------------------


def _states(spark, folder):
    found = incremental.seen_now(table(spark, folder, "sources")).select(F.col("rec_key").alias("path"), "root", "digest")
    indexed = incremental.logged(table(spark, folder, "run_log"), table(spark, folder, "index_runs")).select(F.col("rec_key").alias("path"), "root", "digest")
    return found, indexed


@query
def reconcile_diff(spark, folder):
    return store.diff(*_states(spark, folder)).select("path", "status")


@query
def reconcile_counts(spark, folder):
    return store.diff(*_states(spark, folder)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def removed_sources(spark, folder):
    found, indexed = _states(spark, folder)
    return store.removed(indexed, found)


@query
def table_counts(spark, folder):
    return corpora.notes(spark, folder, "key", "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def outline(spark, folder):
    rows = store.table_outlines(corpora.notes(spark, folder, "path", "kind", "level", "position", "title"))
    return rows.select("path", "title", "heading_count", "truncated", F.size("headings").alias("shown"), F.array_join(F.transform("headings", lambda h: h["title"]), "\n").alias("titles"))


@query
def outline_capped(spark, folder):
    rows = store.table_outlines(corpora.notes(spark, folder, "path", "kind", "level", "position", "title"), most=5, max_level=2)
    return rows.select("path", "heading_count", "truncated", F.size("headings").alias("shown"))


@query
def heading_ordinals(spark, folder):
    return store.ordinals(corpora.notes(spark, folder, "key", "path", "kind", "position"))


@query
def resolve_status(spark, folder):
    rows = corpora.notes(spark, folder, "key", "org_id", "path", "digest")
    now = incremental.seen_now(table(spark, folder, "sources")).select(F.col("rec_key").alias("path"), "digest")
    return store.resolve(rows, rows, now)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
