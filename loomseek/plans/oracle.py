"""DuckDB SQL with the same results as the core's queries."""

from __future__ import annotations

from loomseek.functions import text
from loomseek.operators.textindex import query_words
from loomseek.plans.queries import INBOX, MODEL, NAMES_ASKED, PHRASE, SEARCHES, TITLE, TYPO

_Q = text.trigrams(TYPO)

NOTES = """t as (select target_key as key, path, kind, title, body, org_id, char_position as position, digest, heading_level as level, outline_path, properties
 from targets qualify row_number() over (partition by target_key order by indexed_at desc) = 1)"""
PARTS = """p as (select 'part:' || p_partkey as key, '/parts/' || p_brand || '/' || p_partkey as path, 'heading' as kind, p_name as title, p_type as body, p_size::bigint as position from part)"""
RUNS = """n as (select path, o.root as root, o.digest as digest from (select path, arg_max({'ok': digest is not null, 'digest': lower(digest), 'root': root}, {'t': seen_at, 'k': digest is not null, 'd': lower(digest), 'r': root}) as o
 from sources where path is not null group by path) where o.ok),
l as (select path, o.root as root, o.digest as digest from (select path, arg_max({'outcome': outcome, 'digest': lower(digest), 'root': root}, {'i': run_id, 't': logged_at, 'o': outcome, 'd': lower(digest), 'r': root}) as o
 from run_log where path is not null and (outcome is null or outcome <> 'failed') and run_id in (select run_id from index_runs where state = 'ok') group by path)
 where o.outcome is null or o.outcome <> 'removed')"""


def fold(x: str) -> str:
    return f"translate(regexp_replace(lower({x}), '\\p{{Mn}}+', '', 'g'), '{text.MARKED}', '{text.PLAIN}')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(f'coalesce({x}, chr(32))')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def prop(name: str) -> str:
    return f"list_filter(map_entries(properties), lambda e: lower(e.key) = '{name}')[1].value"


def _select(columns: str, where: str = "true", source: str = NOTES, name: str = "t") -> str:
    return f"with {source} select {columns} from {name} where {where}"


def trim(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def strip_noise(x: str) -> str:
    x = f"coalesce({x}, '')"
    for pattern in text.NOISE:
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return trim(x)


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{M}}]+'), lambda w: length(w) >= 3))"


CONTEXT = "case when kind = 'file' then title when len(outline_path) > 0 then array_to_string(outline_path, ' > ') else title end"


def bm25(query: str, source: str = NOTES, name: str = "t") -> str:
    """CTEs that end in b(key, bm25)."""
    ctes, joins, scores = [], [], []
    for i, w in enumerate(query_words(query)):
        def count(col: str, w=w) -> str:
            whole = " and ".join([f"{col}[i + {k}] = '{x}'" for k, x in enumerate(w[:-1])] + [f"starts_with({col}[i + {len(w) - 1}], '{w[-1]}')"])
            return f"len(list_filter(range(1, len({col}) - {len(w) - 2}), lambda i: {whole}))"

        ctes.append(f"h{i} as (select * from (select key, {count('tt')} + {count('tb')} as f from tok) where f > 0)")
        joins.append(f"join h{i} on h{i}.key = tok.key")
        idf = f"ln((s.n - c{i}.n + 0.5) / (c{i}.n + 0.5))"
        scores.append(f"(case when {idf} <= 0 then 1e-6 else {idf} end) * h{i}.f * 2.2 / (h{i}.f + 1.2 * (0.25 + 0.75 * tok.d / s.a))")
    counts = ", ".join(f"(select count(*) as n from h{i}) c{i}" for i in range(len(ctes)))
    return (
        f"{source}, tok as (select *, len(tt) + len(tb) as d from (select key, {tokens('title')} as tt, {tokens('body')} as tb from {name})), s as (select count(*) as n, avg(d) as a from tok), "
        + ", ".join(ctes)
        + f", b as (select tok.key, {' + '.join(scores)} as bm25 from tok {' '.join(joins)}, s, {counts})"
    )


def lexical(query: str) -> str:
    return f"with {bm25(query)} select key, round(bm25, 8) as bm25 from b"


SIM = f"100.0 * (greatest(1, {len(PHRASE)}, length(title)) - levenshtein(lower(title), '{{q}}')) / greatest(1, {len(PHRASE)}, length(title))"


def fuzzy(query: str) -> str:
    grams = " or ".join(f"contains(lower(title), '{g}')" for g in text.trigrams(query))
    return (
        f"fc as (select * from p where {grams} order by title, path, position limit 500), "
        f"fz as (select *, {SIM.format(q=query)} as similarity from fc where {SIM.format(q=query)} >= 60)"
    )


VECTORS = """e as (select vec_id as digest, embedding::double[] as v from embeddings),
mc as (select pos, avg(x) as m from (select generate_subscripts(v, 1) as pos, unnest(v) as x from e) group by pos), mean as (select list(m order by pos) as m from mc),
sh as (select digest, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) as s from e, mean),
cent as (select digest, list_transform(s, lambda x: x / greatest(sqrt(list_inner_product(s, s)), 1e-12)) as c from sh)"""
HUBS = """sims as (select a.digest, list_inner_product(a.c, b.c) as s, row_number() over (partition by a.digest order by list_inner_product(a.c, b.c) desc) as r from cent a, cent b where a.digest <> b.digest),
hub as (select digest, avg(s) as hub from sims where r <= 10 group by digest)"""


def scored(pool: str = "true") -> str:
    return (
        f"{VECTORS}, {HUBS}, q as (select list_transform(list_zip(v, m), lambda z: z[1] - z[2]) as s from e, mean where digest = 7), "
        "qq as (select list_transform(s, lambda x: x / greatest(sqrt(list_inner_product(s, s)), 1e-12)) as c from q), "
        "raw as (select cent.digest, list_inner_product(cent.c, qq.c) as cosine, list_inner_product(cent.c, qq.c) - 0.5 * hub.hub as score from cent join hub on cent.digest = hub.digest, qq), "
        f"cand as (select * from raw where {pool}), st as (select median(score) as med, case when stddev_pop(score) = 0 then 1e-9 else stddev_pop(score) end as sd, count(*) as pool from cand), "
        "z as (select digest, cosine, score, (score - med) / sd as z, pool from cand, st)"
    )


_SHOWN = "digest, round(cosine, 6) as cosine, round(score, 6) as score, round(z, 4) as z"


def hits(*modes: str) -> str:
    """CTEs that end in x(key, mode, seq, rank, raw, z, c)."""
    ctes, parts = [bm25(PHRASE, PARTS, "p"), fuzzy(PHRASE)], []
    row = "select key, '{m}' as mode, {seq} as seq, row_number() over (order by {o}) - 1 as rank, {raw} as raw, {z} as z from {src}"
    synth = "greatest(85.0, 94.0 - rank * 0.01)"
    for m in modes:
        if m == "exact":
            ctes.append(f"x_exact as (select key, 'exact' as mode, 1 as seq, row_number() over (order by path, position) - 1 as rank, 100.0 as raw, null::double as z from (select * from p where title = '{PHRASE}' order by path, position limit 50))")
        elif m == "lexical":
            ctes.append(f"x_lexical as (select *, {synth} as raw, null::double as z from (select key, 'lexical' as mode, 3 as seq, row_number() over (order by bm25 desc, path, position) - 1 as rank from (select p.*, b.bm25 from b join p on p.key = b.key order by bm25 desc, path, position limit 50)))")
        elif m == "fuzzy":
            ctes.append("x_fuzzy as (" + row.format(m=m, seq=4, o="similarity desc, title desc, path desc, position desc", raw="similarity * 0.84", z="null::double", src="(select * from fz order by similarity desc, title desc, path desc, position desc limit 50)") + ")")
        else:
            ctes.append(f"{scored()}, x_semantic as (" + row.format(m=m, seq=0, o="score desc, key", raw="score", z="z", src="(select w.* from (select 'part:' || digest as key, score, z from z where pool < 10 or z >= 2.0 order by score desc, digest limit 10) w where w.key in (select key from p))") + ")")
        parts.append(f"select key, mode, seq, rank, raw, z from x_{m}")
    weight = "(case mode when 'exact' then 1.0 when 'semantic' then 1.0 when 'lexical' then 0.8 else 0.3 end)::double"
    return ", ".join(ctes) + f", x as (select *, {weight} * (case when mode = 'semantic' then greatest(0.0, least(1.0, z / 5.0)) else 1.0 end) / (60.0 + rank + 1) as c from ({' union all '.join(parts)}))"


FUSED = """f as (select key, sum(c) as score, bool_or(mode = 'exact') as pinned, arg_max(mode, {'c': c, 's': seq}) as match_type, min({'s': seq, 'r': rank}) as first, count(*) as n_modes,
 string_agg(mode || ' #' || (rank + 1), ' + ' order by c desc, seq desc) as reason from x group by key),
top as (select *, row_number() over (order by pinned desc, score desc, first.s, first.r) as rank from f qualify rank <= 100),
g as (select *, score - coalesce(lead(score) over (order by rank), 0) as margin from top)"""

_FOUR = ("semantic", "exact", "lexical", "fuzzy")
_NAMES = "coalesce(" + prop("aliases") + ", '')"
_ALIAS = f"case when (length({_NAMES}) - length(replace({_NAMES}, chr(34), ''))) % 2 = 1 then [] else list_transform(regexp_extract_all({_NAMES}, '\"[^\"]*\"|[^\\s\"]+'), lambda a: replace(a, chr(34), '')) end"
_OUTLINE = "select path, max(case when kind = 'file' then title end) as title, list({'p': position, 'l': level, 't': title} order by position, level, title) filter (kind = 'heading') as h from t group by path"


def _accounted(limit: int, most: int, level: int) -> str:
    return f"""with {NOTES}, r as (select *, row_number() over (order by path, position, key) as place, coalesce(level >= {level}, false) as ok from t qualify place <= {most} + 1),
m as (select *, sum(ok::int) over (order by place) as nth from r), a as (select min(case when ok and nth = {limit} + 1 and place <= {most} then place end) as o, count(*) as n from m)
select coalesce(least(ceil(o / 100.0) * 100, {most}, n), least(n, {most}))::int as examined, o is not null as extra, (o is null and n >= {most}) as incomplete from a"""


P6 = f"""with {RUNS} select 'sources' as tab, n.path as rec_key from n left join l on n.path = l.path where l.path is null or l.digest is distinct from n.digest or l.root is distinct from n.root
union select 'chunks', text_digest from chunks where text_digest is not null and text_digest not in (select text_digest from vectors where model_id = '{MODEL}' and text_digest is not null and vector is not null and len(vector) = dim
 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0)"""
P6_CHANGES = f"""with {RUNS}, d as (select 'sources' as tab, path as rec_key, root, digest from l union select 'chunks', text_digest, null, null from vectors where model_id = '{MODEL}' and text_digest is not null and vector is not null and len(vector) = dim
 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0),
p as (select 'sources' as tab, path as rec_key, root, digest from n union select 'sources', path, root, digest from l where path in (select path from sources) and path not in (select path from n) union select 'chunks', text_digest, null, null from chunks where text_digest is not null)
select *, 'added' as change from (select * from p except select * from d) union all select *, 'removed' from (select * from d except select * from p)"""
DIFF = f"""with {RUNS}, d as (select coalesce(n.path, l.path) as path, case when l.path is null then 'added' when n.path is null then 'removed'
 when l.digest is not distinct from n.digest and l.root is not distinct from n.root then 'unchanged' else 'changed' end as status from n full join l on n.path = l.path)"""

OUTLINES = "o as (select path, max(case when kind = 'file' then title end) as file_title, coalesce(string_agg(title, chr(10) order by position, title) filter (kind = 'heading' and level <= 2), '') as outline from t group by path)"
PASSAGES = f"""{OUTLINES}, s as (select t.*, {strip_noise('body')} as clean, {CONTEXT} as context from t),
pas as (select key, case when kind = 'file' then concat_ws(chr(10), title, outline, clean) else concat_ws(chr(10) || chr(10), case when {words("concat_ws(' ', context, clean)")} < 6 then file_title end, context, clean) end as text from s join o on o.path = s.path)"""
#: Windows of paragraphs [s, e]: each ends with the paragraph that makes it full, and the next begins with that one again.
CHUNKS = f"""with recursive {NOTES}, {PASSAGES},
para as (select key, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: {trim('x')}), lambda x: x <> '') as ps from pas),
flat as (select key, unnest(range(1, len(ps) + 1)) as i, unnest(ps) as p from para),
c as (select *, length(p) + 1 as l, sum(length(p) + 1) over (partition by key order by i) as c from flat),
w as (select key, 0 as ord, 1::bigint as s, coalesce(min(i) filter (c >= 1500), max(i)) as e, coalesce(bool_or(c >= 1500), false) as full_ from c group by key
union all select w.key, w.ord + 1, w.e, coalesce(min(c.i) filter (c.i > w.e and c.c - z.c + z.l >= 1500), max(c.i)), coalesce(bool_or(c.i > w.e and c.c - z.c + z.l >= 1500), false) from w join c on c.key = w.key join c z on z.key = w.key and z.i = w.e where w.full_ group by w.key, w.ord, w.e),
x as (select w.key, w.ord, string_agg(c.p, chr(10) || chr(10) order by c.i) as text from w join c on c.key = w.key and c.i between w.s and w.e group by w.key, w.ord)
select key || '#chunk:' || ord as key, key as target_key, ord, sha256({trim('text')}) as text_digest from x where {words('text')} >= 6"""

_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SNIPPETS = f"""with {bm25('archive')}, best as (select key from b order by bm25 desc, key limit 100),
sw as (select t.key, list_filter(regexp_split_to_array(coalesce(t.body, ''), '{_SPACES}'), lambda x: x <> '') as w from t join best on best.key = t.key),
sh as (select *, list_transform(w, lambda x: (len(list_filter({tokens('x')}, lambda y: starts_with(y, 'archive'))) > 0)::int) as h, greatest(0, len(w) - 16) as last from sw),
sa as (select *, list_transform(range(0, last + 1), lambda i: coalesce(list_sum(h[i + 1:i + 16]), 0)) as d from sh),
sb as (select *, list_position(d, list_max(d)) - 1 as at0 from sa),
sc as (select *, case when coalesce(list_sum(h[at0 + 1:at0 + 16]), 0) > 0 then greatest(0, least(greatest(at0, at0 + list_position(h[at0 + 1:], 1) - 1 - 8), last)) else at0 end as "at" from sb)
select key, case when "at" > 0 then '…' else '' end || coalesce(array_to_string(list_transform(range("at" + 1, least("at" + 16, len(w)) + 1), lambda i: case when h[i] = 1 then '[' || w[i] || ']' else w[i] end), ' '), '') || case when "at" + 16 < len(w) then '…' else '' end as snippet from sc"""

DOCS = f"""d as (select doc_id as n, '/docs/' || doc_id || '.org' as path, coalesce(lang, 'none') as lang from documents),
f as (select *, '#+TITLE: Note ' || n || chr(10) || '#+PROPERTY: LANG ' || lang || chr(10) || 'intro of ' || n || chr(10) || 'more of it' || chr(10) || chr(10) || 'second paragraph' || chr(10) as a,
 '* TODO [#A] Head ' || n || ' :tag' || n % 7 || ':work:' || chr(10) || 'SCHEDULED: <2024-01-02 Tue>' || chr(10) || ':PROPERTIES:' || chr(10) || ':ID: id-' || n || chr(10) || ':KIND: k' || n % 3 || chr(10) || ':END:' || chr(10) || 'body of the head' || chr(10) || '| a | table |' || chr(10)
 || '#+begin_src sh' || chr(10) || 'echo x' || chr(10) || '#+end_src' || chr(10) || 'after it' || chr(10) as b,
 '** Child' || chr(10) || ':PROPERTIES:' || chr(10) || ':LANG: own' || chr(10) || ':END:' || chr(10) || '- item one' || chr(10) || '- [X] item two' || chr(10) || '[fn:1] a note' || chr(10) as c, '* DONE Last' || chr(10) as e from d),
r as (select *, sha256(a || b || c || e) as digest from f)"""
ORG_RECORDS = f"""with {DOCS}
select path || '#file' as key, 'file' as kind, 'Note ' || n as title, 'intro of ' || n || chr(10) || 'more of it' || chr(10) || 'second paragraph' as body, null as org_id, 1::bigint as position, 0 as level, '' as outline, lang, null as kind_of from r
union all select path || '@' || digest || '#heading:1', 'heading', 'Head ' || n, 'body of the head' || chr(10) || 'after it', 'id-' || n, length(a) + 1, 1, 'Head ' || n, lang, 'k' || n % 3 from r
union all select path || '@' || digest || '#heading:2', 'heading', 'Child', 'item one' || chr(10) || 'item two' || chr(10) || 'a note', null, length(a) + length(b) + 1, 2, 'Head ' || n || ' / Child', 'own', 'k' || n % 3 from r
union all select path || '@' || digest || '#heading:3', 'heading', 'Last', '', null, length(a) + length(b) + length(c) + 1, 1, 'Last', lang, null from r"""
ORG_OUTLINES = f"""with {DOCS} select path, 'Note ' || n as title, 3 as heading_count, true as truncated, '1|Head ' || n || '|TODO|false|A|tag' || n % 7 || ',work|id-' || n || '|Head ' || n || chr(10) || '2|Child|false||Head ' || n || ' / Child' as headings from r"""


def _provider(name: str, rows: str, order: str, left: str, pool: int, eligible: str) -> str:
    """CTEs of one provider under the budget: NAME_w(examined, incomplete, extra, stale) and NAME_r, its ranked rows."""
    return f"""{name}_n as (select *, row_number() over (order by {order}) as place from ({rows})), {name}_f as (select *, {eligible} as ok from {name}_n where place <= {left} + 1),
{name}_m as (select *, sum(ok::int) over (order by place) as nth from {name}_f),
{name}_a as (select min(case when ok and nth = {pool + 1} and place <= {left} then place end) as o, count(*) as n, {left} as budget from {name}_m),
{name}_w as (select coalesce(least(ceil(o / 100.0) * 100, budget, n), least(n, budget))::int as examined, o is null and n >= budget and n > 0 as incomplete, o is not null as extra from {name}_a),
{name}_s as (select m.* from {name}_m m, {name}_w w where m.place <= w.examined),
{name}_r as (select key, row_number() over (order by place) - 1 as rank from {name}_s where ok and nth <= {pool})"""


def search_sql(name: str, facts: bool) -> str:
    """A search of the notes with its budget: the ranked rows, or what the result-set says about itself."""
    query, limit, level, most = SEARCHES[name]
    pool, eligible = max(limit, 50), f"coalesce(not (kind = 'heading' and level > {level}), true)"
    grams = " or ".join(f"contains(lower(title), '{g}')" for g in text.trigrams(query))
    scale = f"greatest(1, {len(query)}, length(title))"
    similarity = f"100.0 * ({scale} - levenshtein(lower(title), '{query.lower()}')) / {scale}"
    synth = "greatest(85.0, 94.0 - rank * 0.01)"
    parts = f"""with {bm25(query)}, {RUNS}, {_provider('ex', f"select * from t where title = '{query}'", 'path, position', str(most), pool, eligible)},
l1 as (select {most} - examined as n from ex_w),
{_provider('lx', 'select t.*, b.bm25 from b join t on t.key = b.key', 'bm25 desc, path, position', '(select n from l1)', pool, eligible)},
l2 as (select l1.n - examined as n from l1, lx_w), cap as (select least(n, 500) as cap, n from l2),
fz_s as (select *, {similarity} as sim, {eligible} as ok from (select *, row_number() over (order by title, path, position) as place from t where {grams}) where place <= (select cap from cap)),
fz_g as (select * from fz_s where ok and sim >= 60 order by sim desc, title desc, path desc, position desc limit {pool}),
fz_c as (select count(*) as examined, count(*) filter (ok and sim >= 60) as good from fz_s),
fz_w as (select examined, examined >= cap and not good > {pool} and n <= 500 as incomplete, good > {pool} as extra from fz_c, cap),
x as (select key, 'exact' as mode, 1 as seq, rank, 1.0::double / (61.0 + rank) as c from ex_r union all select key, 'lexical', 3, rank, 0.8 / (61.0 + rank) from lx_r
union all select key, 'fuzzy', 4, row_number() over (order by sim desc, title desc, path desc, position desc) - 1 as rank, 0.3 / (60.0 + row_number() over (order by sim desc, title desc, path desc, position desc)) from fz_g),
f as (select key, sum(c) as score, bool_or(mode = 'exact') as pinned, arg_max(mode, {{'c': c, 's': seq}}) as match_type, min({{'s': seq, 'r': rank}}) as first,
 string_agg(mode || ' #' || (rank + 1), ' + ' order by c desc, seq desc) as reason, string_agg(case mode when 'lexical' then 'lex' else mode end, '+' order by c desc, seq desc) as via from x group by key)"""
    if not facts:
        return f"""{parts}, top as (select *, row_number() over (order by pinned desc, score desc, first.s, first.r) as rank from f qualify rank <= {limit})
select top.rank, top.key, match_type, reason as match_reason, via, round(score, 8) as score, n.digest is not distinct from t.digest as source_current from top join t on t.key = top.key left join n on n.path = t.path"""
    return f"""{parts}, q as (select ex_w.incomplete or lx_w.incomplete or fz_w.incomplete as incomplete, ex_w.extra or lx_w.extra or fz_w.extra or (select count(*) from f) > {limit} as extra, ex_w.examined + lx_w.examined + fz_w.examined as work from ex_w, lx_w, fz_w),
seen as (select path, digest from ex_s union select path, digest from lx_s union select path, digest from fz_s),
st as (select count(*) > 0 as stale from seen left join n on n.path = seen.path where n.digest is distinct from seen.digest)
select case when incomplete then 'incomplete' when extra then 'truncated' else 'complete' end as completeness, case when stale then 'stale-source-present' when (select count(*) from f) > 0 then 'sources-checked-current' else 'index-checked' end as freshness,
 incomplete or extra as truncated, work::int as work_examined, case when incomplete then 'incomplete' else 'False' end as degraded, case when (select n from l2) > 0 then 'exact lexical fuzzy' else 'exact lexical' end as used, 0 as n_errors, {limit} as row_limit from q, st"""


_GOOD = "vector is not null and len(vector) = dim and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and text_digest is not null"
NOTE_VECTORS = f"""e as (select text_digest as digest, min(vector)::double[] as v from vectors where model_id = '{MODEL}' and {_GOOD} and len(list_filter(vector, lambda x: x <> 0)) > 0 group by text_digest),
""" + VECTORS.split("\n", 1)[1]

SQL: dict[str, str] = {
    "p6_found": P6,
    "p6_changes": P6_CHANGES,
    "point_lookup_path": _select("key, kind, level", f"path = '{INBOX}'"),
    "point_lookup_id": _select("key, org_id", "org_id < '8'"),
    "point_lookup_key": _select("key, path, kind, title", f"key = '{INBOX}#file'"),
    "point_lookup_digest": "select distinct chunk_key as key, text_digest from chunks where text_digest < '08'",
    "presets": "select * from (values ('e5-small', 'intfloat/multilingual-e5-small', 384, 512, 'mean', 'query: ', 'passage: '), ('e5-base', 'intfloat/multilingual-e5-base', 768, 512, 'mean', 'query: ', 'passage: '), ('bge-m3', 'BAAI/bge-m3', 1024, 8192, 'cls', '', '')) p(name, model_id, dimension, most_tokens, pooling, query_prefix, passage_prefix)",
    "keyword_values": "select distinct word, upper(lang) as key, word || ' and more' as value from common_words where lang is not null and word is not null",
    "status_counts": f"""with {NOTES}, {RUNS}, c as (select distinct chunk_key, target_key, path, ord, text, text_digest from chunks), v as (select distinct text_digest from vectors where model_id = '{MODEL}' and {_GOOD})
select (select count(*) from l) as indexed_sources, (select count(*) from t) as indexed_targets, count(v.text_digest) as covered, count(*) as total from c left join v on c.text_digest = v.text_digest""",
    "snippet_prefix160": _select("key, substr(body, 1, 160) as snippet"),
    "context_lines": _select(f"key, {CONTEXT} as context"),
    "links": _select("key, case when org_id is not null then '[[id:' || org_id || '][' || title || ']]' else '[[file:' || path || '::' || position || '][' || title || ']]' end as link"),
    "path_codec": _select("key, array_to_string(outline_path, chr(31)) as joined, len(outline_path) as parts"),
    "properties_json": _select("key, properties['CATEGORY'] as category, cardinality(properties) as n", "properties is not null"),
    "filter_equals": _select("key", f"lower({prop('category')}) = 'ideas'"),
    "filter_not_equals": _select("key", f"coalesce(lower({prop('category')}), '') <> 'ideas'"),
    "filter_in": _select("key", f"lower({prop('category')}) in ('ideas', 'refs')"),
    "filter_not_in": _select("key", f"coalesce(lower({prop('category')}), '') not in ('ideas', 'refs')"),
    "filter_exists": _select("key", "coalesce(len(list_filter(map_keys(properties), lambda k: lower(k) = 'effort')) > 0, false)"),
    "filter_missing": _select("key", "not coalesce(len(list_filter(map_keys(properties), lambda k: lower(k) = 'effort')) > 0, false)"),
    "filter_property_equals": _select("key", "properties['CATEGORY'] = 'ideas' and properties['LANGUAGE'] = 'en'"),
    "filter_legacy_pair": _select("key", f"lower({prop('category')}) = 'ideas'"),
    "filter_max_level": _select("key", "not (kind = 'heading' and level > 1)"),
    "filter_exclude_titles": _select("key", "coalesce(lower(title) not in ('и что', 'note'), true)"),
    "filter_allowed_roots": _select("key", "starts_with(path, '/notes/personal/') or starts_with(path, '/notes/lab/')"),
    "filter_no_roots": _select("key", "false"),
    "accounting_extra": _accounted(20, 2000, 2),
    "accounting_budget": _accounted(50, 300, 4),
    "accounting_complete": _accounted(100000, 100000000, 1),
    "freshness": f"with {NOTES}, {RUNS} select key, (n.digest is not distinct from lower(t.digest)) as source_current from t left join n on n.path = t.path",
    "exact_title": f"with {PARTS} select key, path, position from p where title = '{PHRASE}' order by path, position limit 100",
    "exact_title_notes": _select("key", f"title = '{TITLE}'"),
    "alias_match": _select("key", "kind = 'file' and len(list_filter(" + _ALIAS + f", lambda a: lower(a) in ({', '.join(repr(n) for n in NAMES_ASKED)}))) > 0"),
    "alias_names": f"select key, n - 1 as n, a[n] as alias from (with {NOTES} select key, {_ALIAS} as a from t), unnest(range(1, 100)) as u(n) where n <= len(a)",
    "fuzzy_prefilter": f"with {PARTS} select key from p where " + " or ".join(f"contains(lower(title), '{g}')" for g in _Q),
    "fuzzy_titles": f"with {PARTS}, {fuzzy(TYPO)} select key, round(similarity, 6) as similarity, round(similarity * 0.84, 6) as raw_score from fz order by fz.similarity desc, title desc, path desc, position desc limit 50",
    "doc_lengths": _select(f"key, len({tokens('title')}) + len({tokens('body')}) as tokens"),
    "corpus_stats": f"with {NOTES} select count(*) as n, round(avg(len({tokens('title')}) + len({tokens('body')})), 6) as avg_tokens from t",
    "doc_freq": f"with {NOTES} select term, count(distinct key) as df from (select key, unnest(list_concat({tokens('title')}, {tokens('body')})) as term from t) group by term",
    "lexical_one": lexical("archive"),
    "lexical_and": lexical("budget Réunion"),
    "lexical_prefix": lexical("cal"),
    "lexical_phrase": lexical("of.the index"),
    "lexical_scan": lexical("of.the index"),
    "lexical_no_token": "select target_key as key, 0.0::double as bm25 from targets where false",
    "vector_mean": f"with {VECTORS} select pos - 1 as pos, round(m, 6) as mean from mc",
    "centred_norms": f"with {VECTORS} select digest, round(sqrt(list_inner_product(c, c)), 6) as norm, round(c[1], 6) as first from cent",
    "hubs": f"with {VECTORS}, {HUBS} select digest, round(hub, 6) as hub from hub",
    "semantic_scores": f"with {scored()} select {_SHOWN} from z",
    "semantic_topk": f"with {scored()} select {_SHOWN} from z where pool < 10 or z.z >= 2.0 order by z.score desc, digest limit 50",
    "semantic_small_pool": f"with {scored('digest < 7')} select {_SHOWN} from z where pool < 10 or z.z >= 3.0 order by z.score desc, digest limit 50",
    "vector_codec": "select vec_id as digest, ((len(embedding) * 4 + 2) // 3) * 4 as size, true as same from embeddings",
    "hash_embed": f"""with c as (select text_digest, min(text) as text from chunks group by 1), w as (select text_digest, list_filter(regexp_split_to_array(lower(text), '{_SPACES}'), lambda x: x <> '')[1:512] as w from c),
h as (select text_digest, (('0x' || substr(md5(x), 1, 8))::bigint % 64)::int as pos, count(*) as n from (select text_digest, unnest(w) as x from w) group by 1, 2),
t as (select text_digest, sqrt(sum(n * n)) as z from h group by 1) select h.text_digest, pos, round(n / z, 4) as x from h join t on t.text_digest = h.text_digest""",
    "semantic_targets": f"""with {NOTE_VECTORS}, {HUBS}, q as (select list_transform(list_zip(v, m), lambda z: z[1] - z[2]) as s from (select * from e order by digest limit 1), mean),
qq as (select list_transform(s, lambda x: x / greatest(sqrt(list_inner_product(s, s)), 1e-12)) as c from q),
cand as (select cent.digest, list_inner_product(cent.c, qq.c) - 0.5 * hub.hub as score from cent join hub on cent.digest = hub.digest, qq), st as (select median(score) as med, stddev_pop(score) as sd from cand),
best as (select digest, score, (score - med) / sd as z from cand, st where (score - med) / sd >= 1.0 order by score desc, digest limit 50),
own as (select text_digest, min(target_key) as target_key from chunks group by 1)
select target_key, round(max(score), 6) as score, round(arg_max(z, score), 4) as z from best join own on own.text_digest = best.digest group by target_key""",
    "pending_batch": f"select text_digest, min(text) as text from chunks where text_digest not in (select text_digest from vectors where model_id = '{MODEL}' and {_GOOD}) group by text_digest order by text_digest limit 32",
    "chunks": CHUNKS,
    "lexical_snippets": SNIPPETS,
    "org_records": ORG_RECORDS,
    "org_outlines": ORG_OUTLINES,
    "fused_display": f"""with {hits(*_FOUR)}, {FUSED}, v as (select key, string_agg(case when mode = 'semantic' then 'sem' || round_even(z, 0)::int when mode = 'lexical' then 'lex' else mode end, '+' order by c desc, seq desc) as via from x group by key)
select g.key, title, kind, regexp_extract(path, '([^/]*)$', 1) as source, match_type, case when g.rank % 2 = 1 then 'yes' else 'stale' end as fresh, v.via from g join p on p.key = g.key join v on v.key = g.key""",
    "normalized_norm": "select vec_id as digest, 1.0::double as norm from embeddings",
    "fused_two_modes": f"with {hits('exact', 'lexical')}, {FUSED} select rank, key, round(score, 8) as score, round(margin, 8) as margin, pinned, match_type, reason as match_reason from g",
    "fused_four_modes": f"with {hits(*_FOUR)}, {FUSED} select g.rank, g.key, round(g.score, 8) as score, round(margin, 8) as margin, pinned, match_type, n_modes, '[[file:' || path || '::' || position || '][' || title || ']]' as link from g join p on p.key = g.key",
    "fused_modes": f"with {hits(*_FOUR)} select key, mode, rank, round(raw, 6) as raw_score, round(z, 4) as z from x",
    "group_fuzzy": f"""with {hits('lexical', 'fuzzy')}, {FUSED}, j as (select g.*, p.title, regexp_extract(p.path, '^(.*)/[^/]*$', 1) as dir from g join p on p.key = g.key)
select arg_min(key, rank) as lead_key, arg_min(title, rank) as title, count(*) as n, string_agg(key, ' ' order by rank) as keys, min(rank) as rank from j group by case when match_type = 'fuzzy' then dir || chr(31) || title else key end""",
    "chunk_noise_strip": _select(f"key, {strip_noise('body')} as clean"),
    "chunk_word_count": f"select distinct chunk_key as key, {words('text')} as words, sha256({trim('text')}) as digest from chunks",
    "chunk_min_words": _select("key", f"{words('concat_ws(chr(32), title, ' + strip_noise('body') + ')')} < 6"),
    "file_outlines": f"with {NOTES} select path, max(case when kind = 'file' then title end) as file_title, coalesce(string_agg(title, chr(10) order by position, title) filter (kind = 'heading' and level <= 2), '') as outline from t group by path",
    "chunk_passages": f"""with {NOTES}, o as (select path, max(case when kind = 'file' then title end) as file_title, coalesce(string_agg(title, chr(10) order by position, title) filter (kind = 'heading' and level <= 2), '') as outline from t group by path),
s as (select t.*, {strip_noise('body')} as clean, {CONTEXT} as context from t)
select key, case when kind = 'file' then concat_ws(chr(10), title, outline, clean) else concat_ws(chr(10) || chr(10), case when {words("concat_ws(' ', context, clean)")} < 6 then file_title end, context, clean) end as text from s join o on o.path = s.path""",
    "coverage": f"with c as (select distinct chunk_key, target_key, path, ord, text, text_digest from chunks), v as (select distinct text_digest from vectors where model_id = '{MODEL}' and vector is not null) select count(v.text_digest) as covered, count(*) as total from c left join v on c.text_digest = v.text_digest",
    "pending_texts": f"select distinct text_digest from chunks where text_digest not in (select text_digest from vectors where model_id = '{MODEL}' and vector is not null)",
    "shared_texts": "select text_digest, count(*) as n, min(chunk_key) as first_key from (select distinct chunk_key, text_digest from chunks) group by 1 having count(*) > 1",
    "reconcile_diff": f"{DIFF} select path, status from d",
    "reconcile_counts": f"{DIFF} select status, count(*) as n from d group by status",
    "removed_sources": f"{DIFF} select path from d where status = 'removed'",
    "table_counts": f"with {NOTES} select kind, count(*) as n from t group by kind",
    "outline": f"with {NOTES}, o as ({_OUTLINE}) select path, title, coalesce(len(h), 0) as heading_count, coalesce(len(h), 0) > 500 as truncated, least(coalesce(len(h), 0), 500) as shown, coalesce(array_to_string(list_transform(h[1:500], lambda x: x.t), chr(10)), '') as titles from o",
    "outline_capped": f"with {NOTES}, o as ({_OUTLINE}) select path, coalesce(len(h), 0) as heading_count, coalesce(len(h), 0) > 5 as truncated, coalesce(len(list_filter(h[1:5], lambda x: x.l <= 2)), 0) as shown from o",
    "heading_ordinals": f"with {NOTES} select key, row_number() over (partition by path order by position) as n from t where kind = 'heading'",
    "resolve_status": f"""with {NOTES}, {RUNS}, i as (select org_id, count(*) as n, min({{'key': key, 'path': path, 'digest': digest}}) as o from t where org_id is not null group by org_id),
j as (select t.key, t.org_id, i.n, case when t.org_id is not null then i.o else {{'key': t.key, 'path': t.path, 'digest': t.digest}} end as o from t left join i on i.org_id = t.org_id)
select j.key, case when j.n > 1 then 'ambiguous' when n.digest is distinct from j.o.digest then 'stale' else 'ok' end as status from j left join n on n.path = j.o.path""",
}


SQL |= {f"search_{n}": search_sql(n, False) for n in SEARCHES} | {f"facts_{n}": search_sql(n, True) for n in SEARCHES}
SQL["search_notes"] = f"select rank, key, match_type, match_reason, via, score from ({search_sql('archive', False)})"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
