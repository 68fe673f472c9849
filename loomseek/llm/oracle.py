"""DuckDB SQL with the same results, for the problems that SQL can express."""

from loomseek.llm.split import LIMIT

#: White space that trimming removes.
_SPACE = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_RECORDS = """r as (select distinct 'targets' as tab, target_key as rec_key, body as text from targets union select distinct 'chunks', chunk_key, text from chunks)"""


def words(x: str, digits: bool = True) -> str:
    kinds = r"\p{L}\p{N}" if digits else r"\p{L}\p{Nl}\p{No}"
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[{kinds}]+')"


def grams(source: str, keys: str, n: int) -> str:
    """Distinct n-grams of the word lists w of a relation."""
    return f"select distinct {keys}, array_to_string(w[i:i + {n - 1}], ' ') as g from (select {keys}, w, unnest(range(1, len(w) - {n - 2})) as i from {source})"


#: Usable vectors of unit length.
_UNIT = """u as (select distinct model_id, text_digest as d, vector::double[] as v from vectors where model_id is not null and text_digest is not null and vector is not null and len(vector) = dim and dim > 0
 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
n as (select model_id, d, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from u)"""

#: Classes of equal sets of three-word sequences, their members, and the similar ones among them.
_CLASSES = f"""{_RECORDS}, w as (select tab, rec_key, text, {words('text')} as w from r where rec_key is not null), d as (select *, hash(text) as h from w where len(w) >= 3),
g as ({grams('d', 'tab, rec_key, h', 3)}), s as (select tab, rec_key, h, md5(array_to_string(list_sort(list(g)), chr(10))) as id from g group by tab, rec_key, h),
m as (select distinct tab, id, rec_key from s), c as (select tab, id, min(rec_key) as first, count(*) as n from m group by tab, id),
cg as (select distinct tab, id, g from g join s using (tab, rec_key, h)), z as (select tab, id, count(*) as n from cg group by tab, id),
p as (select a.tab, a.id as a, b.id as b, count(*) as same from cg a join cg b on a.tab = b.tab and a.g = b.g and a.id < b.id group by all),
e as (select p.tab, p.a, p.b from p join z x on x.tab = p.tab and x.id = p.a join z y on y.tab = p.tab and y.id = p.b where 2 * same >= x.n + y.n - same),
l as (select tab, a, b from e union all select tab, b, a from e)"""

SQL: dict[str, str] = {
    "p2_classes": f"""with {_CLASSES}, k as (select tab, a as id, count(*) as n from l group by tab, a)
select m.tab, m.rec_key, c.first as class_key, c.n as copies, coalesce(k.n, 0) as links from m join c using (tab, id) left join k using (tab, id)""",
    "p2_groups": f"""with recursive {_CLASSES}, reach as (select tab, id as a, id as b from c union select reach.tab, reach.a, l.b from reach join l on l.tab = reach.tab and l.a = reach.b),
q as (select reach.tab, reach.a as id, min(c.first) as first, sum(c.n)::bigint as size from reach join c on c.tab = reach.tab and c.id = reach.b group by all)
select distinct m.tab, m.rec_key, m.tab || ':' || q.first as group_id, q.size from m join q using (tab, id) where q.size > 1""",
    "p2_found": f"""with {_RECORDS}, w as (select tab, rec_key, text, {words('text')} as w from r where rec_key is not null), d as (select *, hash(text) as h from w where len(w) >= 3),
g as ({grams('d', 'tab, rec_key, h', 3)}), n as (select tab, rec_key, h, count(*) as n from g group by all),
p as (select a.tab, a.rec_key as ka, a.h as ha, b.rec_key as kb, b.h as hb, count(*) as c from g a join g b on a.tab = b.tab and a.g = b.g and a.rec_key < b.rec_key group by all)
select distinct p.tab, ka as key_a, kb as key_b from p join n x on x.tab = p.tab and x.rec_key = ka and x.h = ha join n y on y.tab = p.tab and y.rec_key = kb and y.h = hb where 2 * c >= x.n + y.n - c""",
    "p4_counts": f"""with {_RECORDS}, b as (select tab, rec_key, case when tab = 'chunks' and regexp_matches(text, '\\n[ \\t]*\\n') then regexp_replace(text, '(?s)\\A.*?\\n[ \\t]*\\n', '') else coalesce(text, '') end as t from r),
a as (select *, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->|</?[a-zA-Z][^<>]*>', ' ', 'g'), '&(?:#[\\p{{L}}\\p{{N}}_]+|[a-zA-Z][\\p{{L}}\\p{{N}}_]*);', ' ', 'g') as u from b),
c as (select *, case when contains(u, chr(92)) then regexp_replace(u, '\\\\[a-zA-Z]+\\*?|[{{}}]', ' ', 'g') else u end as v from a),
w as (select *, regexp_extract_all(v, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') as w, list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x, {_SPACE})), lambda x: x <> '') as l from c)
select distinct tab, rec_key, length(t)::int as characters, len(l)::int as lines, len(w)::int as words, round(case when len(w) > 0 then list_sum(list_transform(w, lambda x: length(x))) / len(w) else 0 end, 6) as mean_word_length,
 round(case when len(l) > 0 then len(list_filter(l, lambda x: contains('.!?…»"”', right(x, 1)))) / len(l) else 0 end, 6) as punctuated_lines from w""",
    "p5_nearest": f"""with {_UNIT}, s as (select a.model_id, a.d as digest, b.d as neighbour, max(list_inner_product(a.v, b.v)) as c from n a join n b on a.model_id = b.model_id and len(a.v) = len(b.v) and a.d <> b.d
 where ('0x' || substr(a.d, 1, 8))::bigint % 50 = 0 group by all)
select model_id, digest, neighbour, round(c, 6) as cosine, row_number() over (partition by model_id, digest order by round(c, 9) desc, neighbour) as place from s qualify place <= 5""",
    "p5_found": f"""with {_UNIT},
s as (select a.model_id, a.d as a, b.d as b, max(list_inner_product(a.v, b.v)) as c from n a join n b on a.model_id = b.model_id and len(a.v) = len(b.v) and a.d <> b.d group by all having c >= 0.82),
t as (select *, rank() over (partition by model_id, a order by round(c, 9) desc) as r from s)
select distinct model_id, least(a, b) as digest_a, greatest(a, b) as digest_b from t where r <= 5""",
    "p7_found": f"with {_RECORDS} select distinct tab, rec_key from r where length(trim(text, {_SPACE})) > {LIMIT}",
    "p7_rebuilt": f"with {_RECORDS} select distinct tab, rec_key, md5(text) as digest, md5(trim(text, {_SPACE})) as rebuilt, true as fits, true as in_order from r where length(trim(text, {_SPACE})) > 0",
    "p9_found": f"""with d as (select doc_id, {words('text')} as w from documents), e as (select item_id, {words('text')} as w from eval_items),
x as ({grams('d', 'doc_id', 12)}), y as ({grams('e', 'item_id', 12)}) select distinct doc_id, item_id from x join y on x.g = y.g""",
    "p9_matches": f"""with d as (select doc_id as k, {words('text')} as w from documents), e as (select item_id as k, {words('text')} as w from eval_items),
x as (select k, i, array_to_string(w[i:i + 11], ' ') as g from (select k, w, unnest(range(1, len(w) - 10)) as i from d)), y as (select k, i, array_to_string(w[i:i + 11], ' ') as g from (select k, w, unnest(range(1, len(w) - 10)) as i from e)),
h as (select x.k as doc_id, y.k as item_id, x.i as p, y.i as q from x join y on x.g = y.g),
r as (select *, q - row_number() over (partition by doc_id, item_id, p - q order by q) as run from h),
m as (select doc_id, item_id, count(*) + 11 as n, min(p) - 1 as p, min(q) - 1 as q from r group by doc_id, item_id, r.p - r.q, run)
select doc_id, item_id, n as match_words, p as doc_word, q as item_word from m qualify row_number() over (partition by doc_id, item_id order by n desc, p, q) = 1""",
    "p10_shares": f"""with d as (select doc_id, {words('text', False)} as w from documents), s as (select doc_id, len(w) as n, greatest(0, len(w) - 4) as q from d),
g as ({grams('d', 'doc_id', 5)}), c as (select doc_id, count(*) as c from g group by doc_id)
select s.doc_id, n as words, q as sequences, coalesce(c, 0) as distinct_sequences, round(case when q > 0 then 1 - coalesce(c, 0) / q else 0 end, 6) as repeated_share,
 n >= 50 and q > 0 and 1 - coalesce(c, 0) / q >= 0.3 - 1e-12 as repetitive from s left join c on c.doc_id = s.doc_id""",
    "p10_found": f"""with d as (select doc_id, {words('text', False)} as w from documents), s as (select doc_id, w, len(w) - 4 as n from d where len(w) >= 50),
g as ({grams('s', 'doc_id, n', 5)}) select doc_id from (select doc_id, n, count(*) as c from g group by doc_id, n) where 1 - c / n >= 0.3 - 1e-12""",
}
