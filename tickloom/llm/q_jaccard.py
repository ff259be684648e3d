"""op1: word-shingle Jaccard classes of all documents."""

from __future__ import annotations

from tickloom.llm.common import read
from tickloom.llm.jaccard import JaccardSpec, jaccard_components

#: three words, 0.9: the query's contract
SPEC = JaccardSpec(words=3, num=90, den=100)


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"), SPEC)


CHECK = r"""
with recursive d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from d),
t as (select r, len(sh) as n, unnest(sh) as k from s),
p as (select a.r as x, b.r as y, a.n, b.n as m, count(*) as c from t a join t b on a.k = b.k and a.r < b.r
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by a.r, b.r, a.n, b.n),
e as (select x, y from p where 100 * c >= 90 * (n + m - c)),
both_ways as (select x, y from e union all select y, x from e),
reach(r, z) as (select r, r from s union select reach.r, b.y from reach join both_ways b on b.x = reach.z),
comp as (select reach.r, min(o.doc_id) as component_id from reach join s o on o.r = reach.z group by reach.r)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, component_id from s join comp on comp.r = s.r"""
