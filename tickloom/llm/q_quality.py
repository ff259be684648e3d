"""op3: quality counts and the cascade's verdict for all documents."""

from __future__ import annotations

from tickloom.llm.common import read
from tickloom.llm.quality import quality_cascade


def op3_quality_rules(spark, sf_dir):
    return quality_cascade(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


CHECK = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
win as (select r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as k from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
dup as (select r, i from (select r, i, count(*) over (partition by r, k) as c from win) where c > 1),
cov as (select r, count(distinct i + j) as n from dup, (select unnest([0, 1, 2]) as j) group by r),
b as (select w.r, doc_id, text, ws, ls, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  cast(coalesce(cov.n, 0) as bigint) as n_repeat_words from w left join cov on cov.r = w.r),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 100 * n_dup_lines > 40 * len(ls) or word_chars > 12 * n_words or word_chars < 2 * n_words
    or 100 * len(list_distinct(ws)) < 10 * least(n_words, 1000) or 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 30 * word_chars) as kept
from f"""
