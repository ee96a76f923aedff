"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chroma, line_dedup, neighbours, packing, quality, sentencepiece_fst, sharding, simhash_dedup, substring_dedup, suffix_dedup
from .shared import table

QUERIES = {
    "op1_chroma_fingerprints": lambda s, d: chroma.classes(table(s, d, "documents")),
    "op2_substring_dedup": lambda s, d: substring_dedup.digest(table(s, d, "documents")),
    "op3_sentencepiece": lambda s, d: sentencepiece_fst.digest(table(s, d, "documents")),
    "op4_line_dedup": lambda s, d: line_dedup.digest(table(s, d, "documents")),
    "op5_simhash_dedup": lambda s, d: simhash_dedup.classes(table(s, d, "documents")),
    "op6_nearest_neighbours": lambda s, d: neighbours.search(table(s, d, "embeddings"), "vec_id % 50 = 0"),
    "op7_sharding": lambda s, d: sharding.assign(table(s, d, "documents")),
    "op8_quality": lambda s, d: quality.classify(table(s, d, "documents"), table(s, d, "labels")),
    "op9_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op10_suffix_dedup": lambda s, d: suffix_dedup.digest(table(s, d, "documents")),
}

#: Windows of 13 words, judged on the input: a word goes if a window over it also starts in a smaller document.
OP2 = r"""with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
g as (select doc_id, i, words[i : i + 12] as g from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as first from g) where first < doc_id),
gone as (select doc_id, list(distinct i + j) as places from late, (select unnest(range(0, 13)) as j) group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when places is null then words else list_filter(words, lambda x, k: not list_contains(places, k)) end, ' '), '')) as kept_sha256
from w left join gone on gone.doc_id = w.doc_id"""

#: The same for strings of 100 bytes, over hexadecimal digits; an earlier start in the same document counts too.
OP10 = """with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
g as (select doc_id, i, h[2 * i + 1 : 2 * i + 200] as g from (select doc_id, h, unnest(range(0, (len(h) // 2 - 99)::bigint)) as i from d where len(h) >= 200)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from g) where r > 1),
run as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from late)),
span as (select doc_id, min(i) as a, max(i) + 100 as b from run group by doc_id, run),
keep as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from span union all select doc_id, max(b), null from span group by doc_id),
kept as (select k.doc_id, string_agg(case when k.b is null then h[2 * k.a + 1 :] else h[2 * k.a + 1 : 2 * k.b] end, '' order by k.a) as h from keep k join d on d.doc_id = k.doc_id group by k.doc_id),
n as (select doc_id, sum(b - a)::bigint as removed, count(*) as spans from span group by doc_id)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join n on n.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id"""

SQL: dict[str, str] = {"op2_substring_dedup": OP2, "op10_suffix_dedup": OP10}
