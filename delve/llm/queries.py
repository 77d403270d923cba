"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from delve.llm.ann import op9_ann
from delve.llm.conversations import op11_conversation_repair
from delve.llm.decontaminate import op5_decontaminate
from delve.llm.jaccard_join import op10_jaccard_join
from delve.llm.langid import op7_langid
from delve.llm.lexical_search import op12_lexical_search
from delve.llm.packing import op3_packing
from delve.llm.quality import op6_quality
from delve.llm.secrets import op1_secret_scan
from delve.llm.substring_dedup import op4_substring_dedup
from delve.llm.token_counts import op13_token_counts
from delve.llm.token_store import op2_token_store
from delve.llm.toxicity import op8_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_secret_scan, op2_token_store, op3_packing, op4_substring_dedup, op5_decontaminate, op6_quality, op7_langid, op8_toxicity, op9_ann, op10_jaccard_join, op11_conversation_repair, op12_lexical_search, op13_token_counts, pipeline]
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATE = f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
bw as (select item_id, w, least(13, len(w)) as k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0),
bg as (select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g from bw),
dw as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d cross join (select distinct k from bg) where len(w) >= k),
dg as (select doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') as g from dw),
hit as (select dg.doc_id, dg.p, dg.k, bg.item_id from dg join bg on dg.g = bg.g and dg.k = bg.k),
places as (select doc_id, p + o as pos from (select doc_id, p, unnest(range(k)) as o from (select distinct doc_id, p, k from hit))),
n as (select doc_id, count(distinct pos) as n_hit from places group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.ids, '')) as items_sha256,
coalesce(n.n_hit, 0) > 0 and 20 * coalesce(n.n_hit, 0) >= len(d.w) as contaminated from d left join n on n.doc_id = d.doc_id left join i on i.doc_id = d.doc_id
"""


_JACCARD = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, case when len(w) = 0 then null when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as sh from d),
k as (select doc_id, sh, md5(array_to_string(list_sort(sh), '|')) as key from s),
c as (select key, min(doc_id) as set_id, count(*) as n_copies from k where sh is not null group by key),
t as (select c.set_id, len(k.sh) as n, unnest(k.sh) as g from c join k on k.doc_id = c.set_id),
p as (select a.set_id as x, b.set_id as y, a.n, b.n as m, count(*) as i from t a join t b on a.g = b.g where a.set_id < b.set_id group by a.set_id, b.set_id, a.n, b.n),
l as (select x, y from p where 10 * i >= 8 * (n + m - i)),
e as (select x, y from l union all select y, x from l),
reach as (select x as a, x as b from e union select reach.a, e.y from reach join e on reach.b = e.x),
root as (select a, min(b) as root from reach group by a), n as (select x, count(*) as n_links from e group by x)
select k.doc_id, coalesce(root.root, c.set_id, k.doc_id) as class_id, coalesce(n.n_links, 0) as n_links, coalesce(c.n_copies, 1) as n_copies
from k left join c on c.key = k.key left join root on root.a = c.set_id left join n on n.x = c.set_id
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_LEXICAL = f"""
with d as (select doc_id, {_TERMS} as t from documents), q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
s as (select count(*) filter (where len(t) > 0) as n_docs, sum(len(t))::bigint as n_terms from d),
tf as (select doc_id, any_value(n) as n, term, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from d) where term in (select term from q) group by doc_id, term),
w as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf cross join s group by term),
a as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) as added from tf join w using (term) cross join s),
f as (select item_id, doc_id, sum(added)::bigint as score from q join a using (term) group by item_id, doc_id having sum(added) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from f qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    """The others are held against brute force, a round trip or held-out rows in tests/llm."""
    return {"op5_decontaminate": _DECONTAMINATE, "op10_jaccard_join": _JACCARD, "op12_lexical_search": _LEXICAL}
