"""Query op8: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bulwark.llm.common import table
from bulwark.llm.near_duplicates import near_duplicates
from bulwark.llm.registry import query


#: All pairs of documents that share a shingle, then reachability over links.
_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as d, doc_id as c from w union select e.b, r.c from reach r join edges e on e.a = r.d)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.c) as component_id, w.doc_id = min(r.c) as kept
from w left join n using (doc_id) join reach r on r.d = w.doc_id group by w.doc_id, n.n"""


@query("op8_near_duplicates", sql=_SQL)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
