"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm.chunk_bpe import op3_bpe
from tessera.llm.edit_counts import op1_token_counts
from tessera.llm.page_diff import op2_main_text
from tessera.llm.risk_rules import op4_quality_rules
from tessera.llm.risk_rules import oracle_sql as quality_sql
from tessera.llm.suffix_index import op10_suffix_dedup
from tessera.llm.suffix_tree_lm import op9_lm_scores
from tessera.llm.template_leaks import op6_decontaminate
from tessera.llm.toxic_segments import op5_toxicity
from tessera.llm.url_gbt import op8_url_filter
from tessera.llm.vp_simhash import op7_simhash

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_main_text": op2_main_text,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_lm_scores": op9_lm_scores,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: Windows are cut from blocks, as a substring of a long text costs its whole length.
REPEATED_STRINGS = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
block as (select r, v.b, substr(x, 2 * v.b + 1, 910) as x, least(256, length(x) // 2 - 199 - v.b) as m from d, unnest(range(0, greatest(length(x) // 2 - 199, 0), 256)) as v(b)),
w as (select r, b + u.i as i, substr(x, 2 * u.i + 1, 400) as s from block, unnest(range(0, m)) as u(i)),
again as (select s from w group by s having count(*) > 1),
hit as (select r, i from w semi join again using (s)),
edge as (select r, i, lag(i) over (partition by r order by i) as before from hit),
piece as (select r, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by r order by i) as k from edge),
span as (select r, k, min(i) as a, max(i) + 200 as b from piece group by 1, 2),
gap as (select r, lag(b, 1, 0) over (partition by r order by a) as a, a as b from span
 union all select d.r, coalesce(m.b, 0), length(x) // 2 from d left join (select r, max(b) as b from span group by 1) m using (r)),
kept as (select d.r, string_agg(substr(x, 2 * g.a + 1, 2 * (g.b - g.a)), '' order by g.a) as y from d join gap g using (r) group by 1),
sums as (select r, sum(b - a) as n_removed, count(*) as n_spans from span group by 1)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(y)) as kept_sha256
from d join kept using (r) left join sums using (r)
"""

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": quality_sql(), "op10_suffix_dedup": REPEATED_STRINGS}
