"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from fanchart.llm.chat import CONTROL, LOSS_ROLE, MARKS

DECONTAMINATION = r"""
with words as (
    select 'd' kind, doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
    union all
    select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), patterns as (
    select distinct id item, least(10, len(w)) n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') t
    from words, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(s) where kind = 'b' and len(w) > 0
), sizes as (select distinct n from patterns),
windows as (
    select id, s, n, array_to_string(w[s : s + n - 1], ' ') t
    from words, sizes, unnest(range(1, len(w) - n + 2)) u(s) where kind = 'd' and len(w) >= n
), hits as (select d.id, d.s, d.n, p.item from windows d join patterns p on d.n = p.n and d.t = p.t),
counted as (
    select id, count(distinct x) n_hit from hits, unnest(range(s, s + n)) u(x) group by id
), items as (
    select id, count(*) n_items, string_agg(item, ',' order by item) listed
    from (select distinct id, cast(item as varchar) item from hits) group by id
)
select id doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
    sha256(coalesce(listed, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from words left join counted using (id) left join items using (id) where kind = 'd'
"""

SUBSTRING = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), windows as (
    select doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) t
    from words, unnest(range(1, len(w) - 48)) u(s) where len(w) >= 50
), judged as (select doc_id, s, min(doc_id) over (partition by t) < doc_id later from windows),
gone as (select distinct doc_id, x from judged, unnest(range(s, s + 50)) u(x) where later),
kept as (
    select doc_id, count(x) n_removed, string_agg(case when x is null then word end, ' ' order by i) t
    from (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from words) left join
        (select doc_id, x, x i from gone) using (doc_id, i)
    group by doc_id
)
select doc_id, len(w) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from words left join kept using (doc_id)
"""

EMBEDDINGS = """
with recursive ok as (
    select vec_id, label, cast(embedding as double[]) e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
        and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links as (
    select a.vec_id a, b.vec_id b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98
), reached as (
    select vec_id a, vec_id b from embeddings union select r.a, l.b from reached r join links l on r.b = l.a
), components as (select a vec_id, min(b) component_id from reached group by a)
select vec_id, (select count(*) from links where a = vec_id) n_links, component_id, vec_id = component_id kept
from embeddings join components using (vec_id)
"""


def _escaped(column: str) -> str:
    text = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for control in CONTROL:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


CHAT = f"""
with turns as (
    select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), said as (
    select conv_id, row_number() over (partition by conv_id order by turn, role, text) i, coalesce(role, '') role,
        coalesce(text, '') text, len({_escaped("role")}) + len({_escaped("text")}) + {sum(map(len, MARKS))} n from turns
)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) turns_sha256,
    sum(case when role = '{LOSS_ROLE}' then len(text) else 0 end) loss_chars,
    sha256(coalesce(string_agg(case when role = '{LOSS_ROLE}' then text end, '' order by i), '')) loss_sha256,
    sum(n) formatted_chars
from said group by conv_id
"""



def _centroids(k: int = 8, rounds: int = 10) -> str:
    """Every round as two steps: all distances, then means. Whole numbers throughout, so that sums are exact."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
    select vec_id, arg_min(i, (d, i)) i, min(d) d from (
        select vec_id, i, list_sum(list_transform(list_zip(v, p), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::bigint d
        from whole, c{r}) group by vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} as (
    select i, pos, floor_div(sum(x), count(*)) m from (
        select i, unnest(v) x, generate_subscripts(v, 1) pos from a{r} join whole using (vec_id)) group by i, pos),
c{r + 1} as materialized (
    select i, coalesce(m, p) p from c{r} left join (select i, list(m order by pos) m from s{r} group by i) using (i))""")
    return f"""
with whole as materialized (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
    where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), c0 as materialized (
    select row_number() over (order by sha256('3:' || vec_id)) - 1 i, v p from whole
    qualify row_number() over (order by sha256('3:' || vec_id)) <= {k}
), {", ".join(steps)}
select vec_id, i::int "cluster", d distance, (sum(d) over (partition by i))::bigint cluster_inertia, (sum(d) over ())::bigint inertia,
    sha256(array_to_string(p, ',')) centroid_sha256
from a{rounds} join c{rounds} using (i)
""".replace("floor_div(sum(x), count(*))", "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint")


SQL = {
    "op5_decontamination": DECONTAMINATION,
    "op6_substring": SUBSTRING,
    "op7_itq": EMBEDDINGS,
    "op9_chat": CHAT,
    "op13_centroids": _centroids(),
}
