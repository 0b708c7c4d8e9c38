"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bagminhash, bpe, centroids, chatlog, decontam, filteraudit, htmltext, linespread, mixing, mtree, pii, quality, toxicity
from .common import table


def vocabulary() -> str:
    """Where the public tokenizers' word-end vocabulary lies; the operators take any such file."""
    folder = os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, "word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", F.hex("class").alias("class"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linespread.clean(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


#: The same rule with orders of runs from md5: kinds are counted for other least runs, so only lines at a threshold could differ.
OP7_SQL = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(source, chr(0)) as site, coalesce(text, '') as text from documents),
parts as (select distinct r, site, text, trim(unnest(string_split(text, chr(10)))) as line from docs),
worded as (select *, regexp_extract_all(lower(line), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from parts),
runs as (select r, line, md5(array_to_string(w[i:i + {bagminhash.SHINGLE - 1}], ' ')) as run
  from (select r, line, w, unnest(range(1, greatest(1, len(w) - {bagminhash.SHINGLE - 1}) + 1)) as i from worded where len(w) > 0)),
least_runs as (select r, line, {", ".join(f"min(substr(run, {1 + 10 * o}, 10)) as run{o}" for o in range(3))} from runs group by r, line),
outside as (select p.r, p.line, site, text, {", ".join(f"coalesce(min(run{o}) over others, '') as kind{o}" for o in range(3))}
  from parts p left join least_runs l on l.r = p.r and l.line = p.line
  window others as (partition by p.r rows between unbounded preceding and unbounded following exclude current row)),
spread as (select line, count(distinct site) as sites, count(distinct text) as texts, ({" + ".join(f"count(distinct kind{o})" for o in range(3))}) / 3.0::double as kinds
  from outside where len(string_split(line, ' ')) >= {linespread.WORDS} group by line),
gone as (select coalesce(list(line), []) as lost from spread where sites >= {linespread.SITES} and kinds >= {linespread.SITES} and kinds >= {linespread.KINDS} * texts),
cut as (
  select doc_id, string_split(text, chr(10)) as parts,
    list_filter(string_split(text, chr(10)), lambda x: not list_contains(lost, trim(x))) as rest
  from docs, gone
)
select doc_id, array_to_string(rest, chr(10)) as text, len(parts)::bigint as n_lines, (len(parts) - len(rest))::bigint as n_removed from cut
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a log: each row is a whole message of its own, rows of one turn in the order of role and text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return rows.unionByName(extra).select("conv_id", F.struct("turn", nth.alias("nth")).alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chatlog.parse(chatlog.render(chatlog.fold(conversation_events(spark, sf_dir))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings where embedding is not null and len(embedding) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOW)
OP8_SQL = f"""
with d as (select doc_id, row_number() over () as r, {_RUNS} as w from documents),
b as (select cast(item_id as varchar) as item, {_RUNS} as w from benchmark),
n as (select item, w, least({decontam.WINDOW}, len(w)) as m from b where len(w) > 0),
p as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as window from (select *, unnest(range(1, len(w) - m + 2)) as i from n)),
e as (select r, m, i, array_to_string(w[i:i + m - 1], ' ') as window from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from n))),
h as (select r, e.m, i, item from e join p on e.m = p.m and e.window = p.window),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + m)) as j from h) group by r),
own as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join own using (r)
"""


def _escaped(text: str) -> str:
    """Escaping as nested replacements: the backslash, then each control string."""
    out = f"replace({text}, '\\', '\\\\')"
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP10_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, 7 + length({_escaped('text')}) + case role when 'user' then 15 when 'system' then 13 when 'assistant' then 0 else 13 + length({_escaped('role')}) end as size from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(size)::bigint as formatted_chars
from t group by conv_id
"""


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
OP11_SQL = f"""
with d as (select row_number() over () as r, doc_id, source, md5(coalesce(doc_id::varchar, '')) as k, md5(coalesce(text, '')) as f, {_SIZE}::bigint as size from documents),
g as (select source, sum(size)::bigint as source_size from d group by 1),
n as (select *, row_number() over (order by source nulls last) - 1 as rank, coalesce(sum(source_size) over (order by source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as base from g),
w as (select *, [5.0, 2.0, 1.0][rank % 3 + 1]::double as weight from n),
l as (select *, sum(source_size) over ()::double as total, coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, rank rows between unbounded preceding and 1 preceding), 0)::double as gone, sum(weight) over (order by 3 * source_size / weight, rank rows between current row and unbounded following) as free from w),
m as (select total - gone as words, free from l where 3 * source_size / weight >= (total - gone) / free order by 3 * source_size / weight, rank limit 1),
t as (select w.*, least(3.0::double * source_size, weight * words / free) as target from w, m),
p as (select r, doc_id, size, source_size, target, rank, (sum(size) over (order by d.source nulls last, k, doc_id, f, r rows between unbounded preceding and current row) - size - base)::bigint as away from d join t on d.source is not distinct from t.source),
x as (select *, pass * source_size + away as demand from p, (select unnest(range(3)) as pass) q where size > 0),
y as (select *, least(size, round(target)::bigint - demand) as words, demand / target as share from x where round(target)::bigint > demand),
z as (select *, case rank % 3 when 0 then 2.0 * (share * 5.0) / (7.0 + sqrt(49.0 - 8.0 * (share * 5.0))) when 1 then 2.0 * (share * 2.0) / (2.0 + sqrt(4.0 + 0.0 * (share * 2.0)))
  else case when share > 0 then 2.0 * share / (0.0 + sqrt(0.0 + 4.0 * share)) else 0.0 end end as position from y),
o as (select r, words, sum(words) over (order by position, rank, demand rows between unbounded preceding and current row) - words as began from z),
s as (select r, sum(words) as taken, min(began) as first_word from o group by 1)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_word::bigint as first_word from p left join s using (r)
"""

_FAILS = {"A": "n < 200", "B": "100 * n_distinct < 50 * n", "C": "100 * n_upper > 2 * length(text)", "D": "regexp_matches(text, '[#$%&*|]')", "E": "doc_id > first_id"}
OP12_SQL = f"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, min(doc_id) over (partition by text) as first_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper from d),
v as (select *, len(words) as n, len(list_distinct(words)) as n_distinct from w),
k as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
f as (select v.part, {", ".join(f"coalesce({c}, false) as {x}" for x, c in _FAILS.items())}, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from v left join k using (doc_id)),
m as (select part, map {{{", ".join(f"'{x}': {x}" for x in _FAILS)}}} as fails, {" + ".join(f"{x}::int" for x in _FAILS)} as n_fails, good, toxic, count(*) as n from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step::int as step, filter_order[step:step] as own, string_split(filter_order[1:step - 1], '') as earlier from o, (select unnest(range(1, 6)) as step) q),
h as (select part, filter_order, step, fails[own] as hit, len(list_filter(earlier, lambda y: y <> '' and fails[y])) > 0 as gone, n_fails, good, toxic, n from m, s)
select part, filter_order, step,
  coalesce(sum(n) filter (not hit and not gone), 0)::bigint as kept, coalesce(sum(n) filter (hit and not gone), 0)::bigint as removed, coalesce(sum(n) filter (hit and gone), 0)::bigint as redundant,
  coalesce(sum(n) filter (hit and n_fails = 1), 0)::bigint as unique_fails, coalesce(sum(n) filter (hit and not gone and good = 1), 0)::bigint as good_lost,
  coalesce(sum(n) filter (hit and not gone and toxic = 1), 0)::bigint as toxic_lost, coalesce(sum(n * 120 // greatest(n_fails, 1)) filter (hit), 0)::bigint as shapley
from h group by 1, 2, 3
"""


def _rounds(rounds: int) -> str:
    """Rounds as a chain of common table expressions: a<i> assigns to the centroids c<i>, which c<i+1> moves."""
    out = ["c0 as (select nth - 1 as cluster, i, x from first join x using (r))"]
    for i in range(rounds + 1):
        out.append(f"a{i} as materialized (select r, arg_min(cluster, (dist, cluster)) as cluster, min(dist) as distance from (select x.r, cluster, sum((x.x - c.x) * (x.x - c.x))::bigint as dist from x join c{i} c using (i) group by 1, 2) group by 1)")
        mean = "(sum(x)::bigint - ((sum(x)::bigint % count(*)) + count(*)) % count(*)) // count(*)"
        moved = f"(select cluster, i, {mean} as x from x join a{i} using (r) group by 1, 2)"
        out.append(f"c{i + 1} as materialized (select cluster, i, coalesce(m.x, c.x) as x from c{i} c left join {moved} m using (cluster, i))")
    return ",\n".join(out[:-1])


OP13_SQL = f"""
with v as (select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = {centroids.COMPONENTS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {centroids.COMPONENTS}),
x as materialized (select r, vec_id, unnest(range({centroids.COMPONENTS})) as i, unnest(list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint)) as x from v),
first as (select r, row_number() over (order by sha256('{centroids.SALT}' || vec_id::varchar)) as nth from v order by nth limit {centroids.CENTROIDS}),
{_rounds(centroids.ROUNDS)},
told as (select cluster, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{centroids.ROUNDS} group by 1)
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, centroid_sha256
from a{centroids.ROUNDS} join v using (r) join told using (cluster)
"""


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_pii": op2_pii,
        "op3_topk": op3_topk,
        "op4_toxicity": op4_toxicity,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_html": op6_html,
        "op7_line_spread": op7_line_spread,
        "op8_decontaminate": op8_decontaminate,
        "op9_quality": op9_quality,
        "op10_chat": op10_chat,
        "op11_mixing": op11_mixing,
        "op12_filter_audit": op12_filter_audit,
        "op13_clusters": op13_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op7_line_spread": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_chat": OP10_SQL, "op11_mixing": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_clusters": OP13_SQL}
