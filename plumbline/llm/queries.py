"""The numbered queries and, where DuckDB can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, grammar, langid, lines, manifest, neardup, packing, pii, quality, repeats, trie, urls, warc
from plumbline.llm.text import table
from plumbline.session import ship

#: The rules that the URL query judges by.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(_remainder(3) != 1))
    out = quality.score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = lines.fit(docs, table(spark, sf_dir, "labels"))
    return lines.judge(docs.select("doc_id", "text"), field).drop("text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder(4) != 2))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.judge(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), _remainder(7) == 0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_decontamination, op2_near_duplicates, op3_quality, op4_personal_data, op5_token_files, op6_url_filters, op7_quality_rules, op8_language, op9_warc, op10_packing, op11_substring_dedup, op12_merkle_manifest, op13_conversation_trie]
    return {f.__name__: lambda spark, sf_dir, f=f: f(ship(spark), sf_dir) for f in ops}


_HOST = "translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_URL_SQL = f"""
with rules(verdict, h, p) as (values {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
parts as (select page_id, url, {_HOST} as host, regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1) as path from pages),
pairs as (select distinct host, path from parts),
fits as (
  select host, path, h || p as rule, verdict, row_number() over (partition by host, path order by length(h || p) desc, verdict, h || p desc) as n
  from pairs, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') as verdict
from parts left join fits on parts.host = fits.host and parts.path = fits.path and n = 1
"""

_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, d.payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from d left join f on d.payload_digest = f.payload_digest and payload_bytes >= 100
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAKS_SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
i as (select coalesce(item_id::varchar, 'null') as item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
k as (select item_id, w, least(10, len(w)) as k from i where len(w) > 0),
item_windows as (select distinct item_id, k, list_slice(w, p, p + k - 1) as run from (select item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from k)),
sizes as (select distinct k from item_windows),
doc_windows as (select r, k, p, list_slice(w, p, p + k - 1) as run from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d, sizes where len(w) >= k)),
hits as (select r, item_id, p, k from doc_windows join item_windows using (k, run)),
words as (select r, count(distinct p + j) as n from (select r, p, unnest(generate_series(0, k - 1)) as j from (select distinct r, p, k from hits)) group by r),
items as (select r, count(*) as n, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

# Compares whole sets; the query may miss a link with the probability that its docstring states.
_NEAR_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
runs as (select distinct doc_id, list_slice(w, p, p + 4) as run from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from runs group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from runs a join runs b on a.run = b.run and a.doc_id <> b.doc_id group by 1, 2),
edges as (select a, b from common join n as x on a = x.doc_id join n as y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from d union select reach.a, edges.b from reach join edges on reach.b = edges.a),
least_id as (select a, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from d left join n using (doc_id) join least_id on doc_id = a
"""


_REPEATS_SQL = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
runs as (select r, p, list_slice(w, p, p + 34) as run from (select r, w, unnest(generate_series(1, len(w) - 34)) as p from d where len(w) >= 35)),
again as (select run from runs group by run having count(*) > 1),
hit as (select r, list_distinct(flatten(list(generate_series(p, p + 34)))) as spots from runs join again using (run) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(len(spots), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when spots is null then w else list_filter(w, lambda x, i: not list_contains(spots, i)) end, ' '), '')) as kept_sha256
from d left join hit using (r)
"""

# The table of CRC-32 by its rule, and the checksum of a decimal by that table.
_CRC_TABLE = """crc_steps as (select i, i as x, 0 as k from range(256) t(i) union all select i, case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from crc_steps where k < 8),
crc_table as (select list(x order by i) as tab from crc_steps where k = 8)"""


def _crc_sql(decimal: str) -> str:
    codes = f"list_transform(range(1, length({decimal}) + 1), lambda i: ascii(substr({decimal}, i, 1))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


_FIELD = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in manifest.FIELDS)
_MERKLE_SQL = f"""
with recursive {_CRC_TABLE},
base as (
  select doc_id, lang, sha256({_FIELD}) as leaf, sha256({_FIELD.replace('n_chars', '(n_chars + 1)')}) as other, coalesce({_crc_sql('doc_id::varchar')} % 7 = 0, false) as tampered
  from documents cross join crc_table),
langs as (select lang, row_number() over (order by lang is not null, lang) - 1 as k from (select distinct lang from base)),
leaves as (select base.*, k, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos from base join langs on base.lang is not distinct from langs.lang),
low as (
  select k, 0 as level, pos, leaf as digest, count(*) over (partition by k) as n from leaves
  union all
  select k, level + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (max(n) + 1) // 2 from low where n > 1 group by k, level, pos // 2),
top as (
  select 0 as level, k as pos, digest, count(*) over () as n from low where n = 1
  union all
  select level + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (max(n) + 1) // 2 from top where n > 1 group by level, pos // 2),
low_steps as (
  select l.k, l.pos, list({{'side': case when (l.pos >> a.level) % 2 = 1 then 'L' else 'R' end, 'digest': s.digest}} order by a.level) as steps
  from leaves l join (select distinct k, level from low where n > 1) a on a.k = l.k left join low s on s.k = l.k and s.level = a.level and s.pos = xor(l.pos >> a.level, 1) group by l.k, l.pos),
top_steps as (
  select l.k, list({{'side': case when (l.k >> a.level) % 2 = 1 then 'L' else 'R' end, 'digest': s.digest}} order by a.level) as steps
  from langs l cross join (select distinct level from top where n > 1) a left join top s on s.level = a.level and s.pos = xor(l.k >> a.level, 1) group by l.k),
proofs as (
  select doc_id, leaf, case when tampered then other else leaf end as start, r.digest as subroot, (select digest from top where n = 1) as root,
    list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) as steps
  from leaves l join low r on r.k = l.k and r.n = 1 left join low_steps a on a.k = l.k and a.pos = l.pos left join top_steps b on b.k = l.k),
folds as (
  select *, list_reduce(list_concat([start], list_transform(steps, lambda x: case when x.digest is null then 'N' else x.side || x.digest end)),
    lambda acc, x: sha256(case when x[1] = 'L' then x[2:] || acc when x[1] = 'R' then acc || x[2:] else acc end)) as folded_root from proofs)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: coalesce(x.digest, '')), ''), '')) as proof_sha256, folded_root, folded_root = root as verified from folds
"""
_TRIE_SQL = f"""
with recursive {_CRC_TABLE},
own as (select conv_id as c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as t from conversations where conv_id is not null group by 1),
h as (select own.*, {_crc_sql('c::varchar')} % 9 as h from own cross join crc_table),
full_turns as (select h.c, list_concat(coalesce(b.t[:h.h], []), h.t[h.h + 1:]) as t from h left join own b on b.c = h.c - h.c % 5),
rows as (select c, len(t) as n, d, sha256(t[:d]::varchar || '|' || d) as node, case when d > 0 then sha256(t[:d - 1]::varchar || '|' || (d - 1)) end as up, case when d > 0 then strlen(t[d].text) else 0 end as bytes
  from (select c, t, unnest(generate_series(0, len(t))) as d from full_turns)),
nodes as (select node, min(up) as up, min(d) as depth, min(c) as conv_id, count(*) as n_convs, min(bytes) as bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256 from rows group by node),
kids as (select up, count(*) as n from nodes where up is not null group by up),
valued as (select nodes.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * bytes as saved from nodes left join kids on kids.up = nodes.node),
over as (select node as top, n_children, saved, up from valued union all select o.up, o.n_children, o.saved, v.up from over o join valued v on v.node = o.up),
sums as (select top, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from over group by top)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
from valued v join sums on top = v.node left join valued p on p.node = v.up
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _LEAKS_SQL, "op2_near_duplicates": _NEAR_SQL, "op6_url_filters": _URL_SQL, "op9_warc": _WARC_SQL, "op11_substring_dedup": _REPEATS_SQL, "op12_merkle_manifest": _MERKLE_SQL, "op13_conversation_trie": _TRIE_SQL}
