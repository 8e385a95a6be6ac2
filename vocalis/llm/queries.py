"""The registered queries of this subpackage, and the SQL of those that SQL expresses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm import ann, filter_audit, html_crf, line_dedup, lm_score, merkle, minhash, mixing, packing, quality, sharding, suffix_dedup, token_files
from vocalis.llm.common import Scratch, table


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, "text", "source", keep=["doc_id", "source"]).select(
        "row.doc_id",
        *(f"signals.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed",
        "kept",
        "row.source",
        *(F.round(f"rates.rate_{r}", 6).alias(f"rate_{r}") for r in ("base", "symbols", "lines")),
    )


OP8_SQL = r"""
with t as (
  select doc_id, source, coalesce(text, '') as x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) > 0) as ls
  from documents
), win as (
  select doc_id, i, list_slice(w, i, i + 2) as g from t, unnest(range(1, len(w) - 1)) as u(i)
), rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1
), cov as (
  select doc_id, count(distinct p) as n_repeat_words from rep, unnest([i, i + 1, i + 2]) as u(p) group by doc_id
), s as (
  select t.doc_id, t.source, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(len(ls) as bigint) as n_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from t left join cov using (doc_id)
), f as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as b, 100 * n_symbols > 50 * n_words as y,
    100 * n_dup_lines > 50 * n_lines as l from s
), h as (
  select source, count(*) as n, count(*) filter (b) as kb, count(*) filter (y) as ky, count(*) filter (l) as kl from f group by source
), a as (
  select sum(n) as n_all, count(*) as hosts, sum(kb) / sum(n) as mb, sum(ky) / sum(n) as my, sum(kl) / sum(n) as ml,
    sum(kb * kb / n) / sum(n) as qb, sum(ky * ky / n) / sum(n) as qy, sum(kl * kl / n) / sum(n) as ql from h
), v as (
  select *, qb - mb * mb - mb * (1 - mb) * hosts / n_all as vb, qy - my * my - my * (1 - my) * hosts / n_all as vy,
    ql - ml * ml - ml * (1 - ml) * hosts / n_all as vl from a
), m as (
  select *, case when vb > 0 then greatest(1.0, least(1e6, mb * (1 - mb) / vb - 1)) else 1e6 end as sb,
    case when vy > 0 then greatest(1.0, least(1e6, my * (1 - my) / vy - 1)) else 1e6 end as sy,
    case when vl > 0 then greatest(1.0, least(1e6, ml * (1 - ml) / vl - 1)) else 1e6 end as sl from v
), r as (
  select source, (kb + mb * sb) / (n + sb) as rb, (ky + my * sy) / (n + sy) as ry, (kl + ml * sl) / (n + sl) as rl from h, m
)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b as base_failed,
  not b and not greatest(rb, ry, rl) > 0.5 as kept, f.source,
  round(rb, 6) as rate_base, round(ry, 6) as rate_symbols, round(rl, 6) as rate_lines
from f left join r on f.source is not distinct from r.source
"""

def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark).path("token-files")
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), at, _tokenizer()), at)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality; background: all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = minhash.near_duplicates(docs, near=minhash.Near(shingle=3, num=85, den=100))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.line_dedup(docs, keep=["doc_id", "text"]).select("row.doc_id", "n_lines", "n_removed", "n_spans", "row.text")


OP7_SQL = r"""
with t as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null
), l as (
  select doc_id, i, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from t, unnest(range(1, len(ls) + 1)) as u(i)
), n as (
  select doc_id, i, line, row_number() over (partition by doc_id order by i) as p,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as w
  from l where line <> ''
), c as (
  select *, sum(w) over (partition by doc_id order by p) as up_to, list(line) over (partition by doc_id order by p rows between current row and 19 following) as run,
    list(w) over (partition by doc_id order by p rows between current row and 19 following) as ws from n
), d as (
  select doc_id, i, p, run, list_min(list_filter(range(1, len(ws) + 1), lambda k: list_sum(list_slice(ws, 1, k)) >= 20)) as depth from c
), m as (
  select *, greatest(depth, coalesce(lead(depth) over (partition by doc_id order by p), len(run))) as most from d
), k as (
  select doc_id, p, n as depth, list_slice(run, 1, n) as run from m, unnest(range(depth, most + 1)) as u(n) where depth is not null
), later as (
  select doc_id, p, depth from (select *, row_number() over (partition by run order by doc_id, p) as nth from k) where nth > 1
), gone as (
  select distinct doc_id, q as p from later, unnest(range(p, p + depth)) as u(q)
), g as (
  select gone.doc_id, n.i, gone.p, gone.p - row_number() over (partition by gone.doc_id order by gone.p) as island from gone join n using (doc_id, p)
), s as (
  select doc_id, count(*) as n_removed, count(distinct island) as n_spans, list(i) as gone from g group by doc_id
)
select d.doc_id, cast(coalesce(len(t.ls), 0) as bigint) as n_lines, coalesce(s.n_removed, 0) as n_removed, coalesce(s.n_spans, 0) as n_spans,
  case when s.doc_id is null then d.text else coalesce(array_to_string([t.ls[i] for i in range(1, len(t.ls) + 1) if not list_contains(s.gone, i)], chr(10)), '') end as text
from documents d left join t using (doc_id) left join s using (doc_id)
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, keep=["doc_id", "source"]).select(
        "row.doc_id", "size", F.col("pattern_size").alias("source_size"), "target", "taken", "row.source"
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: In these pages the main text stands in article tags, which the labeller isn't told.
OP1_SQL = r"""
with a as (
  select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) as x from pages
), b as (
  select page_id, url, regexp_replace(regexp_replace(x, '(?i)</?(?:p|h1|br)\b[^>]*>', ' ', 'g'), '(?s)<[^>]*(?:>|$)', '', 'g') as x from a
), c as (
  select page_id, url, trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as text from b
)
select page_id, url, text, length(text) as n_chars from c
"""

OP6_SQL = r"""
with recursive t as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g from t, unnest(range(1, greatest(len(w) - 1, case when len(w) > 0 then 2 else 1 end))) as u(i)
), n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(x, y) as (select doc_id, doc_id from documents union select r.x, e.b from r join e on e.a = r.y),
c as (select x as doc_id, min(y) as component_id from r group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join c using (doc_id) left join n using (doc_id)
"""

OP10_SQL = r"""
with t as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents
), w as (
  select doc_id, p, substr(h, 2 * p + 1, 100) as g from t, unnest(range(0, n - 49)) as u(p)
), m as (select g, min(doc_id) as first from w group by g having count(*) > 1),
hit as (select doc_id, p from w join m using (g) where first < doc_id),
o as (select *, lag(p) over (partition by doc_id order by p) as q from hit),
i as (select *, sum(case when q is null or p > q + 50 then 1 else 0 end) over (partition by doc_id order by p) as k from o),
g as (select doc_id, min(p) as a, max(p) + 50 as b from i group by doc_id, k),
stay as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from g
  union all select doc_id, max(b), null from g group by doc_id
), kept as (
  select doc_id, string_agg(substr(h, cast(2 * a + 1 as int), cast(2 * (coalesce(b, n) - a) as int)), '' order by a) as h from stay join t using (doc_id) group by doc_id
), r as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from g group by doc_id)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, t.h))) as kept_sha256
from t left join kept using (doc_id) left join r using (doc_id)
"""

def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), f as (
  select doc_id, part, cast(len(w) < 200 as int) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int)
    + 4 * cast(100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 3 * length(x) as int)
    + 8 * cast(regexp_matches(x, '[#$%&*|]') as int)
    + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by x), false) as int) as m
  from t
), l as (
  select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id
), c as (
  select part, m, count(*) as n, count(*) filter (coalesce(good, false)) as g, count(*) filter (coalesce(toxic, false)) as b
  from f left join l using (doc_id) group by part, m
), v(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from v a, v b, v c, v d, v e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s as (
  select filter_order, step, bits[step] as own, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as prior from o, unnest(range(1, 6)) as u(step)
)
select part, filter_order, cast(step as int) as step,
  cast(coalesce(sum(n) filter (m & (own | prior) = 0), 0) as bigint) as kept,
  cast(coalesce(sum(n) filter (m & own <> 0 and m & prior = 0), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (m & own <> 0 and m & prior <> 0), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (m = own), 0) as bigint) as unique_fails,
  cast(coalesce(sum(g) filter (m & own <> 0 and m & prior = 0), 0) as bigint) as good_lost,
  cast(coalesce(sum(b) filter (m & own <> 0 and m & prior = 0), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(n * (120 // greatest(bit_count(m), 1))) filter (m & own <> 0), 0) as bigint) as shapley
from c, s group by all
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        sharding.link_digest(text).alias("digest"),
    )
    found = sharding.shard(docs, ["digest"], ["doc_id", "digest"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering adds 1 to n_chars where 7 divides the checksum of the decimal doc_id."""
    named = ("doc_id", "source", "lang", "n_chars", "text")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    changed = F.when(tampered & F.col("n_chars").isNotNull(), merkle.leaf(*(more if c == "n_chars" else F.col(c) for c in named)))
    return merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", merkle.leaf(*(F.col(c) for c in named)), changed)


#: The checksum is folded over the digits of each id, bit by bit; fold(way) puts a digest between its siblings.
OP13_SQL = r"""
with recursive e as (
  select doc_id, lang, n_chars, cast(doc_id as varchar) as d, @doc_id || @source || @lang as a, @text as z from documents
), c as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, [cast(unicode(x) as bigint) for x in string_split(d, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::bigint[]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) as crc from e
), l as (
  select doc_id, lang, sha256(a || @n_chars || z) as leaf, case when crc % 7 = 0 and n_chars is not null then sha256(a || @(n_chars + 1) || z) end as changed from c
), i as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from l
), t(lang, level, nodes) as (
  select lang, 0, list(leaf order by i) from i group by lang
  union all
  select lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) from t where len(nodes) > 1
), s as (
  select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as j from t where len(nodes) = 1
), u(level, nodes) as (
  select 0, list(subroot order by j) from s
  union all
  select level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) from u where len(nodes) > 1
), r as (
  select nodes[1] as root from u where len(nodes) = 1
), k as (
  select i.lang, i, level, nodes, i >> level as spot from i join t on i.lang is not distinct from t.lang where len(nodes) > 1
  union all
  select i.lang, i, 1000 + level, nodes, j >> level from i join s on i.lang is not distinct from s.lang, u where len(nodes) > 1
), w as (
  select lang, i, list(case when spot % 2 = 1 then nodes[spot] || '*' else '*' || coalesce(nodes[spot + 2], '') end order by level) as way from k group by lang, i
), f as (
  select doc_id, leaf, subroot, root, coalesce(way, []) as way, coalesce(changed, leaf) as own
  from i join s on i.lang is not distinct from s.lang left join w on i.lang is not distinct from w.lang and i.i = w.i, r
)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(way, ''), '*', '')) as proof_sha256,
  list_reduce(list_prepend(own, way), lambda d, x: sha256(replace(x, '*', d))) as folded_root,
  list_reduce(list_prepend(own, way), lambda d, x: sha256(replace(x, '*', d))) = root as verified
from f
"""
OP13_SQL = re.sub(r"@\(?(\w+(?: \+ 1)?)\)?", r"coalesce(cast(strlen(cast(\1 as varchar)) as varchar) || ':' || cast(\1 as varchar), '-')", OP13_SQL)

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_lm_score": op2_lm_score,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_ann": op5_ann,
    "op6_minhash": op6_minhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_sharding": op12_sharding,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op11_filter_audit": OP11_SQL,
    "op13_merkle": OP13_SQL,
    "op1_html_text": OP1_SQL,
    "op6_minhash": OP6_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
