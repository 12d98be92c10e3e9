"""Queries of the operators in this folder over whole tables, and their comparison SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import chats, decontaminate, divergence, fingerprint, neardup, ngrams, packing, quality, secrets, shortpack, toxicity, turns, warc
from flowloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_language_model")
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.language_scores(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_fingerprint")
def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_pack")
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


CHATS_SQL = """
with t as (
  select distinct conv_id, coalesce(turn, -1) as turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), p as (
  select *, row_number() over w as n, count(*) over (partition by conv_id) as size,
         string_agg(turn || chr(1) || role || chr(1) || text, chr(2)) over w as prefix
  from t window w as (partition by conv_id order by turn, role, text rows between unbounded preceding and current row)
), whole as (
  select prefix, min(conv_id) as conv_id, count(*) as copies from p where n = size group by prefix
), kept as (
  select conv_id, copies from whole where prefix not in (select prefix from p where n < size)
)
select conv_id, cast(floor(turn / 256) as bigint) as segment, count(*) as turns, max(copies) as copies,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by turn, role, text) as text
from t join kept using (conv_id) group by conv_id, segment
"""


@query("op9_chats", CHATS_SQL)
def op9_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.chat_rows(table(spark, sf_dir, "conversations"))


@query("op10_warc")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path))


TURNS_SQL = r"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
  from conversations
), f as (
  select *, xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda ch: ascii(ch)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                               lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 20 as fate
  from k
), d as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
         case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when fate = 3 then 2 else 1 end)) as copy
  from f where fate <> 0
), n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, substr(role, 1, 1) as r from d
), m as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
         not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut, lag(r) over (partition by conv_id order by i) as before
  from n
), rows as (
  select conv_id, i, r, role, text, blank or again as must, case when blank or again or not cut then 0 else 1 end as pay from m
), b as (
  select conv_id, max(i) + 1 as i, {'cost': 0, 'audit': '', 'said': ''} as s0,
         {'cost': 4, 'audit': 'II', 'said': chr(10) || 'user:' || chr(10) || 'assistant:'} as s1,
         {'cost': 2, 'audit': 'I', 'said': chr(10) || 'assistant:'} as s2, {'cost': 0, 'audit': '', 'said': ''} as s3
  from rows group by conv_id
  union all
  select conv_id, i, least(n0, {'cost': 2 + u.cost, 'audit': 'I' || u.audit, 'said': chr(10) || 'user:' || u.said}),
         least(n1, {'cost': 2 + u.cost, 'audit': 'I' || u.audit, 'said': chr(10) || 'user:' || u.said}), u,
         least(n3, {'cost': 2 + n2.cost, 'audit': 'I' || n2.audit, 'said': chr(10) || 'user:' || n2.said})
  from (
    select *, least(n2, {'cost': 2 + n3.cost, 'audit': 'I' || n3.audit, 'said': chr(10) || 'assistant:' || n3.said}) as u
    from (
      select conv_id, i,
        least({'cost': 3 + s0.cost, 'audit': 'D' || s0.audit, 'said': s0.said},
              case when not must then {'cost': 2 + pay + s2.cost, 'audit': 'R' || s2.audit, 'said': chr(10) || 'user:' || text || s2.said} end,
              case when not must and r = 'u' then {'cost': pay + s2.cost, 'audit': 'K' || s2.audit, 'said': chr(10) || role || ':' || text || s2.said} end,
              case when not must and r = 's' then {'cost': pay + s1.cost, 'audit': 'K' || s1.audit, 'said': chr(10) || role || ':' || text || s1.said} end) as n0,
        least({'cost': 3 + s1.cost, 'audit': 'D' || s1.audit, 'said': s1.said},
              case when not must then {'cost': 2 + pay + s2.cost, 'audit': 'R' || s2.audit, 'said': chr(10) || 'user:' || text || s2.said} end,
              case when not must and r = 'u' then {'cost': pay + s2.cost, 'audit': 'K' || s2.audit, 'said': chr(10) || role || ':' || text || s2.said} end) as n1,
        least({'cost': 3 + s2.cost, 'audit': 'D' || s2.audit, 'said': s2.said},
              case when not must then {'cost': 2 + pay + s3.cost, 'audit': 'R' || s3.audit, 'said': chr(10) || 'assistant:' || text || s3.said} end,
              case when not must and r = 'a' then {'cost': pay + s3.cost, 'audit': 'K' || s3.audit, 'said': chr(10) || role || ':' || text || s3.said} end) as n2,
        least({'cost': 3 + s3.cost, 'audit': 'D' || s3.audit, 'said': s3.said},
              case when not must then {'cost': 2 + pay + s2.cost, 'audit': 'R' || s2.audit, 'said': chr(10) || 'user:' || text || s2.said} end,
              case when not must and r = 'u' then {'cost': pay + s2.cost, 'audit': 'K' || s2.audit, 'said': chr(10) || role || ':' || text || s2.said} end) as n3
      from (select rows.*, s0, s1, s2, s3 from b join rows on rows.conv_id is not distinct from b.conv_id and rows.i = b.i - 1)
    )
  )
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
         count(*) filter (again and not blank) as duplicate, count(*) filter (cut and not blank and not again) as truncated,
         count(*) filter (before || r not in ('su', 'ua', 'au')) as illegal
  from m group by conv_id
)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank,
       cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
       cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(s0.cost, 0) as bigint) as cost, coalesce(s0.audit, '') as audit,
       sha256(coalesce(substr(s0.said, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts on counts.conv_id is not distinct from o.conv_id
left join b on b.conv_id is not distinct from o.conv_id and b.i = 1
"""


@query("op11_conversation_repair", TURNS_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repairs(table(spark, sf_dir, "conversations"))


DIVERGENCE_SQL = r"""
with d as (
  select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as found
  from documents
), t as (
  select n, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d
), k as (
  select lang, term, count(*) as c from t group by lang, term having count(distinct n) >= 30
), g as (
  select distinct lang, source from d
), v as (
  select lang, count(*) as v, sum(c) as n from k group by lang
), own as (
  select lang, source, term, count(*) as c from t join k using (lang, term) group by lang, source, term
), total as (
  select lang, source, sum(c) as n from own group by lang, source
), p as (
  select lang, source, term, coalesce(own.c, 0) as c,
         1 + (1000000000::hugeint * (coalesce(own.c, 0) + 5)) // (coalesce(total.n, 0)::hugeint + 5 * v) as p,
         1 + (1000000000::hugeint * (k.c + 5)) // (v.n::hugeint + 5 * v) as q
  from g join k using (lang) join v using (lang) left join own using (lang, source, term) left join total using (lang, source)
), pair as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all
  select lang, source, 'term', term, p - q from p where c > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value,
       cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from every qualify part = 'pair' or rank <= 50
"""


@query("op12_divergence", DIVERGENCE_SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_shortest_pack")
def op13_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortpack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
