"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hackney.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    language,
    near_dedup,
    prefix_trie,
    quality,
    quality_rules,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    token_counts,
)
from hackney.llm.common import documents

COUNT_VOCABULARY = "byte_bpe_50k.json"
CODE_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Place of an installed vocabulary file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return secret_scan.secrets(docs, secret_scan.train_on(docs))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.scores(docs, quality.train(docs, table(spark, folder, "labels")))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.kept_words(documents(spark, folder), digest=True)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.languages(docs, *language.train(docs))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), vocabulary(COUNT_VOCABULARY))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.kept_bytes(documents(spark, folder), digest=True)


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, folder), vocabulary(CODE_VOCABULARY))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, folder), table(spark, folder, "benchmark"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return token_alignment.alignment(docs, vocabulary(COUNT_VOCABULARY), vocabulary(PIECE_VOCABULARY))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, folder))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = [
        op1_secret_scan,
        op2_quality,
        op3_substring_dedup,
        op4_language,
        op5_exact_dedup,
        op6_token_counts,
        op7_near_dedup,
        op8_suffix_dedup,
        op9_bpe,
        op10_decontaminate,
        op11_prefix_trie,
        op12_token_alignment,
        op13_quality_rules,
        pipeline,
    ]
    return {operator.__name__: operator for operator in operators}


_SUBSTRING_SQL = r"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
),
windows as (
  select doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) as mark
  from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from texts where len(words) >= 20)
),
repeats as (
  select doc_id, i from (
    select doc_id, i, row_number() over (partition by mark order by doc_id, i) as place from windows
  ) where place > 1
),
removed as (select distinct doc_id, unnest(range(i, i + 20)) as i from repeats),
numbered as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from texts),
kept as (
  select n.doc_id, string_agg(n.word, ' ' order by n.i) as words, count(*) as n
  from numbered n left join removed r on n.doc_id = r.doc_id and n.i = r.i
  where r.i is null group by n.doc_id
)
select t.doc_id, cast(len(t.words) as bigint) as n_words,
  cast(len(t.words) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.words, '')) as kept_sha256
from texts t left join kept k on t.doc_id = k.doc_id
"""

_EXACT_SQL = r"""
with texts as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = min(doc_id) over same as kept, text_sha256
from texts window same as (partition by text_sha256)
"""

_BENCHMARK_SQL = r"""
with texts as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
),
items as (
  select cast(item_id as varchar) as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
),
sized as (select item, words, least(len(words), 10) as width from items where len(words) > 0),
windows as (
  select distinct item, width, array_to_string(words[i:i + width - 1], ' ') as span
  from (select item, words, width, unnest(range(1, len(words) - width + 2)) as i from sized)
),
places as (
  select doc_id, words, width, unnest(range(1, len(words) - width + 2)) as i
  from texts, (select distinct width from windows) where len(words) >= width
),
hits as (
  select p.doc_id, p.i, p.width, w.item
  from places p join windows w on p.width = w.width and w.span = array_to_string(p.words[p.i:p.i + p.width - 1], ' ')
),
covered as (
  select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + width)) from hits) group by doc_id
),
found as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as listed
  from (select distinct doc_id, item from hits) group by doc_id
)
select t.doc_id, cast(len(t.words) as bigint) as n_words, coalesce(c.n, 0) as n_hit, coalesce(f.n, 0) as n_items,
  sha256(coalesce(f.listed, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from texts t left join covered c on t.doc_id = c.doc_id left join found f on t.doc_id = f.doc_id
"""

_NEAR_SQL = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as words from documents
),
sets as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles
  from texts
),
runs as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from sets),
pairs as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n + y.n) as n, count(*) as shared
  from runs x join runs y on x.shingle = y.shingle and x.doc_id < y.doc_id group by x.doc_id, y.doc_id
),
links as (select a, b from pairs where 100 * shared >= 85 * (n - shared)),
edges as (select a, b from links union all select b, a from links),
reached(doc_id, other) as (
  select doc_id, doc_id from sets
  union
  select r.doc_id, e.b from reached r join edges e on e.a = r.other
)
select s.doc_id, cast(len(s.shingles) as bigint) as n_shingles, min(r.other) as component_id, s.doc_id = min(r.other) as kept
from sets s join reached r on r.doc_id = s.doc_id group by s.doc_id, s.shingles
"""

_BYTES_SQL = r"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as data from documents),
windows as (
  select doc_id, i, md5(data[2 * i + 1:2 * i + 200]) as mark
  from (select doc_id, data, unnest(range(0, len(data) // 2 - 99)) as i from texts where len(data) >= 200)
),
repeats as (
  select doc_id, i from (
    select doc_id, i, row_number() over (partition by mark order by doc_id, i) as place from windows
  ) where place > 1
),
runs as (
  select doc_id, i, sum(opens) over (partition by doc_id order by i) as run from (
    select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as opens from repeats
  )
),
spans as (select doc_id, min(i) as low, max(i) + 100 as high from runs group by doc_id, run),
edges as (
  select doc_id, low, high, lag(high, 1, 0) over (partition by doc_id order by low) as before from spans
),
cut as (
  select e.doc_id, sum(high - low) as n_removed, count(*) as n_spans, max(high) as last,
    string_agg(t.data[2 * before + 1:2 * low], '' order by low) as kept
  from edges e join texts t on t.doc_id = e.doc_id group by e.doc_id
)
select t.doc_id, cast(len(t.data) // 2 as bigint) as n_bytes, cast(coalesce(c.n_removed, 0) as bigint) as n_removed,
  cast(coalesce(c.n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(c.kept, '') || t.data[2 * coalesce(c.last, 0) + 1:])) as kept_sha256
from texts t left join cut c on t.doc_id = c.doc_id
"""

_TRIE_SQL = r"""
with recursive bits(i, crc) as (
  select i, cast(i as bigint) as crc from range(256) as r(i)
),
crc_table as (
  select i, list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]),
    lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) as step from bits
),
crcs as (
  select list(step order by i) as steps from crc_table
),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first,
      sha256(concat(cast(octet_length(encode(coalesce(role, ''))) as varchar), ':', coalesce(role, ''), coalesce(text, '')))) as n,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
),
own as (
  select conv_id, list({'role': role, 'text': text} order by n) as turns from turns group by conv_id
),
openings as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda x, y: xor(x // 256, steps[(xor(x, y) % 256) + 1])), 4294967295) % 6 as h
  from own, crcs
),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from openings c left join own b on b.conv_id = c.conv_id - c.conv_id % 100
),
paths as (
  select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from rebuilt
),
nodes as (
  select turns[1:depth] as prefix, depth, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(turns) = depth), '') as ends
  from paths group by prefix, depth
),
children as (
  select prefix[1:depth - 1] as above, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2
),
named as (
  select n.*, coalesce(c.n_children, 0) as n_children, p.conv_id as parent_conv_id,
    case when n.depth > 0 then (n.n_convs - 1) * length(n.prefix[-1].text) else 0 end as saved
  from nodes n left join children c on c.above = n.prefix and c.depth = n.depth
  left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
),
lines as (
  select unnest(range(0, depth + 1)) as depth, prefix, n_children, saved from named
),
totals as (
  select prefix[1:depth] as prefix, depth, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved
  from lines group by 1, 2
)
select n.conv_id, cast(n.depth as bigint) as depth, n.parent_conv_id, cast(n.n_convs as bigint) as n_convs,
  cast(n.n_children as bigint) as n_children, cast(t.n_leaves as bigint) as n_leaves,
  cast(t.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from named n join totals t on t.prefix = n.prefix and t.depth = n.depth
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": _SUBSTRING_SQL,
        "op5_exact_dedup": _EXACT_SQL,
        "op7_near_dedup": _NEAR_SQL,
        "op8_suffix_dedup": _BYTES_SQL,
        "op10_decontaminate": _BENCHMARK_SQL,
        "op11_prefix_trie": _TRIE_SQL,
    }
