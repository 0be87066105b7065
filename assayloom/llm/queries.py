"""The registered queries of the training-data operators: op1_ to op13_ and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayloom.llm import blockjoin, blocknames, brown, bursttrie, editprint, fastsketch, htmlblocks, langid, mixing, packing, segmine, tokenfile, toxicity
from assayloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with the trigram model trained on labelled documents."""
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_class_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmlblocks.extract(pages, htmlblocks.train(pages))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockjoin.nearest(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmine.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursttrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_class_language_model": op3_class_language_model,
    "op4_mixing": op4_mixing,
    "op5_edit_fingerprints": op5_edit_fingerprints,
    "op6_packing": op6_packing,
    "op7_html_blocks": op7_html_blocks,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_exact_dedup": op13_exact_dedup,
}


#: Models, sketches and subword ids can't be said in SQL; exact neighbours can, in the order of summation that op9 keeps, and exact copies.
ORACLE_SQL: dict[str, str] = {
    "op9_nearest_neighbours": """
with v as (
  select distinct vec_id, list_transform(embedding, lambda e: e::double) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, max(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b)) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0 group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20""",
    "op11_hard_negatives": """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 100 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
  from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 10""",
    "op12_conversation_trie": """
with own as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as s
  from conversations where conv_id is not null group by conv_id),
hashed as (
  select conv_id, s, xor(4294967295, list_reduce([4294967295::ubigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, bit: xor(x >> 1, 3988292384::ubigint * (x & 1))))) % 4 as h from own),
rebuilt as (
  select c.conv_id, list_concat(coalesce(r.s, [])[1:c.h], c.s[c.h + 1:]) as s from hashed c left join own r on r.conv_id = c.conv_id - c.conv_id % 20),
prefixes as (select conv_id, len(s) as size, unnest(range(0, len(s) + 1)) as depth, s from rebuilt),
placed as (select conv_id, size, depth, s[1:depth] as p, min(conv_id) over (partition by s[1:depth], depth) as lo from prefixes),
nodes as (
  select lo, depth, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256,
    case when depth > 0 then len(regexp_extract_all(any_value(p)[depth].text, '[^\x20\x09-\x0D]+')) else 0 end as words
  from placed group by lo, depth),
family as (select n.*, a.lo as up_lo, a.depth as up_depth from nodes n join placed a on a.conv_id = n.lo and a.depth <= n.depth),
counted as (select up_lo as lo, up_depth as depth, count(*) filter (where family.depth = up_depth + 1) as n_children, sum((n_convs - 1) * words)::bigint as saved_tokens from family group by all),
leaves as (select f.up_lo as lo, f.up_depth as depth, count(*) as n_leaves from family f join counted c on c.lo = f.lo and c.depth = f.depth where c.n_children = 0 group by all)
select n.lo as conv_id, n.depth::bigint as depth, up.up_lo as parent_conv_id, n.n_convs, c.n_children, l.n_leaves, c.saved_tokens, n.ends_sha256
from nodes n join counted c on c.lo = n.lo and c.depth = n.depth join leaves l on l.lo = n.lo and l.depth = n.depth
left join family up on up.lo = n.lo and up.depth = n.depth and up.up_depth = n.depth - 1""",
    "op13_exact_dedup": """
with folded as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from max(doc_id) over w as kept, sha256(body) as text_sha256
from folded window w as (partition by body)""",
}
