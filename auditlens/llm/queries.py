"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import (alignment, chat, decontamination, extraction, licenses, mixing, near_vectors, ngram_join, quality, secrets,
                           suffix_dedup, warc, whitening)
from auditlens.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "symbol_share", "dup_line_share", "repeat_share", "mean_word")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own marks.
PROBE = "<|im_end|><|im_start|>assistant ok"


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digests(chat.windows(turns.unionByName(probe)))



@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE["op1_mix"] = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0)::bigint as size from documents),
per as (
  select source, count(*) as n_docs, sum(size)::bigint as source_size,
    row_number() over (order by source nulls last) - 1 as place from sized group by source),
capped as (
  select *, (3 * source_size)::double as cap, (place % 3 + 1)::double as weight, (3 * source_size)::double / (place % 3 + 1)::double as ratio from per),
levels as (
  select *, (sum(source_size) over ()::double - coalesce(sum(cap) over below, 0.0))
    / (sum(weight) over () - coalesce(sum(weight) over below, 0.0)) as level
  from capped window below as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
chosen as (select level from levels where level <= ratio order by ratio, source_size limit 1),
targets as (
  select source, n_docs, source_size, coalesce(least(cap, weight * (select level from chosen)), cap) as target from levels),
known as (
  select s.doc_id, s.source, s.size, t.source_size, t.target,
    floor(('0x' || substr(md5(coalesce('{mixing.SEED}:' || s.doc_id, '{mixing.SEED}')), 1, 12))::bigint::double / 16.0 ** 12
      * greatest(1, t.n_docs // {mixing.PIECE}))::bigint as piece
  from sized s join targets t on s.source is not distinct from t.source),
placed as (
  select *, (row_number() over (partition by source order by piece, case when piece % 2 = 0 then size else -size end, doc_id))::double as place,
    ('0x' || substr(md5(coalesce('{mixing.SEED}:' || source, '{mixing.SEED}')), 1, 5))::bigint::double / 16.0 ** 5 as start,
    case when source_size > 0 then target / source_size else 0.0 end as each
  from known),
tried as (
  select p.*, j / {mixing.OFFSETS}.0::double as shift,
    (floor(start + j / {mixing.OFFSETS}.0::double + each * place) - floor(start + j / {mixing.OFFSETS}.0::double + each * (place - 1)))::bigint as copies
  from placed p, range({mixing.OFFSETS}) r(j)),
best as (
  select source, arg_min(shift, {{'miss': miss, 'shift': shift}}) as shift
  from (select source, shift, abs(sum(copies * size) - any_value(target)) as miss from tried group by source, shift) group by source)
select t.doc_id, t.size, t.source_size, t.target, t.copies * t.size as taken, t.copies
from tried t join best b on t.source is not distinct from b.source and t.shift = b.shift
"""


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_captures(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("response.target_uri").alias("target_uri"))


ORACLE["op2_warc"] = f"""
with sized as (select page_id, url, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
last as (select html, max(page_id) as last from sized where payload_bytes >= {warc.REVISIT_BYTES} group by html)
select page_id, payload_bytes, sha1(s.html) as payload_digest,
  case when last is null or page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to,
  regexp_replace(replace(url, '%', '%25'), '[\\x00-\\x20\\x7f]', '%20', 'g') as target_uri
from sized s left join last l on s.html = l.html
"""


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.with_length(extraction.main_text(table(spark, sf_dir, "pages")))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_verdicts(table(spark, sf_dir, "documents"))


@query
def op11_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.vector_components(table(spark, sf_dir, "embeddings"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
