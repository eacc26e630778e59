"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import attention_lm, bpe, decontaminate, html_text, near_duplicates, preferences, quality, repeats, topk, warc
from lexigraph.llm.common import crc_bucket, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), "text", path, public_tokenizers.PATTERN)


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket("doc_id", 5) == 0
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), held_out=held_out)
    return quality.score(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= model.cut).cast("int").alias("predicted"),
    )


@_query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar(table(spark, sf_dir, "documents"))


ORACLES["op9_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 70 * (p.n + q.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
e AS (SELECT doc_id, coalesce(hash(list_sort(list(g))), 0) AS h FROM s GROUP BY doc_id),
k AS (SELECT e.doc_id, min(f.doc_id) AS class_id, count(*) AS class_size FROM e JOIN e f ON e.h = f.h GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
  (SELECT count(*) FROM l WHERE l.x = d.doc_id)::BIGINT AS n_similar, c.component_id,
  coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.class_size, 1)::BIGINT AS class_size
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


@_query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.pmod("vec_id", F.lit(50)) == 0)


ORACLES["op6_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    held_out = crc_bucket("doc_id", 7) == 2
    return attention_lm.score(table(spark, sf_dir, "documents"), held_out, path, public_tokenizers.PATTERN)


@_query
def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.format_pairs(preferences.echo_pairs(table(spark, sf_dir, "conversations")))

    def spans(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask")
    )


ORACLES["op1_preferences"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS place, coalesce(lag(text) OVER w, '') AS before
  FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
l AS (SELECT conv_id, max(place) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (
  SELECT t.conv_id, t.place, last, role, text AS c, CASE WHEN place = last THEN before ELSE text END AS d FROM t JOIN l USING (conv_id) WHERE place <= last),
f AS (SELECT conv_id, coalesce(min(CASE WHEN c <> d THEN place END), max(place) + 1) AS first FROM r GROUP BY conv_id),
p AS (
  SELECT conv_id, place, role, first, '<|im_start|>' || role || chr(10) || c || '<|im_end|>' || chr(10) AS c,
    '<|im_start|>' || role || chr(10) || d || '<|im_end|>' || chr(10) AS d FROM r JOIN f USING (conv_id)),
s AS (
  SELECT *, coalesce(sum(CASE WHEN place >= first THEN length(c) END) OVER (PARTITION BY conv_id ORDER BY place), 0) AS ce,
    coalesce(sum(CASE WHEN place >= first THEN length(d) END) OVER (PARTITION BY conv_id ORDER BY place), 0) AS de FROM p)
SELECT conv_id, (max(first) - 1)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN place < first THEN c END, '' ORDER BY place), '') AS prompt,
  coalesce(string_agg(CASE WHEN place >= first THEN c END, '' ORDER BY place), '') AS chosen,
  coalesce(string_agg(CASE WHEN place >= first AND role = 'assistant' THEN (ce - length(c) + 22)::BIGINT || '-' || (ce - 1)::BIGINT END, ',' ORDER BY place), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN place >= first THEN d END, '' ORDER BY place), '') AS rejected,
  coalesce(string_agg(CASE WHEN place >= first AND role = 'assistant' THEN (de - length(d) + 22)::BIGINT || '-' || (de - 1)::BIGINT END, ',' ORDER BY place), '') AS rejected_mask
FROM s GROUP BY conv_id
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
