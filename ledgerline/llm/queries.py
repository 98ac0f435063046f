"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerline.llm.collocations import collocations
from ledgerline.llm.common import table
from ledgerline.llm.decontaminate import contamination
from ledgerline.llm.exact_dedup import exact_duplicates
from ledgerline.llm.importance import importance_sample, labelled_target
from ledgerline.llm.language_id import language_id
from ledgerline.llm.lattice import decode, sample_encode
from ledgerline.llm.ngram_join import jaccard_components
from ledgerline.llm.pii import pseudonymise
from ledgerline.llm.registry import register
from ledgerline.llm.sharding import balanced_shards
from ledgerline.llm.spelling import spelling_groups
from ledgerline.llm.substring_dedup import remove_repeats
from ledgerline.llm.token_counts import token_counts
from ledgerline.llm.topk_search import exact_topk


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; LEDGERLINE_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("LEDGERLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_importance_resampling")
def op1_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    target, share = labelled_target(docs, table(spark, sf_dir, "labels"))
    return importance_sample(docs, target, share)


@register("op4_language_id")
def op4_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


@register("op6_decontamination", sql=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s
    FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (
    SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
""")
def op6_decontamination(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op7_exact_dedup", sql="""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op7_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


@register("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    out = token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("*", (F.col("n_tokens") > 512).alias("over_limit"))


@register("op2_sentencepiece_sampling")
def op2_sentencepiece_sampling(spark, sf_dir):
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = sample_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return decode(encoded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


@register("op3_balanced_shards")
def op3_balanced_shards(spark, sf_dir):
    out = balanced_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@register("op5_pii_pseudonyms")
def op5_pii_pseudonyms(spark, sf_dir):
    key = os.environ.get("LEDGERLINE_PII_KEY", "ledgerline").encode()
    out = pseudonymise(table(spark, sf_dir, "documents"), key)
    return out.select("doc_id", F.size("spans").cast("long").alias("n_values"), "spans", "text",
                      F.sha2("text", 256).alias("text_sha256"))


@register("op10_substring_dedup", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY word.p) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""")
def op10_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op9_ngram_jaccard")
def op9_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    return spelling_groups(table(spark, sf_dir, "documents"))


@register("op12_exact_topk", sql="""
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
""")
def op12_exact_topk(spark, sf_dir):
    return exact_topk(table(spark, sf_dir, "embeddings"), F.expr("id % 50 = 0"))


@register("op13_collocations")
def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents")).drop("path", "step")
