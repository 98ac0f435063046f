"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k on their ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import kernels as K
from ledgerline.llm.common import arrow_batches, staged
from ledgerline.operators.ids import allocate_ids


PUNCTUATION = K.byte_table(b for b in range(33, 127) if not chr(b).isalnum())


def _features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every token and every pair of neighbouring tokens; runs of punctuation are tokens like words."""
    w, p = K.words(data, off, K.WORDY, K.FOLD), K.words(data, off, PUNCTUATION)
    order = np.argsort(np.concatenate([w.start, p.start]), kind="stable")
    row, h = np.concatenate([w.row, p.row])[order], np.concatenate([w.hash, p.hash])[order]
    pairs = K.whole(row, 2)
    return (np.concatenate([row, row[:len(pairs)][pairs]]),
            np.concatenate([h % K.U64(buckets), K.grams(h, 2)[pairs] % K.U64(buckets)]).astype(np.int64))


def bucket_counts(docs: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """n-grams per bucket over all of ``docs``; ``buckets`` rows come to the driver."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, off = K.text_bytes(batch.column(0))
            for lo, hi in K.slices(off):
                _, b = _features(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], buckets)
                total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = (docs.select(text_col).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float) -> np.ndarray:
    """Log probability ratio per bucket; the target model is smoothed towards the raw one.

    ``prior`` raw-like n-grams per bucket (on average) stand in for what a
    bounded target sample has not seen, so that chance does not weigh.
    """
    raw_p = (raw + 1.0) / (raw.sum() + len(raw))
    strength = prior * len(raw)
    return np.log((target + strength * raw_p) / (target.sum() + strength)) - np.log(raw_p)


def importance_sample(docs: DataFrame, target: DataFrame, share: float, buckets: int = 10_000, prior: float = 100.0, seed: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its weight and whether the sample holds it.

    Two bags of hashed words and word pairs are fitted: on ``target`` (texts of
    the wanted kind) and on all of ``docs``. ``log_weight`` is a text's log
    likelihood ratio, summed over its n-grams. ``sample_key`` adds Gumbel noise
    drawn from a hash of (seed, id, text), so that the ``k`` largest keys are a
    sample of size k without replacement in proportion to the weights, and the
    same one on every run. k is ``share`` of the rows, rounded up. ``rank`` is
    the place in that order (ties: by id, then text hash), ``kept`` is rank <= k.

    Edge cases: null, empty and wordless texts have weight 0; rows that repeat id
    and text get the same key and neighbouring ranks; an empty target makes
    every weight depend on the raw model alone; empty input gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    ratio = spark.sparkContext.broadcast(log_ratio(bucket_counts(target, buckets, text_col), bucket_counts(docs, buckets, text_col), prior))

    def score(batches):
        w = ratio.value
        for batch in batches:
            data, off = K.text_bytes(batch.column("text"))
            out, n_grams = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for lo, hi in K.slices(off):
                row, b = _features(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], buckets)
                out[lo:hi] = np.bincount(row, w[b], minlength=hi - lo)
                n_grams[lo:hi] = np.bincount(row, minlength=hi - lo)
            noise = -np.log(-np.log(K.unit(batch.column("draw").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("draw"), pa.array(n_grams), pa.array(out), pa.array(out + noise)],
                ["id", "draw", "n_grams", "log_weight", "sample_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), id_col, text_col).alias("draw"),
                       F.col(text_col).alias("text"))
    scored = staged(rows.mapInArrow(score, f"id {kind}, draw long, n_grams long, log_weight double, sample_key double")
                    .withColumn("_down", -F.col("sample_key")), "importance-scores")
    start = spark.range(1).select(F.lit(0).cast("long").alias("_base"))
    ranked = allocate_ids(scored, ["_down", "id", "draw"], "rank", start)
    k = -int(-scored.count() * share // 1)
    return ranked.select(F.col("id").alias(id_col), "n_grams", "log_weight", "sample_key", "rank", (F.col("rank") <= k).alias("kept"))


def labelled_target(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> tuple[DataFrame, float]:
    """Texts of good quality and not toxic, at most ``bound`` of them (a hash of the id picks), and the share of good quality labels."""
    good = F.col("quality") == 1
    n, n_good = labels.agg(F.count("*"), F.coalesce(F.sum(good.cast("long")), F.lit(0))).first()
    picked = labels.filter(good & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.join(F.broadcast(picked), "doc_id", "left_semi"), (n_good / n if n else 1.0)
