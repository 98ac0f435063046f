"""Substring dedup: FM-indexes per shard find word windows that occurred earlier, and every word under one goes.

Windows are sharded by content, so that equal windows always meet: each window
goes by its smallest 8-word hash (its anchor; frequent 8-grams come last), and
neighbouring windows with one anchor travel as one run of words.

1. Runs of equal words are merged, in the task first and then per anchor; all but
   the earliest copy are repeats as a whole. A passage in a third of all
   documents thus counts once per task from here on.
2. An anchor with a single distinct run holds nothing more, unless it comes twice
   in that run (which may then repeat itself). The other earliest runs
   fetch their words and go to their anchor's shard.
3. Each shard builds a compressed FM-index of its runs and streams them through
   it: backward search gives the matching statistics, windows that match in full
   are repeats if the earliest occurrence lies before their own.
4. The repeats are gathered per document and taken out of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import kernels as K
from ledgerline.llm.common import arrow_batches, staged
from ledgerline.llm.fm_index import FMIndex, first_of_ranges

GRAM = 8
#: 8-gram buckets with at least this share of all 8-grams are frequent; there are at most 1/share of them.
FREQUENT = 1 / 16_384
BUCKETS = 1 << 16
#: Runs that a task holds before it merges and hands them on; words of one index.
FLUSH, INDEX_WORDS = 1_000_000, 400_000
NO_ID = -(1 << 63)


def gram_counts(docs: DataFrame, gram: int, buckets: int, text_col: str, fold=None) -> DataFrame:
    """``bucket``, ``n``: word n-grams per hash bucket over all of ``docs``."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, off = K.text_bytes(batch.column(0))
            for lo, hi in K.slices(off):
                w = K.words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], K.NOT_BLANK, fold)
                g = K.grams(w.hash, gram)[K.whole(w.row, gram)]
                total += np.bincount((g % K.U64(buckets)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    return docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def frequent_buckets(docs: DataFrame, gram: int, text_col: str) -> np.ndarray:
    """Flag per bucket. Only frequent ones, a bounded number, come to the driver."""
    counts = staged(gram_counts(docs, gram, BUCKETS, text_col), "gram-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    flag = np.zeros(BUCKETS, bool)
    flag[[r.bucket for r in counts.filter(F.col("n") >= FREQUENT * total).select("bucket").collect()]] = True
    return flag


def _runs(data: np.ndarray, off: np.ndarray, window: int, frequent: np.ndarray):
    """(row, first word, windows, anchor, hash of the words, whether the anchor comes twice) of every run."""
    w = K.words(data, off, K.NOT_BLANK)
    n = len(w.hash) - window + 1
    if n <= 0:
        return None
    g = K.grams(w.hash, GRAM)
    g = (g >> K.U64(1)) | (frequent[(g % K.U64(BUCKETS)).astype(np.int64)].astype(K.U64) << K.U64(63))
    anchor = K.sliding_min(g, window - GRAM + 1)
    ok = np.flatnonzero(K.whole(w.row, window))
    if not len(ok):
        return None
    head = np.ones(len(ok), bool)
    head[1:] = (ok[1:] != ok[:-1] + 1) | (anchor[ok[1:]] != anchor[ok[:-1]]) | (w.row[ok[1:]] != w.row[ok[:-1]])
    at = np.flatnonzero(head)
    first, count = ok[at], np.diff(np.concatenate([at, [len(ok)]]))
    up, down = K._powers(len(w.hash) + 1)
    run = np.concatenate([[K.U64(0)], np.cumsum(w.hash * up[:len(w.hash)])])
    sig = K.mix((run[first + count + window - 1] - run[first]) * down[first] + count.astype(K.U64))
    row = w.row[first]
    span = count + window - GRAM  # 8-grams of each run
    at = np.cumsum(span) - span
    same = g[np.repeat(first - at, span) + np.arange(int(span.sum()))] == np.repeat(anchor[first], span)
    return row, first - np.searchsorted(w.row, row), count, anchor[first], sig, np.add.reduceat(same.astype(np.int64), at) > 1


def _merge(parts: list):
    """Runs of a task, all but the earliest of equal ones marked as repeats (their anchor no longer matters)."""
    doc, start, n, key, sig, twice = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc, n, sig, key))
    doc, start, n, key, sig, twice = doc[order], start[order], n[order], key[order], sig[order], twice[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (key[1:] == key[:-1]) & (sig[1:] == sig[:-1]) & (n[1:] == n[:-1]) & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
    spread = K.mix(doc.view(K.U64) * K.U64(K.BASE) + start.astype(K.U64))
    key = np.where(again, spread, key)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                                       pa.array(key.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(again), pa.array(twice)],
                                      ["id", "start", "n", "key", "sig", "again", "twice"])


def anchored_runs(docs: DataFrame, window: int, frequent: np.ndarray) -> DataFrame:
    """All runs of ``docs`` (id, text)."""
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent).tobytes())

    def cut(batches):
        frequent = np.unpackbits(np.frombuffer(flags.value, np.uint8)).astype(bool)
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            data, off = K.text_bytes(batch.column("text"))
            for lo, hi in K.slices(off):
                found = _runs(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], window, frequent)
                if found is not None:
                    parts.append((ids[lo:hi][found[0]], *found[1:]))
                    held += len(found[0])
            if held > FLUSH:
                yield _merge(parts)
                parts, held = [], 0
        if parts:
            yield _merge(parts)
    return docs.mapInArrow(cut, "id long, start int, n int, key long, sig long, again boolean, twice boolean")


def _pack(docs: DataFrame) -> DataFrame:
    """id and the compressed text: what has to be shuffled to meet the runs."""
    def pack(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [press(t.as_buffer()) if t.is_valid else None for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "packed"])
    return docs.mapInArrow(pack, "id long, packed binary")


def _unpacked(column: pa.Array):
    """The texts of a packed column, a few MB at a time: (first row, bytes, offsets)."""
    unpress = zstandard.ZstdDecompressor().decompress
    rows, held, lo = [], 0, 0
    for i, p in enumerate(column):
        rows.append(unpress(p.as_py()) if p.is_valid else b"")
        held += len(rows[-1])
        if held > K.BLOCK or i == len(column) - 1:
            yield lo, np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            rows, held, lo = [], 0, i + 1


def _pairs(column: pa.Array, lo: int, hi: int):
    """(row, start, n, key) of the struct lists of rows lo .. hi."""
    part = column.slice(lo, hi - lo)
    flat = part.flatten()
    counts = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return (np.repeat(np.arange(hi - lo), counts), *[flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)])


def run_words(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The words of ``runs`` (id, start, n, key), fetched from their documents."""
    per_doc = runs.groupBy("id").agg(F.collect_list(F.struct("start", "n", "key")).alias("runs"))

    def fetch(batches):
        for batch in batches:
            for lo, data, off in _unpacked(batch.column("packed")):
                hi = lo + len(off) - 1
                w = K.words(data, off, K.NOT_BLANK)
                row, start, n, key = _pairs(batch.column("runs"), lo, hi)
                cut = K.per_row(w.row, hi - lo)
                a = cut[row] + start
                b = a + n + window - 2  # last word
                ok = b < cut[row + 1]
                raw = data.tobytes()
                texts = [raw[s:e] for s, e in zip(w.start[a[ok]].tolist(), w.end[b[ok]].tolist())]
                ids = batch.column("id").to_numpy()[lo:hi][row[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(ids), pa.array(start[ok]), pa.array(texts, pa.binary())],
                                                 ["key", "id", "start", "words"])
    joined = per_doc.join(_pack(docs), "id").select("id", "packed", "runs")
    return joined.mapInArrow(fetch, "key long, id long, start int, words binary")


def _repeated(ids: np.ndarray, start: np.ndarray, words: pa.Array, window: int):
    """Windows of a shard's runs that occur earlier in it: (id, first word)."""
    data, off = K.text_bytes(words)
    w = K.words(data, off, K.NOT_BLANK)
    _, symbol = np.unique(w.hash, return_inverse=True)
    lens = np.bincount(w.row, minlength=len(ids))
    place = np.arange(len(w.hash)) + w.row  # every run is followed by a 0
    text = np.zeros(len(w.hash) + len(ids), np.int64)
    text[place] = symbol + 1
    own, absolute = np.zeros(len(text), np.int64), np.full(len(text), -1, np.int64)
    own[place] = ids[w.row]
    absolute[place] = start[w.row] + np.arange(len(w.hash)) - (np.cumsum(lens) - lens)[w.row]
    order = np.lexsort((absolute, own))
    new = np.ones(len(text), bool)
    new[1:] = (own[order[1:]] != own[order[:-1]]) | (absolute[order[1:]] != absolute[order[:-1]])
    age = np.empty(len(text), np.int64)
    age[order] = np.cumsum(new)
    index = FMIndex(text)
    at = np.flatnonzero(K.whole(w.row, window))
    length, lo, hi = index.matching_statistics(place[at + window - 1], window)
    full = length >= window
    first = first_of_ranges(age[index.suffix], lo[full], hi[full])
    hit = place[at[full]][first < age[place[at[full]]]]
    return own[hit], absolute[hit]


def shard_repeats(runs: DataFrame, window: int) -> DataFrame:
    """Windows (id, start) of the runs that occur earlier in another run, by one FM-index after the other in each partition."""
    def search(batches):
        held, n = [], 0

        def flush(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            got = _repeated(table["id"].to_numpy(), table["start"].to_numpy().astype(np.int64), table["words"].chunk(0), window)
            return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1].astype(np.int32))], ["id", "start"])

        for batch in batches:
            while batch.num_rows:
                size = batch.column("words").nbytes // 6
                if n + size < INDEX_WORDS:
                    held, n = [*held, batch], n + size
                    break
                key = batch.column("key").to_numpy()
                # an index ends where an anchor ends; without such a place it grows
                ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                if held and held[-1].column("key")[-1].as_py() != key[0]:
                    ends = np.concatenate([[0], ends])
                want = (INDEX_WORDS - n) * len(key) // max(1, size)
                if not len(ends):
                    held, n = [*held, batch], n + size
                    break
                cut = int(ends[min(np.searchsorted(ends, want), len(ends) - 1)])
                parts = [*held, *([batch.slice(0, cut)] if cut else [])]
                if parts:
                    yield flush(parts)
                held, n, batch = [], 0, batch.slice(cut)
        if held:
            yield flush(held)
    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(search, "id long, start int")


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``text`` (words that stay, joined by one blank).

    Words are runs of bytes that are not ASCII white space. A word goes if a
    window of ``window`` consecutive words over it also starts earlier: in a
    document of smaller id, or earlier in the same one. All windows are judged on
    the input. Words are compared by 64-bit hashes, whole runs by 128 bits.

    Edge cases: null, empty and short texts lose nothing (a null text gives an
    empty one); a null id sorts first; rows that share an id count as one
    document: neither is earlier, and what is found for the id goes from each;
    other columns are ignored; empty input gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    if not GRAM <= window <= 32:
        raise ValueError(f"window must be between {GRAM} and 32 words")
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    frequent = frequent_buckets(plain, GRAM, "text")
    equal = Window.partitionBy("key", "sig", "n").orderBy("id", "start")
    anchor = Window.partitionBy("key")
    seen = (anchored_runs(plain, window, frequent).withColumn("again", F.col("again") | (F.rank().over(equal) > 1))
            .withColumn("shared", F.col("twice") | (F.min("sig").over(anchor) != F.max("sig").over(anchor))))
    runs = staged(seen.filter(F.col("again") | F.col("shared")).select("id", "start", "n", "key", "again"), "repeat-runs")
    matched = shard_repeats(run_words(plain, runs.filter(~F.col("again")), window), window)
    repeats = runs.filter("again").select("id", "start", "n").unionByName(matched.select("id", "start", F.lit(1).alias("n")))
    per_doc = repeats.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("repeats"))

    def strip(batches):
        for batch in batches:
            for lo, data, off in _unpacked(batch.column("packed")):
                hi = lo + len(off) - 1
                w = K.words(data, off, K.NOT_BLANK)
                cut = K.per_row(w.row, hi - lo)
                row, start, n = _pairs(batch.column("repeats"), lo, hi)
                a = np.minimum(cut[row] + start, cut[row + 1])
                b = np.minimum(a + n + window - 1, cut[row + 1])
                depth = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
                stay = np.cumsum(depth[:-1]) == 0
                # bytes of the words that stay, each with the byte behind it turned into a blank, but for a row's last
                keep = np.flatnonzero(stay)
                last = np.ones(len(keep), bool)
                last[:-1] = w.row[keep[1:]] != w.row[keep[:-1]]
                mark = np.zeros(len(data) + 1, np.int32)
                mark[w.start[keep]] += 1
                stop = w.end[keep] + ~last
                np.add.at(mark, stop, -1)
                take = np.cumsum(mark[:-1]) > 0
                out = data.copy()
                out[w.end[keep[~last]]] = 32
                ends = np.concatenate([[0], np.cumsum(take)])[off].astype(np.int32)
                text = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(ends.tobytes()), pa.py_buffer(out[take].tobytes()))
                n_words = np.diff(cut)
                kept = np.bincount(w.row[keep], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(n_words), pa.array(n_words - kept), text],
                                                 ["id", "n_words", "n_removed", "text"])

    every = _pack(plain).join(per_doc, "id", "left").select("id", "packed", "repeats")
    out = every.mapInArrow(strip, "id long, n_words long, n_removed long, text string")
    kind = docs.schema[id_col].dataType
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias(id_col), "n_words", "n_removed", "text")
