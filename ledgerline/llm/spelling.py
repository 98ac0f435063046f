"""Spelling variant grouping: blocked Gram matrices of letter counts, adjacent blocks only, edits verified.

A word is the vector of its letters' counts. One edit moves it by a squared
distance of one (a letter more or less) or two (a letter replaced), so pairs
beyond two are no near words. Blocks hold words of one length and one profile:
the counts of a few letter classes. An edit changes a profile by one step, so
a block meets itself and its adjacent blocks of the same and the next length.
A task holds one block, streams the words of the adjacent ones against it, and
compares the words of the pairs that the product leaves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import kernels as K
from ledgerline.llm.common import arrow_batches, staged

#: Letter classes of the profiles, words of a block, letters of a block. They change no result.
CLASSES, BLOCK, LETTERS = 5, 4_096, 1 << 21
ASCII = K.byte_table(b for b in range(128) if chr(b).isalpha())


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def _runs(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (lead byte C3)."""
    lead = data == 0xC3
    inside = ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def _counted(data: np.ndarray, off: np.ndarray, ids: list, rare: int, least: int):
    """(word, n) of the texts' words with at least ``least`` letters, after the deletions."""
    inside = _runs(data)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = False
    cut[off] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    size = end - start
    keep = size >= least
    start, end, size = start[keep], end[keep], size[keep]
    if not len(start):
        return
    folded = K.FOLD[data]
    row = np.searchsorted(off, start, "right") - 1
    seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) ^ 0xFFFFFFFF for i in ids], np.uint32)
    crc = seed[row]
    order = np.argsort(-size, kind="stable")
    state, at, left = crc[order], start[order], -size[order]
    for j in range(int(size.max())):
        m = int(np.searchsorted(left, -j, "left"))
        state[:m] = CRC[(state[:m] ^ folded[at[:m] + j]) & 0xFF] ^ (state[:m] >> np.uint32(8))
    crc[order] = state ^ np.uint32(0xFFFFFFFF)
    odd = np.flatnonzero(crc % rare == 0)
    changed = []
    for i in odd.tolist():
        w = folded[start[i]:end[i]].tobytes().decode()
        x = int(crc[i]) % len(w)
        changed.append(w[:x] + w[x + 1:])
    even = np.ones(len(start), bool)
    even[odd] = False
    start, size = start[even], size[even]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    byte = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    same = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(folded[byte]))
    words = pa.chunked_array([same, pa.array(changed, pa.large_string())])
    found = pc.value_counts(words.filter(pc.greater_equal(pc.utf8_length(words), least)))
    if len(found):
        yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.large_string()).cast(pa.string()), found.field("counts").cast(pa.int64())], ["word", "n"])


def _parts(data: np.ndarray, off: np.ndarray, size: int):
    """(first row, offsets) of parts of about ``size`` bytes; a long text is cut where no run goes on."""
    for lo, hi in K.slices(off, size):
        a, b = int(off[lo]), int(off[hi])
        if hi - lo > 1 or b - a <= size:
            yield lo, off[lo:hi + 1]
            continue
        while a < b:
            to = min(b, a + size)
            while to < b and (data[to] >= 0x80 or ASCII[data[to]]):
                to += 1
            yield lo, np.array([a, to])
            a = to


def spelling_words(docs: DataFrame, rare: int = 199, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: all runs of letters with at least ``least`` code points, lower-cased (A-Z), after the deletions."""
    arrow_batches(docs.sparkSession)

    def count(batches):
        for b in batches:
            data, off = K.text_bytes(b.column(1))
            ids = b.column(0).to_pylist()
            for lo, part in _parts(data, off, K.BLOCK):
                yield from _counted(data[part[0]:part[-1]], part - part[0], ids[lo:lo + len(part) - 1], rare, least)

    return (docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length, one row each, and their letter counts."""
    text = "".join(words.to_pylist())
    codes = np.frombuffer(text.encode("utf-16-le"), np.uint16).reshape(len(words), -1).astype(np.uint8)
    flat = codes.astype(np.int64) + 256 * np.arange(len(words))[:, None]
    counts = np.bincount(flat.ravel(), minlength=256 * len(words)).reshape(len(words), 256)
    return codes, counts[:, [*range(97, 123), *range(0xC0, 0x100)]].astype(np.float64)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (as long, or one letter longer) are one edit apart."""
    n, m = a.shape[1], b.shape[1]
    if n == m:
        return (a != b).sum(1) == 1
    front = np.cumprod(a == b[:, :n], axis=1).sum(1)
    back = np.cumprod(a[:, ::-1] == b[:, :0:-1], axis=1).sum(1)
    return front + back >= n


def near_words(words: DataFrame, classes: int = CLASSES, block: int = BLOCK) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every pair of words exactly one edit apart, in both directions."""
    spark = words.sparkSession
    arrow_batches(spark, rows=block)
    letters = F.split("word", "")
    profile = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)),
                          lambda c: F.size(F.filter(letters, lambda x: F.pmod(F.ascii(x), F.lit(classes)) == c)))
    home = words.select("word", "n", F.length("word").alias("len"), profile.alias("p")).select(
        "word", "n", "len", F.concat_ws(",", F.col("p").cast("array<string>")).alias("cell"), "p")
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(LETTERS) / F.col("len"))))
    sizes = staged(home.groupBy("cell", "len").agg(F.count("*").alias("size")).select(
        "cell", F.ceil(F.col("size") / most).cast("int").alias("parts")), "spelling-cells")
    one = F.sequence(F.lit(0), F.lit(classes - 1))

    def moved(i, by):
        return F.transform("p", lambda x, j: F.when(j == i, x + by).otherwise(x))

    same = F.flatten(F.transform(one, lambda i: F.transform(F.filter(one, lambda j: j > i), lambda j: F.transform(
        F.col("p"), lambda x, y: F.when(y == i, x + 1).when(y == j, x - 1).otherwise(x)))))
    longer = F.transform(one, lambda i: moved(i, 1))
    meets = F.concat(F.array(F.col("p")), same, longer)
    sent = home.select("word", "n", "len", F.explode(F.transform(meets, lambda x: F.concat_ws(",", x.cast("array<string>")))).alias("cell"), F.lit(1).alias("kind"))
    dealt = sent.join(sizes, "cell").select("word", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "kind")
    held = home.join(sizes, "cell").select("word", "n", "cell", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"))

    def product(batches):
        at = None
        for b in batches:
            cell, part, kind = b.column(2), b.column(3).to_numpy(), b.column(4).to_numpy()
            names = cell.dictionary_encode().indices.to_numpy()
            size = pc.utf8_length(b.column(0)).to_numpy()
            step = np.flatnonzero((np.diff(names) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0) | (np.diff(size) != 0)) + 1
            for lo, hi in zip([0, *step], [*step, len(part)]):
                if lo == hi:
                    continue
                if (key := (cell[lo].as_py(), part[lo])) != at:
                    at, mine, held_n, x = key, [], [], None
                w, n = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo).to_numpy()
                if kind[lo] == 0:
                    mine.append(w)
                    held_n.append(n)
                    continue
                if not mine:
                    continue
                if x is None:
                    block_words, block_n = pa.concat_arrays(mine), np.concatenate(held_n)
                    codes, x = _codes(block_words)
                    x_square = (x * x).sum(1)
                for s in range(0, len(w), 512):
                    part_codes, y = _codes(w.slice(s, 512))
                    square = (y * y).sum(1)[:, None] + x_square - 2 * (y @ x.T)
                    i, j = np.nonzero(square <= 2)
                    step_rows = max(1, (1 << 22) // codes.shape[1])
                    for q in range(0, len(i), step_rows):
                        ii, jj = i[q:q + step_rows], j[q:q + step_rows]
                        good = _one_edit(part_codes[ii], codes[jj])
                        ii, jj = ii[good], jj[good]
                        left, right = w.slice(s, 512).take(pa.array(ii)), block_words.take(pa.array(jj))
                        yield pa.RecordBatch.from_arrays([left, pa.array(n[s + ii]), right, pa.array(block_n[jj])], ["word", "n", "near", "near_n"])

    pairs = (held.unionByName(dealt).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", F.length("word"), "word")
             .mapInArrow(product, "word string, n long, near string, near_n long"))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"),
                             F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("x")).select("x.*").distinct()


def spelling_groups(docs: DataFrame, rare: int = 199, least: int = 6, min_n: int = 5, ratio: int = 5,
                    id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, block: int = BLOCK) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    The form is the most frequent near word (ties: first in code-point order) if
    it is at least ``ratio`` times as frequent; the root follows forms to the last.

    Edge cases: null texts have no words, a null id counts as the empty text in the
    hash; repeated rows count again; words of any length are compared whole; other
    columns are ignored; an empty table gives no rows.
    """
    words = staged(spelling_words(docs, rare, least, id_col, text_col).filter(F.col("n") >= min_n), "spelling-words")
    near = near_words(words, classes, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    formed = words.join(near, "word", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    rows = staged(formed.select("word", F.when(good, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(good, -F.col("best.m")).alias("form_n")), "spelling-forms")
    # n grows with every step, so forms end; each round doubles the steps that a word has followed
    ahead = staged(rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = staged(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ahead = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            break
    return rows.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
