"""Phrase collocation mining on a weighted de Bruijn graph.

Only the longest phrases are counted over the corpus. They are edges between
overlapping nodes (their first and last words); a position with fewer words
behind it counts as the end of its piece there. The count of a shorter phrase
is the flow out of its node, the sum of all edges that begin with it, plus the
pieces that end on it: each length is derived from the next longer one.
Nodes with one edge in and one edge out of the same weight are compacted into paths.

A phrase is no more frequent than its rarest word, so words below the least
count end a piece. The most frequent of the others have numbers, and an edge
of such words is a pair of integers; edges with further frequent words, if
there are more than ``head``, are strings and are counted beside them.
Nor is a phrase more frequent than its rarest pair: pairs of numbered words are
counted first, and an edge goes on only as long as its pairs are frequent.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import kernels as K
from ledgerline.llm.common import HEAVY, arrow_batches, staged

#: Words [^\x20\x09]+ in pieces between [.,;:!?\x0A-\x0D].
PIECE_END = K.byte_table(b".,;:!?\n\x0b\x0c\r")
WORDY = ~(PIECE_END | K.byte_table(b" \t"))
#: Parts of a language in the first step of its top list.
SALTS = 64
#: Numbered words at most; edges, and pairs or words, that a worker combines at once; rows it hands over at once; bytes of words that are broadcast.
HEAD, COMBINED, COUNTED, HANDED, BROADCAST_BYTES = 1 << 20, 1 << 18, 1 << 19, 1 << 16, 32 << 20
#: Bits of the table of frequent pairs: 16 to 32 a pair, at most 2 ** TABLE_BITS.
TABLE_BITS = 27
#: Bytes of text that one step works on.
BLOCK = 1 << 20


def _parts(data: np.ndarray, off: np.ndarray, size: int, ahead: int):
    """(first row, offsets, bytes, bytes in which phrases start) of parts of about ``size`` bytes.

    A long text is cut between words; its parts hold ``ahead`` further words where phrases only end.
    """
    for lo, hi in K.slices(off, size):
        a, b = int(off[lo]), int(off[hi])
        if hi - lo > 1 or b - a <= size:
            yield lo, off[lo:hi + 1] - a, data[a:b], b - a
            continue
        while a < b:
            to = min(b, a + size)
            while to < b and WORDY[data[to]]:
                to += 1
            end, more = to, 1 << 10
            while end < b and int(np.count_nonzero(np.diff(WORDY[data[to:end]].astype(np.int8)) < 0)) < ahead:
                end, more = min(b, to + more), more * 2
            yield lo, np.array([0, end - a]), data[a:end], to - a
            a = to


def _strings(w: K.Words, data: np.ndarray) -> pa.Array:
    """The folded words."""
    size = w.end - w.start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    byte = np.repeat(w.start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(K.FOLD[data[byte]]))


def _tokens(batch: pa.RecordBatch, ahead: int, block: int):
    """Per part: words, their bytes, language of each, hash of word and language, whether the next word follows in the piece, phrase starts."""
    data, off = K.text_bytes(batch.column(1))
    lang = batch.column(0).dictionary_encode()
    seeds = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in lang.dictionary.to_pylist()], K.U64)
    codes = lang.indices.to_numpy(zero_copy_only=False)
    for lo, rows, part, to in _parts(data, off, block, ahead):
        w = K.words(part, rows, WORDY, K.FOLD)
        if len(w.start):
            code = codes[lo + w.row]
            ends = np.cumsum(PIECE_END[part], dtype=np.int64)
            linked = np.zeros(len(w.start), bool)
            linked[:-1] = (w.row[1:] == w.row[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1] - 1])
            yield w, part, code, K.mix(w.hash ^ seeds[code]).view(np.int64), linked, int(np.searchsorted(w.start, to)), lang.dictionary


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    arrow_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("t"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """``lang``, ``word``, ``key`` (hash of both), ``n``."""
    def count(batches):
        held, rows = [], 0
        for b in batches:
            for w, data, code, key, _, to, langs in _tokens(b, 0, block):
                found = _strings(w, data).dictionary_encode()
                both = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(langs) + code
                both, first, n = np.unique(both[:to], return_index=True, return_counts=True)
                held.append(pa.RecordBatch.from_arrays([langs.take(pa.array(both % len(langs))), found.dictionary.take(pa.array(both // len(langs))).cast(pa.string()),
                                                        pa.array(key[first]), pa.array(n)], ["lang", "word", "key", "n"]))
                rows += len(both)
                if rows >= COUNTED:
                    yield from out(held)
                    held, rows = [], 0
        if held:
            yield from out(held)

    def out(held):
        summed = pa.Table.from_batches(held).group_by(["lang", "word", "key"], use_threads=False).aggregate([("n", "sum")])
        yield from summed.select(["lang", "word", "key", "n_sum"]).rename_columns(["lang", "word", "key", "n"]).to_batches(HANDED)

    return (_rows(docs, text_col, lang_col).mapInArrow(count, "lang string, word string, key long, n long")
            .groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n")))


def _numbers(keys: np.ndarray, order: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Number of each word (from 1, by frequency), 0 for words without."""
    if not len(keys):
        return np.zeros(len(of), np.int64)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, order[at] + 1, 0)


def _combined(a: np.ndarray, b: np.ndarray, f: np.ndarray):
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(f[order], first) if len(first) else f


def _followed(number: np.ndarray, linked: np.ndarray, words: int) -> list[np.ndarray]:
    """Numbers of each word and of the ``words - 1`` behind it; 0 from the end of its piece, or a word without a number, on."""
    x = [number]
    for _ in range(words - 1):
        x.append(np.concatenate((np.where(linked[:-1], x[-1][1:], 0), [0])))
    for j in range(1, words):
        x[j] = np.where(x[j - 1] > 0, x[j], 0)
    return x


def numbered_pairs(docs: DataFrame, head: np.ndarray, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """``a`` (two numbers in one integer), ``f``: all pairs of numbered words. ``head`` holds the words' keys, most frequent first."""
    order = np.argsort(head)
    keys = head[order]

    def pairs(batches):
        held, rows = [], 0
        for b in batches:
            for _, _, _, key, linked, to, _ in _tokens(b, 1, block):
                x = _followed(_numbers(keys, order, key), linked, 2)
                at = np.flatnonzero(x[1][:to])
                held.append(x[0][at] << 32 | x[1][at])
                rows += len(at)
                if rows >= COUNTED:
                    yield from out(held)
                    held, rows = [], 0
        if held:
            yield from out(held)

    def out(held):
        a, f = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(a), HANDED):
            yield pa.RecordBatch.from_arrays([pa.array(a[lo:lo + HANDED]), pa.array(f[lo:lo + HANDED])], ["a", "f"])

    return _rows(docs, text_col, lang_col).mapInArrow(pairs, "a long, f long").groupBy("a").agg(F.sum("f").alias("f"))


def _slots(a: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(a.astype(K.U64)) & K.U64((1 << bits) - 1)).astype(np.int64)


def pair_table(pairs: DataFrame) -> np.ndarray:
    """Bits at the hashes of ``a``, 32 in each entry.

    A set bit may belong to another pair: the table only tells which pairs
    can't be among ``pairs``. It has a bounded size, whatever their number.
    """
    bits = min(TABLE_BITS, max(10, (16 * pairs.count()).bit_length()))

    def entries(batches):
        for b in batches:
            at = np.unique(_slots(b.column(0).to_numpy(), bits))
            w, first = np.unique(at >> 5, return_index=True)
            if len(w):
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 31), first))], ["w", "v"])

    found = pairs.select("a").mapInArrow(entries, "w long, v long").groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toArrow()
    table = np.zeros(1 << bits - 5, np.uint32)
    table[found.column("w").to_numpy()] = found.column("v").to_numpy().astype(np.uint32)
    return table


def _may_hold(table: np.ndarray, a: np.ndarray) -> np.ndarray:
    at = _slots(a, len(table).bit_length() + 4)
    return (table[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def numbered_edges(docs: DataFrame, head: np.ndarray, table: np.ndarray, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """``a``, ``b``, ``f``: edges of three or four numbered words, two in each integer; 0 stands behind the last.

    A word without a number ends its piece, and so does a pair that is not in ``table``.
    """
    order = np.argsort(head)
    keys = head[order]

    def edges(batches):
        held, rows = [], 0
        for b in batches:
            for _, _, _, key, linked, to, _ in _tokens(b, 3, block):
                number = _numbers(keys, order, key)
                first, second = _followed(number, linked, 2)
                x = _followed(number, (second > 0) & _may_hold(table, first << 32 | second), 4)
                at = np.flatnonzero(x[2][:to])
                held.append(_combined(x[0][at] << 32 | x[1][at], x[2][at] << 32 | x[3][at], np.ones(len(at), np.int64)))
                rows += len(held[-1][0])
                if rows >= COMBINED:
                    yield from out(held)
                    held, rows = [], 0
        if held:
            yield from out(held)

    def out(held):
        columns = _combined(*map(np.concatenate, zip(*held)))
        for lo in range(0, len(columns[0]), HANDED):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + HANDED]) for c in columns], ["a", "b", "f"])

    return _rows(docs, text_col, lang_col).mapInArrow(edges, "a long, b long, f long")


def _hot(heavy: int):
    """Whether the three words of ``a`` and ``c`` are all among the ``heavy`` most frequent ones."""
    return F.expr("a >> 32").between(1, heavy) & F.expr("a & 4294967295").between(1, heavy) & F.col("c").between(1, heavy)


def numbered_counts(edges: DataFrame, pairs: DataFrame, min_count: int, heavy: int) -> DataFrame:
    """``x1`` to ``x4`` (numbers, null behind the last), ``m``, ``f``: phrases of two to four numbered words with ``f >= min_count``.

    ``pairs`` are those of two. Edges lie by their first three words, so that
    three words are counted where the edges are. Where all three are among the
    ``heavy`` most frequent words, edges lie by the fourth too, and the sums of
    three are added up once more; any other three words hold less of the corpus
    than the last of the heavy.
    """
    zero = F.lit(0).cast("long")
    wide = edges.select("a", F.expr("b >> 32").alias("c"), F.expr("b & 4294967295").alias("d"), "f")
    placed = wide.withColumn("s", F.when(_hot(heavy), F.col("d")).otherwise(zero)).repartition("a", "c", "s")
    both = placed.select("a", "c", "s", "f", F.explode(F.when(F.col("d") > 0, F.array(F.col("d"), zero)).otherwise(F.array(zero))).alias("d"))
    summed = both.groupBy("a", "c", "s", "d").agg(F.sum("f").alias("f"))
    level = staged(summed.filter((F.col("f") >= min_count) | ((F.col("d") == 0) & _hot(heavy))), "phrase-edges")
    four = level.filter("d > 0").select("a", "c", "d", "f")
    flow = level.filter("d = 0").select("a", "c", "f")
    again = flow.filter(_hot(heavy)).groupBy("a", "c").agg(F.sum("f").alias("f"))
    three = flow.filter(~_hot(heavy)).unionByName(again).select("a", "c", zero.alias("d"), "f")
    two = pairs.select("a", zero.alias("c"), zero.alias("d"), "f")
    frequent = reduce(DataFrame.unionByName, [x.filter(F.col("f") >= min_count).withColumn("m", F.lit(m)) for m, x in enumerate((two, three, four), 2)])
    return frequent.select(F.expr("a >> 32").alias("x1"), F.expr("a & 4294967295").alias("x2"),
                           F.expr("nullif(c, 0)").alias("x3"), F.expr("nullif(d, 0)").alias("x4"), "m", "f")


def spelled(numbered: DataFrame, words: DataFrame, head: np.ndarray) -> DataFrame:
    """``lang``, ``p``, ``f``, ``m`` of numbered words and phrases."""
    spark = numbered.sparkSession
    numbers = spark.createDataFrame(pa.table({"key": head, "x": np.arange(1, len(head) + 1)}), "key long, x long")
    names = staged(words.join(numbers, "key").select("x", "lang", "word", "n"), "phrase-words")
    out = [names.select("lang", F.col("word").alias("p"), F.col("n").alias("f"), F.lit(1).alias("m"))]
    if (names.agg(F.sum(F.octet_length("word") + 40)).first()[0] or 0) <= BROADCAST_BYTES:
        names = F.broadcast(names)
    numbered = staged(numbered, "phrase-numbers")
    for m in range(2, 5):
        x = numbered.filter(F.col("m") == m)
        for j in range(1, m + 1):
            x = x.join(names.select(F.col("x").alias(f"x{j}"), F.col("word").alias(f"w{j}"), *["lang"] * (j == 1)), f"x{j}")
        out.append(x.select("lang", F.concat_ws(" ", *[f"w{j}" for j in range(1, m + 1)]).alias("p"), "f", "m"))
    return reduce(DataFrame.unionByName, out)


def graph_edges(docs: DataFrame, longest: int = 4, text_col: str = "text", lang_col: str = "lang", head: np.ndarray = np.zeros(0, np.int64),
                block: int = BLOCK) -> DataFrame:
    """``lang``, ``p`` (words joined by a blank), ``m`` (their number), ``t``, ``f``: edges (``m`` = longest) and piece ends (fewer).

    Only those with a word outside ``head``; ``t`` is the place of the first such word.
    """
    order = np.argsort(head)
    keys = head[order]

    def edges(batches):
        for b in batches:
            for w, data, code, key, linked, to, langs in _tokens(b, longest - 1, block):
                inside, number = np.ones(len(linked), bool), _numbers(keys, order, key)
                t, m = np.zeros(len(linked), np.int64), np.zeros(len(linked), np.int64)
                at = np.arange(len(linked))
                index = []
                for j in range(longest):
                    here = np.minimum(at + j, len(at) - 1)
                    m += inside
                    t = np.where(inside & (t == 0) & (number[here] == 0), j + 1, t)
                    index.append(pa.array(here, mask=~inside))
                    inside = inside & linked[here]
                some = np.flatnonzero((t > 0) & (at < to))
                if not len(some):
                    continue
                words, some_rows = _strings(w, data), pa.array(some)
                p = pc.binary_join_element_wise(*[words.take(i.take(some_rows)) for i in index], pa.scalar(" ", pa.large_string()), null_handling="skip").dictionary_encode()
                both = p.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(langs) + code[some]
                both, first, f = np.unique(both, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(both % len(langs))), p.dictionary.take(pa.array(both // len(langs))).cast(pa.string()),
                                                  pa.array(m[some][first]), pa.array(t[some][first]), pa.array(f)], ["lang", "p", "m", "t", "f"])

    return (_rows(docs, text_col, lang_col).mapInArrow(edges, "lang string, p string, m long, t long, f long")
            .groupBy("lang", "p", "m", "t").agg(F.sum("f").alias("f")))


def phrase_counts(edges: DataFrame, longest: int = 4) -> list[DataFrame]:
    """Counts (``lang``, ``p``, ``t``, ``f``) of the edges' phrases of 1 to ``longest`` words that hold their word ``t``: the flow and the piece ends."""
    out = [edges.filter(F.col("m") == longest).select("lang", "p", "t", "f")]
    for m in range(longest - 1, 0, -1):
        flow = out[-1].filter(F.col("t") <= m).select("lang", F.substring_index("p", " ", m).alias("p"), "t", "f")
        ends = edges.filter(F.col("m") == m).select("lang", "p", "t", "f")
        out.append(staged(flow.unionByName(ends).groupBy("lang", "p", "t").agg(F.sum("f").alias("f")), f"phrases-{m}"))
    return out[::-1]


def frequent_phrases(docs: DataFrame, min_count: int = 30, longest: int = 4, head: int = HEAD,
                     text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with ``f >= min_count`` (``lang``, ``p``, ``f``, ``m``), and all words of each language (``lang``, ``n``).

    At most ``head`` words are numbered, the most frequent ones whose hash is
    theirs alone; phrases with any other word are counted as strings. Only
    phrases of up to four words are numbered.
    """
    words = staged(word_counts(docs, text_col, lang_col, block), "phrase-word-counts")
    alone = words.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("k")).filter((F.col("k") == 1) & (F.col("n") >= min_count))
    chosen = alone.orderBy(F.desc("n"), "key").limit(head if longest == 4 else 0).select("key", "n").toArrow()
    keys, n = (chosen.column(c).to_numpy() for c in ("key", "n"))
    total, frequent = words.agg(F.sum("n"), F.count(F.when(F.col("n") >= min_count, 1))).first()
    found = []
    if len(keys):
        heavy = int(np.count_nonzero(n * HEAVY >= total))
        pairs = staged(numbered_pairs(docs, keys, text_col, lang_col, block).filter(F.col("f") >= min_count), "phrase-pairs")
        edges = numbered_edges(docs, keys, pair_table(pairs), text_col, lang_col, block)
        found.append(spelled(numbered_counts(edges, pairs, min_count, heavy), words, keys))
    if frequent > len(keys) or not found:
        counts = phrase_counts(staged(graph_edges(docs, longest, text_col, lang_col, keys, block), "phrase-strings"), longest)
        found += [c.filter(F.col("f") >= min_count).select("lang", "p", "f", F.lit(m).alias("m")) for m, c in enumerate(counts, 1)]
    return staged(reduce(DataFrame.unionByName, found), "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def compact_paths(edges: DataFrame, longest: int = 4) -> DataFrame:
    """``lang``, ``p``, ``path`` (first edge of its compacted path), ``step`` (edges since then).

    An edge continues the one before it if their common node has no other edge
    and both have the same weight. Rounds double the steps followed, so they grow
    with the logarithm of the edges; the edges of a closed ring keep any of its
    edges as ``path``.
    """
    tail = F.substring_index("p", " ", -(longest - 1))
    head = F.substring_index("p", " ", longest - 1)
    ins = edges.groupBy("lang", tail.alias("node")).agg(F.count("*").alias("n"), F.min("p").alias("before"), F.min("f").alias("f"))
    outs = edges.groupBy("lang", head.alias("node")).agg(F.count("*").alias("n"), F.min("p").alias("p"), F.min("f").alias("f"))
    unary = (ins.filter("n = 1").drop("n").join(outs.filter("n = 1").drop("n"), ["lang", "node", "f"])
             .filter(F.col("before") != F.col("p")).select("lang", "p", "before"))
    ahead = staged(edges.select("lang", "p").join(unary, ["lang", "p"], "left").select(
        "lang", "p", F.coalesce("before", "p").alias("path"), F.col("before").isNotNull().cast("long").alias("step")), "phrase-paths")
    for _ in range(max(1, ahead.count()).bit_length()):
        more = ahead.select("lang", F.col("p").alias("path"), F.col("path").alias("next"), F.col("step").alias("more"))
        ahead = staged(ahead.join(more, ["lang", "path"]).select("lang", "p", F.col("next").alias("path"), (F.col("step") + F.col("more")).alias("step"),
                                                                 (F.col("more") > 0).alias("moved")), "phrase-paths")
        if ahead.filter("moved").isEmpty():
            break
        ahead = ahead.drop("moved")
    return ahead.select("lang", "p", "path", "step")


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 30, keep_below: int = 80, longest: int = 4,
                 head: int = HEAD, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``path``, ``step``.

    A phrase of 2 to ``longest`` words with ``a >= min_count`` occurrences scores
    ``floor(2000000 a / (l + r))`` at its lowest cut (ties: first). It is dropped if
    a longer one of those holds it and has at least ``keep_below`` percent of its
    occurrences. ``head`` (see :func:`frequent_phrases`) and ``block`` (bytes of a step) change no result. ``path`` and ``step`` place the longest phrases on their compacted path.

    Edge cases: a null text is empty, a null language is ``und``; repeated rows
    count again; words are whole at any length; other columns are ignored;
    texts without words give no rows, and so does an empty table.
    """
    known, totals = frequent_phrases(docs, min_count, longest, head, text_col, lang_col, block)
    phrases = known.filter("m >= 2")
    word = F.split("p", " ")
    inner = phrases.filter("m >= 3").select("lang", "f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(
            F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice(word, i, k), " "))))).alias("p"))
    covers = inner.groupBy("lang", "p").agg(F.max("f").alias("longer"))
    kept = (phrases.join(covers, ["lang", "p"], "left")
            .filter(F.expr(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(20,0)) < {keep_below} * CAST(f AS DECIMAL(20,0))")))
    cuts = kept.select("lang", "p", F.col("f").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("_l", F.expr("substring_index(p, ' ', k)")).withColumn("_r", F.expr("substring_index(p, ' ', k - m)"))
    part = known.filter(F.col("m") < longest).select("lang", "p", "f")
    cuts = (cuts.join(part.withColumnsRenamed({"p": "_l", "f": "l"}), ["lang", "_l"])
            .join(part.withColumnsRenamed({"p": "_r", "f": "r"}), ["lang", "_r"]))
    score = F.expr("CAST((2000000 * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = staged(lowest.select("lang", F.col("p").alias("phrase"), "a", "c.l", "c.r", "c.score"), "phrase-scores")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = (scored.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
             .withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_k") <= top))
    best = (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= top).drop("_s", "_k"))
    paths = compact_paths(staged(known.filter(F.col("m") == longest).select("lang", "p", "f"), "phrase-graph"), longest)
    return (best.join(totals, "lang").join(paths.withColumnRenamed("p", "phrase"), ["lang", "phrase"], "left")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path", "step"))
