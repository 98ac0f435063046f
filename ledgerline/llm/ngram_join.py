"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence, pruned by size-derived bounds.

Documents with one and the same n-gram set form a class; a class is one row of
the incidence matrix. Its n-grams are put in order of rarity (hashed counts over
all documents), and only the first ``n - ceil(t n) + 1`` columns of a row are
kept: two rows that are similar enough share one of those.

1. Columns with a single row hold no pair. Of two rows, only the one whose kept
   columns end first can share n-grams behind them; its other shared ones are
   columns that both keep, and from the first of these on neither row has more
   than ``left`` columns that others keep as well.
2. Every row is compared with one centre, the row with the fewest lone columns
   among the columns they share: a large group of near copies becomes a star.
3. The product, blocked by columns, accumulates the columns where rows that are
   not connected yet can meet first and still reach the overlap their sizes ask
   for; pairs without such a column go, and so do those whose accumulated count,
   with all columns that may follow, stays below that overlap.
4. What remains is verified on the whole n-gram sets of both texts.

No link between rows of different components is skipped, so the components are exact;
links inside a component that exists already are not looked for. :func:`jaccard_pairs`
lists every link: there the product runs over all shared columns and all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import kernels as K
from ledgerline.llm.common import arrow_batches, join_groups, staged
from ledgerline.llm.components import connected_components
from ledgerline.llm.substring_dedup import NO_ID, _pack, _unpacked

#: Hash buckets of the rarity table (one byte each), and buckets per written block.
BITS, BLOCK = 20, 1 << 12


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all word n-grams; a row of fewer words has its whole sequence as one."""
    w = K.words(data, off, K.NOT_BLANK, K.FOLD)
    ok = K.whole(w.row, n)
    row, h = [w.row[:len(ok)][ok]], [K.grams(w.hash, n)[ok]]
    count = np.bincount(w.row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            total = np.full(len(few), k, K.U64)
            for j, c in enumerate(K.odd_constants(k, 1000 * n + k)):
                total += w.hash[first[few] + j] * c
            row.append(few)
            h.append(K.mix(total))
    return np.concatenate(row), np.concatenate(h)


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """One byte per hash bucket: a step of the logarithm of its n-gram count over all texts.

    Tasks hand on compressed blocks of counts; sums are made per block on the
    executors, and a table of 2**BITS bytes comes to the driver, whatever the input.
    """
    import zstandard

    def count(batches):
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            data, off = K.text_bytes(batch.column("text"))
            for lo, hi in K.slices(off):
                _, h = shingles(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)
                total += np.bincount((h >> K.U64(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1).compress
        blocks = [press(total[i:i + BLOCK].tobytes()) for i in range(0, 1 << BITS, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    def add(batches):
        unpress, sums = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(unpress(counts), np.uint32).astype(np.int64)
                sums[block] = sums[block] + c if block in sums else c
        steps = [np.minimum(255, 8 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], ["block", "counts"])

    blocks = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block")
    table = np.zeros(1 << BITS, np.uint8)
    for r in blocks.mapInArrow(add, "block int, counts binary").collect():
        table[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint8)
    return table


def ngram_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, ``size`` (distinct n-grams), two 64-bit sums that identify the set, and its first columns by rarity."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(rarity(docs, n).tobytes())

    def rows(batches):
        steps = np.frombuffer(order.value, np.uint8)
        for batch in batches:
            data, off = K.text_bytes(batch.column("text"))
            for lo, hi in K.slices(off):
                row, h = shingles(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)
                step = steps[(h >> K.U64(64 - BITS)).astype(np.int64)]
                by = np.lexsort((h, step, row))
                row, h = row[by], h[by]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                row, h = row[new], h[new]
                size = np.bincount(row, minlength=hi - lo)
                first = np.cumsum(size) - size
                keep = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
                kept = h[np.arange(len(h)) - first[row] < keep[row]] if len(h) else h
                sums = np.zeros((2, hi - lo), K.U64)
                some = size > 0
                if some.any():
                    sums[0, some] = np.add.reduceat(K.mix(h), first[some])
                    sums[1, some] = np.add.reduceat(K.mix(h ^ K.U64(K.BASE)), first[some])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(kept.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)),
                     pa.array(sums[1].view(np.int64)), lists], ["id", "size", "sum1", "sum2", "columns"])
    return docs.mapInArrow(rows, "id long, size long, sum1 long, sum2 long, columns array<long>")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, with ``overlap``. ``texts``: id, packed."""
    def compare(batches):
        for batch in batches:
            a_all, b_all = [], []
            for column, into in (("ta", a_all), ("tb", b_all)):
                for lo, data, off in _unpacked(batch.column(column)):
                    row, h = shingles(data, off, n)
                    row, h = K.distinct_per_row(row, h)
                    into.append((row + lo, h))
            rows = np.concatenate([x[0] for x in a_all + b_all]) if a_all else np.zeros(0, np.int64)
            hs = np.concatenate([x[1] for x in a_all + b_all]) if a_all else np.zeros(0, K.U64)
            both = np.bincount(rows, minlength=len(batch))
            by = np.lexsort((hs, rows))
            rows, hs = rows[by], hs[by]
            twice = (rows[1:] == rows[:-1]) & (hs[1:] == hs[:-1])
            overlap = np.bincount(rows[1:][twice], minlength=len(batch))
            ok = pa.array((100 + percent) * overlap >= percent * both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(overlap).filter(ok)],
                                             ["a", "b", "overlap"])
    one = texts.select(F.col("id").alias("a"), F.col("packed").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("packed").alias("tb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(compare, "a long, b long, overlap long")


def jaccard_links(docs: DataFrame, n: int = 4, percent: int = 85, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): sets per row; class representatives ``rep`` and ``members``; links between
    representatives that connect every component of the similarity graph, or ``every`` link. ``docs``: id, text."""
    sets = staged(ngram_sets(docs, n, percent), "ngram-sets")
    key = ["size", "sum1", "sum2"]
    classes = sets.filter("size > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.first("columns").alias("columns"))
    column = Window.partitionBy("col")
    entries = (classes.select("rep", "size", F.posexplode("columns").alias("place", "col"))
               .withColumn("rows", F.count("*").over(column)).filter("rows > 1").select("col", "rep", "size", "place"))
    entries = staged(entries, "ngram-entries")
    # left: the row's shared columns from this one on; lone: its kept columns that no other row keeps
    own = Window.partitionBy("rep")
    size, shared = F.col("size"), F.count("*").over(own)
    beyond = lambda s: F.ceil(s * percent / 100) - 1  # noqa: E731  columns of a row that are not kept
    entries = staged(entries.select("col", "rep", "size", (shared - F.row_number().over(own.orderBy("place", "col")) + 1).alias("left"),
                                    (size - beyond(size) - shared).alias("lone")), "ngram-entries")

    def reached(one: Column, two: Column, kept: Column) -> Column:
        """Whether rows of these sizes that share at most ``kept`` kept columns can have the overlap their sizes ask for."""
        most = kept + beyond(F.greatest(one, two))
        return (100 * F.least(one, two) >= percent * F.greatest(one, two)) & ((100 + percent) * most >= percent * (one + two))

    def possible(x: str, y: str) -> Column:
        """The same for rows that share a column and none before it."""
        return reached(F.col(f"{x}.size"), F.col(f"{y}.size"), F.least(F.col(f"{x}.left"), F.col(f"{y}.left")))

    def product(rows: DataFrame, wanted: Column) -> DataFrame:
        """Pairs (a, b) of rows that can be similar enough by the columns of ``rows``."""
        x, y = rows.alias("x"), rows.alias("y")
        # columns count from the first shared one on, as long as `possible` holds; behind the last, at most `after` more are shared
        return (x.join(y, (F.col("x.col") == F.col("y.col")) & wanted & possible("x", "y"))
                .groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.size").alias("one"), F.col("y.size").alias("two"))
                .agg(F.count("*").alias("k"), (F.min(F.least("x.left", "y.left")) - 1).alias("after"))
                .filter(reached(F.col("one"), F.col("two"), F.col("k") + F.col("after"))))

    members = sets.filter("size > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    texts = staged(_pack(docs).join(entries.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "ngram-texts")
    once = F.col("x.rep") < F.col("y.rep")
    if every:
        return sets.select("id", *key), members, staged(verified(product(entries, once).select("a", "b").distinct(), texts, n, percent), "product-links")
    row = F.struct("lone", "rep", "size", "left")
    stars = (entries.select(row.alias("x"), F.min(row).over(column).alias("c"))
             .filter((F.col("x.rep") != F.col("c.rep")) & possible("x", "c"))
             .groupBy(F.col("x.rep").alias("rep"), F.col("c.rep").alias("centre")).agg(F.count("*").alias("k"))
             .groupBy("rep").agg(F.max(F.struct("k", F.col("centre").alias("centre"))).alias("best"))
             .select(F.least("rep", "best.centre").alias("a"), F.greatest("rep", "best.centre").alias("b")).distinct())
    first = staged(verified(stars, texts, n, percent), "star-links")

    label = connected_components(first.select("a", "b"))
    named = (entries.join(label.withColumnRenamed("id", "rep"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    open_columns = staged(named.withColumn("apart", F.min("component").over(column) != F.max("component").over(column))
                          .filter("apart").drop("apart"), "open-columns")
    second = staged(verified(product(open_columns, once & (F.col("x.component") != F.col("y.component"))), texts, n, percent), "product-links")
    return sets.select("id", *key), members, first.unionByName(second)


def jaccard_pairs(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, counts) of the whole join, sets and links as in :func:`jaccard_components`.

    ``links``: every linked pair of classes once, by their smallest ids (``a`` < ``b``),
    with the ``overlap`` of their sets. ``counts``: one row per class with a text that
    has words: ``rep``, ``members`` (rows with this set), ``n_links`` (linked classes).
    A group of g different near copies has up to g (g - 1) / 2 links, all listed; a null
    id shows as the smallest long.
    """
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    _, classes, links = jaccard_links(plain, n, percent, every=True)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    counts = classes.join(ends, "rep", "left").select("rep", "members", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return links, counts


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``class_id``, ``component_id``.

    A document's set holds its distinct word ``n``-grams (A-Z in lower case, words
    cut at ASCII white space); with fewer words, the whole sequence is the one
    member. Two documents are linked when ``100 * intersection >= percent * union``.
    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest
    id reachable by links. n-grams are compared by 64-bit hashes, sets by 128 bits.

    Edge cases: null, empty and wordless texts have empty sets and are linked with
    nothing; rows that repeat are one class; rows that share an id but not a text
    are told apart by their sets, and a verification may read either text; a null
    id sorts first; other columns are ignored; empty input gives no rows.
    """
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    sets, classes, links = jaccard_links(plain, n, percent)
    label = connected_components(links.select("a", "b")).withColumnRenamed("id", "rep")
    named = staged(classes.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named-classes")
    some = join_groups(sets.filter("size > 0"), named, ["size", "sum1", "sum2"], "members").select("id", "size", "rep", "component")
    none = sets.filter("size = 0").select("id", "size", F.col("id").alias("rep"), F.col("id").alias("component"))
    kind = docs.schema[id_col].dataType
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
    return some.unionByName(none).select(shown("id").alias(id_col), F.col("size").alias("n_shingles"),
                                         shown("rep").alias("class_id"), shown("component").alias("component_id"))
