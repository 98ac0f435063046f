"""Benchmark decontamination: prefix-filtered set join of item windows against whole documents, JVM-side only.

A window is a run of consecutive item words. All of its words must be in a
document, so the prefix that must be shared has length one: the window's rarest
word by its count in the corpus. Documents join on that word alone; the word's
place in the window gives the only possible start, the window's length bounds
it, and the words from there on are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_ROWS, small, staged

#: Words once A-Z are lower case are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; upper-case letters belong to words before that.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def item_windows(items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``win`` (words joined by a blank), ``len``, ``items`` (ids that hold it)."""
    words = items.select(F.col(id_col).alias("_item"), _words(text_col).alias("_w")).filter(F.size("_w") > 0)
    n = F.least(F.size("_w"), F.lit(window))
    starts = words.select("_item", "_w", n.alias("len"),
                          F.explode(F.sequence(F.lit(1), F.size("_w") - n + 1)).alias("_s"))
    cut = starts.select("_item", "len", _ascii_lower(F.array_join(F.slice("_w", F.col("_s"), F.col("len")), " "))
                        .alias("win"))
    return cut.groupBy("win", "len").agg(F.collect_set("_item").alias("items"))


def _tokens(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """One row per word of a document and one of the empty word behind its last, with the word list at hand."""
    listed = docs.select(*keep, _words(text_col).alias("_words"))
    return listed.select(*[c for c in listed.columns],
                         F.posexplode(F.array_append("_words", F.lit(""))).alias("_pos", "_word"))


def window_prefixes(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """Each window with its prefix: the word that is rarest over all of ``docs``, and its place in the window.

    Words are compared in lower case here (of all alphabets): a superset of the matches, verified later.
    """
    placed = windows.select("win", "len", "items", F.posexplode(F.split(F.lower("win"), " ")).alias("_off", "_key"))
    vocabulary = small(staged(placed.select("_key").distinct(), "window-vocabulary"))
    counts = (_tokens(docs, text_col).select(F.lower("_word").alias("_key")).join(vocabulary, "_key")
              .groupBy("_key").agg(F.count("*").alias("_df")))
    rarest = F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_key", "_off"))
    return (placed.join(counts, "_key", "left").groupBy("win", "len").agg(rarest.alias("_r"), F.first("items").alias("items"))
            .select("win", "len", "items", F.col("_r._key").alias("_key"), F.col("_r._off").alias("_off")))


def window_hits(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id",
                text_col: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Every occurrence of an item window in a document, and one row with ``len`` 0 for each document.

    Columns: ``_id``, ``_row`` (hash of the text), ``n_words``, ``start`` (word index), ``len``, ``items``.
    Up to ``limit`` windows are broadcast to the words; more of them are joined by a shuffle (see :func:`_spread_hits`).
    """
    windows = staged(item_windows(items, window), "item-windows")
    prefixes = staged(window_prefixes(docs, windows, text_col), "window-prefixes")
    keep = F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row")
    ids = prefixes.schema["items"].dataType.simpleString()
    none = F.expr(f"CAST(array() AS {ids})")
    if prefixes.count() > limit:
        return _spread_hits(docs, prefixes, text_col, none, *keep)
    # the empty word behind the last one finds this row, so that documents without a hit stay
    every = prefixes.sparkSession.range(1).select(
        F.lit("").alias("win"), F.lit(0).alias("len"), none.alias("items"), F.lit("").alias("_key"), F.lit(0).alias("_off"))
    tokens = _tokens(docs, text_col, *keep).select("_id", "_row", "_words", "_pos", F.lower("_word").alias("_key"))
    # only functions with generated code here: the join then runs inside one stage of generated code,
    # and a word list is never copied for a word without a match
    return (tokens.join(F.broadcast(prefixes.unionByName(every)), "_key").filter(_occurs())
            .select("_id", "_row", F.size("_words").alias("n_words"), _start().alias("start"), "len", "items"))


def _start() -> Column:
    return F.col("_pos") - F.col("_off")


def _occurs() -> Column:
    """Whether the window ``win``, whose word ``_off`` is the document's word ``_pos``, lies there."""
    cut = F.array_join(F.slice("_words", F.greatest(_start(), F.lit(0)) + 1, F.col("len")), " ")
    return (_start() >= 0) & (_start() + F.col("len") <= F.size("_words")) & (_ascii_lower(cut) == F.col("win"))


def _spread_hits(docs: DataFrame, prefixes: DataFrame, text_col: str, none: Column, *keep: Column) -> DataFrame:
    """The hits by shuffles: words travel as (document, place, key); a word list only once, to its document's candidates."""
    listed = docs.select(*keep, _words(text_col).alias("_words"))
    places = listed.select("_id", "_row", F.size("_words").alias("n_words"), F.posexplode("_words").alias("_pos", "_key"))
    places = places.withColumn("_key", F.lower("_key"))
    fits = (_start() >= 0) & (_start() + F.col("len") <= F.col("n_words"))
    found = places.join(prefixes, "_key").filter(fits).select("_id", "_row", "_pos", "_off", "len", "win", "items")
    found = staged(found, "window-candidates").withColumnsRenamed({"_id": "_i", "_row": "_r"})
    texts = listed.dropDuplicates(["_id", "_row"])
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_row").eqNullSafe(F.col("_r"))
    hits = texts.join(found, same).filter(_occurs())
    every = listed.select("_id", "_row", F.size("_words").alias("n_words"), F.lit(0).alias("start"), F.lit(0).alias("len"), none.alias("items"))
    return hits.select("_id", "_row", F.size("_words").alias("n_words"), _start().alias("start"), "len", "items").unionByName(every)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: id, ``text_hash`` (xxhash64 of the text), ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as strings), ``contaminated``.

    A document word is hit if it lies in an occurrence of any window of any item
    (``window`` consecutive words; a shorter item is one window). A document is
    contaminated if ``share * n_hit >= n_words`` and something is hit.

    Edge cases: null or wordless texts have no words and no hits; items without
    words have no window; an item without an id hits words but is not listed;
    rows that repeat id and text are one document; other columns are ignored;
    no items: nothing is hit.
    """
    hits = window_hits(docs, items, window, id_col, text_col, limit)
    spans = F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("start", (F.col("start") + F.col("len")).alias("end")))))
    grouped = hits.groupBy("_id", "_row").agg(
        F.max("n_words").cast("bigint").alias("n_words"), spans.alias("_spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"))
    covered = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"),
                              F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"])
    items_out = F.array_sort(F.transform("_items", lambda i: i.cast("string")))
    out = grouped.select(F.col("_id").alias(id_col), F.col("_row").alias("text_hash"), "n_words", covered.cast("bigint").alias("n_hit"), items_out.alias("items"))
    return out.select(id_col, "text_hash", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
                      ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
