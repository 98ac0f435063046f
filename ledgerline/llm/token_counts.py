"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies.

1. Every task counts its pre-tokens; one aggregation gives the distinct ones of
   the corpus with their frequency, and the library cuts each of them once.
2. Pre-tokens with at least 1/``head`` of all occurrences -- so at most ``head``
   of them, whatever the input -- are broadcast with their piece counts. Each document sums them where it lies; only its
   other pre-tokens, with their frequency, go through a shuffle join on the
   pre-token. Frequent keys never meet in one task, and no id is ever listed.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_batches, staged

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a task holds before it hands them on.
FLUSH = 400_000


class ByteLevelVocabulary:
    """A byte-level BPE tokenizer file: its special strings, its pre-tokens, its piece counts."""

    def __init__(self, source: str):
        self.source = source
        spec = json.loads(source)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is counted by pre-tokens")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("special tokens that take white space or need word borders are not supported")
        self.special = [t["content"] for t in added]

    def splitter(self):
        """Function: text -> (number of special tokens, list of pre-tokens)."""
        import regex

        find = regex.compile(PATTERN).findall
        special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

        def split(text: str) -> tuple[int, list[str]]:
            if special is None or not any(s in text for s in self.special):
                return 0, find(text)
            parts = special.split(text)
            return len(parts) - 1, [t for p in parts for t in find(p)]
        return split

    def counter(self):
        """Function: list of pre-tokens -> number of pieces of each."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(self.source)
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def pretoken_pieces(docs: DataFrame, vocabulary: ByteLevelVocabulary, text_col: str = "text") -> DataFrame:
    """The distinct pre-tokens of the corpus: ``token``, ``freq``, ``pieces``."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary.source)

    def frequencies(batches):
        split, seen = ByteLevelVocabulary(source.value).splitter(), Counter()
        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()):
                    seen.update(split(t)[1])
                    if len(seen) > FLUSH:
                        yield pa.RecordBatch.from_pydict({"token": list(seen), "freq": list(seen.values())})
                        seen = Counter()
        if seen:
            yield pa.RecordBatch.from_pydict({"token": list(seen), "freq": list(seen.values())})

    def pieces(batches):
        count = ByteLevelVocabulary(source.value).counter()
        for batch in batches:
            n = pa.array(count(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["token", "freq", "pieces"])

    seen = docs.select(text_col).mapInArrow(frequencies, "token string, freq long")
    distinct = seen.groupBy("token").agg(F.sum("freq").alias("freq"))
    return distinct.mapInArrow(pieces, "token string, freq long, pieces int")


def token_counts(docs: DataFrame, tokenizer_file: str, head: int = 1_000_000, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens`` as the library counts them.

    Special strings inside a text count as one token each, the library's
    default; nothing is added, cut off or padded. Null and empty texts have no
    bytes and no tokens. Rows that repeat an id stay rows of their own; other
    columns are ignored; empty input gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        vocabulary = ByteLevelVocabulary(f.read())
    known = staged(pretoken_pieces(docs, vocabulary, text_col), "pretoken-pieces")
    total = known.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    top = known.filter(F.col("freq") * head >= total).select("token", "pieces").collect()
    sent = spark.sparkContext.broadcast((vocabulary.source, {r.token: r.pieces for r in top}))

    def sums(batches):
        source, head = sent.value
        split = ByteLevelVocabulary(source).splitter()
        for batch in batches:
            n_head, tokens, freqs = [], [], []
            for text in batch.column("text"):
                special, found = split(text.as_py() or "")
                own, rest, n = Counter(found), {}, special
                for t, k in own.items():
                    p = head.get(t)
                    if p is None:
                        rest[t] = k
                    else:
                        n += k * p
                n_head.append(n)
                tokens.append(list(rest))
                freqs.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n_head, pa.int64()),
                 pa.array(tokens, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int64()))],
                ["id", "n_bytes", "n_head", "tokens", "freqs"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("text"))
    per_doc = staged(rows.mapInArrow(sums, f"id {kind}, n_bytes long, n_head long, tokens array<string>, freqs array<long>")
                     .withColumn("row", F.monotonically_increasing_id()), "document-pretokens")
    tail = per_doc.select("row", F.explode(F.arrays_zip("tokens", "freqs")).alias("p")).select(
        "row", F.col("p.tokens").alias("token"), F.col("p.freqs").alias("k"))
    summed = (tail.join(known.select("token", "pieces"), "token")
              .groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("n_tail")))
    return per_doc.select("row", "id", "n_bytes", "n_head").join(summed, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_tokens"))
