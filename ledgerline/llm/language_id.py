"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import kernels as K
from ledgerline.llm.common import arrow_batches, fresh

#: Families of common language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "mk", "pl", "cs", "sk", "sl", "hr", "bs"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am", "mt"),
}
BUCKETS = 4096
UNDETERMINED = "und"

#: Letters of all alphabets stay, A-Z become a-z, every other ASCII byte is a blank.
_CLEAN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of the byte trigrams of each row that do not have a blank in the middle."""
    if len(data) < 3:
        z = np.zeros(0, np.int64)
        return z, z
    b = _CLEAN[data]
    # capitals of the Latin-1 letters: C3 80..9E, except the multiplication sign
    b[1:] += np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97), 32, 0).astype(np.uint8)
    code = (b[:-2].astype(np.uint32) << 16) | (b[1:-1].astype(np.uint32) << 8) | b[2:]
    ok = b[1:-1] != 32
    for edge in (off[1:-1] - 1, off[1:-1] - 2):  # trigrams that span two rows
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    at = np.flatnonzero(ok)
    return at, ((code[at] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


class Model(NamedTuple):
    languages: list[str]
    families: list[str]
    member: list[list[int]]          # languages of each family
    pairs: list[tuple[int, int]]     # one-versus-one, inside a family
    weight: np.ndarray               # bucket x (families, then pairs)
    bias: np.ndarray


def _svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by accelerated gradient steps. Classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (1.0 + 2 * c * float((weight * ((x * x).sum(1) + 1)).sum()))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    for t in range(steps):
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
        pw, pb = w, b
        w, b = vw - rate * (vw - 2 * c * (slack @ x)), vb + rate * 2 * c * float(slack.sum())
    return w, b


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Model of (language, buckets, counts) rows: one family classifier per family, one SVM per pair inside it."""
    languages = sorted({s[0] for s in sample})
    family_of = {code: f for f, codes in FAMILIES.items() for code in codes}
    families = sorted({family_of.get(c, c) for c in languages})
    member = [[i for i, c in enumerate(languages) if family_of.get(c, c) == f] for f in families]
    pairs = [p for m in member for p in combinations(m, 2)]
    n_out = len(families) + len(pairs)
    weight, bias = np.zeros((BUCKETS, n_out)), np.zeros(n_out)
    if n_out > 1:
        x = np.zeros((len(sample), BUCKETS), np.float32)
        for i, (_, at, n) in enumerate(sample):
            x[i, at] = n / max(1, n.sum())
        mean, scale = x.mean(0), 1 / (x.std(0) + 1e-3) / np.sqrt(BUCKETS)
        x = (x - mean) * scale
        lang = np.array([languages.index(s[0]) for s in sample])
        home = np.array([next(f for f, m in enumerate(member) if i in m) for i in lang])
        tasks = [(np.ones(len(sample), bool), home == f) for f in range(len(families)) if len(families) > 1]
        tasks += [((lang == a) | (lang == b), lang == a) for a, b in pairs]
        shift = n_out - len(tasks)  # a lone family needs no classifier
        for k, (use, first) in enumerate(tasks, shift):
            w, b = _svm(x[use], np.where(first[use], 1, -1).astype(np.float32))
            weight[:, k], bias[k] = w * scale, b - float((w * scale) @ mean)
    return Model(languages, families, member, pairs, weight, bias)


def predict(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score in 0..1) of each row."""
    at, bucket = _trigrams(data, off)
    cut = np.searchsorted(at, off)
    n = np.maximum(1, np.diff(cut))
    margin = np.empty((len(off) - 1, len(model.bias)))
    for k in range(len(model.bias)):
        run = np.concatenate([[0.0], np.cumsum(model.weight[bucket, k])])
        margin[:, k] = (run[cut[1:]] - run[cut[:-1]]) / n + model.bias[k]
    n_f = len(model.families)
    sure = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
    family = margin[:, :n_f].argmax(1)
    votes = np.zeros((len(margin), len(model.languages)))
    low = np.ones(len(votes))
    for k, (a, b) in enumerate(model.pairs, n_f):
        votes[:, a] += (margin[:, k] >= 0) + 1e-3 * sure[:, k]
        votes[:, b] += (margin[:, k] < 0) + 1e-3 * (1 - sure[:, k])
    inside = np.zeros(votes.shape, bool)
    for f, m in enumerate(model.member):
        inside[np.ix_(family == f, m)] = True
    best = np.where(inside, votes, -1).argmax(1)
    for k, (a, b) in enumerate(model.pairs, n_f):
        low = np.where(best == a, np.minimum(low, sure[:, k]), np.where(best == b, np.minimum(low, 1 - sure[:, k]), low))
    top = sure[np.arange(len(sure)), family] if n_f > 1 else np.ones(len(sure))
    return best, np.clip(top * low, 0, 1)


def _held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def learn(docs: DataFrame, per_language: int = 800, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample: at most ``per_language`` whole texts per language, picked by a hash of the id.

    Only rows with a language and a letter whose crc32(id) mod 3 is not 1 are learned from.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.filter(~_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in docs.filter(~_held_out(id_col) & F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    draw = (F.xxhash64(F.lit("language"), id_col).bitwiseAND((1 << 40) - 1)).cast("long")
    wide = F.lit(False)
    for code, n in sizes.items():  # one short condition per language; a third more than wanted, cut to the bound below
        wide = wide | ((F.col(lang_col) == code) & (F.lit(draw) < int(min(1.0, 1.33 * per_language / n + 16 / n) * (1 << 40))))

    def counts(batches):
        for batch in batches:
            data, off = K.text_bytes(batch.column("text"))
            at, n = [], []
            for i in range(len(batch)):
                _, b = _trigrams(data[off[i]:off[i + 1]], off[i:i + 2] - off[i])
                total = np.bincount(b, minlength=BUCKETS)
                some = np.flatnonzero(total)
                at.append(some.astype(np.uint16).tobytes())
                n.append(total[some].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                                             ["lang", "draw", "at", "n"])

    got = (rows.filter(wide).select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
           .mapInArrow(counts, "lang string, draw long, at binary, n binary").collect())
    sample, taken = [], {}
    for r in sorted(got, key=lambda r: (r.lang, r.draw, bytes(r.at), bytes(r.n))):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= per_language:
            sample.append((r.lang, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.n, np.uint32)))
    return fit(sample) if sample else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (the columns ``keep``; default all) with ``lang_pred`` and ``score``.

    The whole text decides: byte trigrams give the family, and the SVMs of that
    family's language pairs vote. ``score`` is the product of the family's and
    the weakest pair's logistic margin. A text that is null or has no letter is
    ``und`` with score 0, as is every text when nothing could be learned.
    Columns of ``docs`` named like the results are replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = spark.sparkContext.broadcast(model)
    text, ok_col = fresh(docs, "_text", "_ok")
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def label(batches):
        m = sent.value
        for batch in batches:
            n = len(batch)
            lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            if m is not None:
                data, off = K.text_bytes(batch.column(text))
                ok = batch.column(ok_col).to_numpy(zero_copy_only=False)
                for lo, hi in K.slices(off):
                    best, s = predict(m, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                    lang[lo:hi] = np.where(ok[lo:hi], np.array(m.languages, object)[best], UNDETERMINED)
                    score[lo:hi] = np.where(ok[lo:hi], s, 0.0)
            cols = [batch.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text_col).alias(text), lettered.alias(ok_col))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(label, schema)


def language_id(docs: DataFrame, per_language: int = 800, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """id, ``held_out`` (crc32(id) mod 3 is 1; a null id counts as ""), ``lang_pred``, ``score`` for every row.

    Rows that repeat stay and get equal results; empty input gives no rows; other columns are ignored.
    """
    model = learn(docs, per_language, id_col, text_col, lang_col)
    out = identify(docs.select(id_col, text_col), model, text_col, [id_col])
    return out.select(id_col, _held_out(id_col).alias("held_out"), "lang_pred", "score")
