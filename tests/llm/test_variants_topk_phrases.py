"""Spelling variants, exact top-k search and collocations against plain Python on small hard tables."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import collocations as C
from ledgerline.llm import kernels as K
from ledgerline.llm import spelling, topk_search

SCHEMA = "doc_id long, text string, lang string, word string, p string, id string, n string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(5, 9))) for _ in range(60)]
    odd = [w[:2] + w[3:] for w in base[:20]] + [w[:3] + "x" + w[3:] for w in base[20:40]] + [w[:1] + "Ü" + w[2:] for w in base[40:]]
    rows = [(None, " ".join(base[:9]), None), (1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, "z" * 70_000 + " ab", "en"),
            (5, "Abcdef! abcdef;abcdef\nABCDEF  abcdef×ghij, É", "fr"), (6, "one two three four five. one two three four five", "en")]
    for i in range(7, 260):
        pick = list(rng.choice(base, 30)) + list(rng.choice(odd, 6)) + ["big", "deal", "indeed", "today"] * int(rng.integers(0, 3))
        rows.append((i, " ".join(w + ("," if rng.random() < .1 else "") for w in pick), ["en", "fr", None][i % 3]))
    rows += [rows[20]] * 3
    return [r + ("clash",) * 4 for r in rows]


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows, rare):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % rare == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) <= 1 and _near(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = (form[w], n[w], len(near), n[best] if form[w] else None)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, f, root(w), c, k, fn) for w, (f, c, k, fn) in out.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_spelling(spark, texts, block):
    docs = spark.createDataFrame(texts, SCHEMA).repartition(5)
    got = {tuple(r) for r in spelling.spelling_groups(docs, rare=7, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = _variants(texts, 7)
    assert got == want and any(r[1] for r in want)
    assert spelling.spelling_groups(docs.limit(0)).count() == 0


def test_spelling_cuts_long_texts(spark, monkeypatch, texts):
    monkeypatch.setattr(spelling.K, "BLOCK", 1 << 21)
    data, off = spelling.K.text_bytes(__import__("pyarrow").array([t[1] for t in texts]))
    parts = list(spelling._parts(data, off, 50))
    assert parts[0][1][0] == 0 and parts[-1][1][-1] == len(data)
    whole, cut = Counter(), Counter()
    ids = [t[0] for t in texts]
    for where, size in ((whole, 1 << 21), (cut, 50)):
        for lo, p in spelling._parts(data, off, size):
            for b in spelling._counted(data[p[0]:p[-1]], p - p[0], ids[lo:lo + len(p) - 1], 7, 6):
                where.update(dict(zip(*(c.to_pylist() for c in b.columns))))
    assert whole == cut


def _topk(rows, k, every):
    best = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            best[i] = min(best.get(i, w), w)
    out = set()
    for q in best:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(best[q], best[d])), d) for d in best if d != q)[:k]
            out |= {(q, r, d, -s) for r, (s, d) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("block, cell", [(7, 20), (16_384, 2_048)])
def test_topk(spark, block, cell):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * 4
    rows = [(i, (centre[i % 6] + rng.normal(size=8) * .2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # equal vectors: ties
    rows += [(420, None), (421, [1.0, None]), (422, [float("nan")] * 8), (423, [float("inf")] * 8), (None, [1.0] * 8),
             (430, []), (440, [1.5]), (450, [-0.001] * 8), (460, [3.0] * 12), rows[10], (20, [9.0] * 8)]
    data = spark.createDataFrame([r + ("x",) * 5 for r in rows], "vec_id long, embedding array<double>, id string, v string, cell string, dist string, block string")
    got = topk_search.exact_topk(data, F.expr("id % 10 = 0"), block=block, cell=cell)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == _topk(rows, 5, 10)
    assert topk_search.exact_topk(data.limit(0), F.expr("id % 10 = 0")).count() == 0
    assert topk_search.exact_topk(data.filter("vec_id = 30"), F.expr("id % 10 = 0")).count() == 0


def _phrases(rows, least, top):
    f, n = {}, Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + m])] += 1
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = set()
        for p, a in cand.items():
            for k in range(2, len(p)):
                held |= {p[i:i + k] for i in range(len(p) - k + 1) if 100 * a >= 80 * c[p[i:i + k]]}
        rows_ = []
        for p, a in cand.items():
            if p not in held:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for r, (s, a, p, x, y) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, r, p.decode(), -a, x, y, n[lang], -s))
    return out


@pytest.mark.parametrize("least, top, head, block", [(3, 2000, 1 << 20, 1 << 21), (2, 7, 1 << 20, 1 << 21), (3, 2000, 25, 60), (3, 2000, 0, 60)])
def test_collocations(spark, texts, least, top, head, block):
    docs = spark.createDataFrame(texts, SCHEMA)
    got = C.collocations(docs, top=top, min_count=least, head=head, block=block).drop("path", "step")
    assert {tuple(r) for r in got.collect()} == _phrases(texts, least, top)
    assert C.collocations(docs.limit(0)).count() == 0


def test_long_texts_are_cut_between_words():
    text = ("ab, c\td  e f" * 40 + " " + "x" * 300 + " y z ") * 3
    docs = pa.RecordBatch.from_arrays([pa.array(["en", None, "en"]).fill_null("und"), pa.array(["one two", text, ""])], ["lang", "t"])
    whole = [(len(w.start), to) for w, *_, to, _ in C._tokens(docs, 3, 1 << 21)]
    data, off = K.text_bytes(docs.column(1))
    for size in (7, 50, 1000):
        parts = list(C._parts(data, off, size, 3))
        assert b"".join(p[:to].tobytes() for _, _, p, to in parts) == data.tobytes()
        assert len(parts) > 2 and all(len(p) - to < 1 << 11 for _, _, p, to in parts)
    assert whole[0][0] == whole[0][1]


def test_paths(spark):
    line = "a b c d e f g h"
    edges = C.graph_edges(spark.createDataFrame([(line + ". " + line, "en"), ("x b c d y", "en")], "text string, lang string")).filter("m = 4")
    got = {r.p: (r.path, r.step) for r in C.compact_paths(edges).collect()}
    assert got == {"a b c d": ("a b c d", 0), "b c d e": ("b c d e", 0), "c d e f": ("b c d e", 1), "d e f g": ("b c d e", 2),
                   "e f g h": ("b c d e", 3), "x b c d": ("x b c d", 0), "b c d y": ("b c d y", 0)}
