"""The sampler's sorts and look-ups against plain numpy; the near stage numbers its rows without their texts; collocations of frequent pairs."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import collocations, lattice
from ledgerline.llm.queries import tokenizer_file


def test_ordered_is_a_stable_order():
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 9, 1000), rng.integers(0, 1 << 40, 1000), rng.integers(1 << 60, 1 << 62, 50), np.zeros(0, np.int64)):
        assert (lattice._ordered(keys) == np.argsort(keys, kind="stable")).all()


def test_every_piece_is_found():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        p = lattice.load_pieces(f.read())
    lat = lattice.Lattice(p)
    ids = np.flatnonzero((p.size > 0) & (p.weight != lattice.BYTE_WEIGHT))
    size = p.size[ids]
    base = np.cumsum(size) - size
    data = np.concatenate([p.data[p.start[i]:p.start[i] + p.size[i]] for i in ids])
    frm, to, found = lat.arcs(data, base, size)
    held = {}
    for a, b, i in zip(frm.tolist(), to.tolist(), found.tolist()):
        held.setdefault((a, b), set()).add(i)
    text = {i: p.data[p.start[i]:p.start[i] + p.size[i]].tobytes() for i in ids.tolist()}
    assert all(text[i] in {text.get(x) for x in held[b, b + s]} for i, b, s in zip(ids.tolist(), base.tolist(), size.tolist()))
    assert lat.deep >= 1 and len(lat.first) == 1 << 20


def test_near_stage_numbers_rows_without_texts(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"])), (3, "quite another text of a few words"),
            (3, "a second text under one id"), (None, "a text without an id"), (3, "quite another text of a few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    numbered, plain = [], corpus_pipeline.allocate_ids
    monkeypatch.setattr(corpus_pipeline, "allocate_ids", lambda df, *a: numbered.append(df.columns) or plain(df, *a))
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert kept == sorted((-1 if i is None else i, t) for i, t in rows if i != 2)
    assert numbered == [["id", "sha"]]


def test_collocation_edges_hold_frequent_pairs_only(spark):
    lines = [("a b c d. e f", "en")] * 3 + [("a b x c d e f a", "en"), ("b c y", None), (None, "en")]
    docs = spark.createDataFrame(lines, "text string, lang string")
    words = {(r.lang, r.word): r for r in collocations.word_counts(docs).collect()}
    assert {k: r.n for k, r in words.items()} == {("en", "a"): 5, **{("en", w): 4 for w in "bcdef"}, ("en", "x"): 1, **{("und", w): 1 for w in "bcy"}}
    head = np.array([words["en", w].key for w in "abcdef"])
    pairs = collocations.numbered_pairs(docs, head).filter("f >= 3")
    number = {w: i for i, w in enumerate("abcdef", 1)}
    two = lambda v, w: number[v] << 32 | number.get(w, 0)
    assert {tuple(r) for r in pairs.collect()} == {(two("a", "b"), 4), (two("b", "c"), 3), (two("c", "d"), 4), (two("e", "f"), 4)}
    edges = collocations.numbered_edges(docs, head, collocations.pair_table(pairs))
    assert {tuple(r) for r in edges.groupBy("a", "b").sum("f").collect()} == {(two("a", "b"), two("c", "d"), 3), (two("b", "c"), two("d", ""), 3)}


@pytest.mark.parametrize("bits", [5, 27])
def test_collocations_do_not_depend_on_the_pair_table(spark, monkeypatch, bits):
    monkeypatch.setattr(collocations, "TABLE_BITS", bits)
    monkeypatch.setattr(collocations, "COUNTED", 5)
    lines = [(" ".join("abcdefgh"[(i * k) % 8] for k in range(12)), "en") for i in range(8)] * 2
    got = collocations.frequent_phrases(spark.createDataFrame(lines, "text string, lang string"), min_count=3)[0]
    f = Counter(tuple(t.split()[i:i + m]) for t, _ in lines for m in range(1, 5) for i in range(13 - m))
    assert {(r.p, r.f, r.m) for r in got.collect()} == {(" ".join(p), n, len(p)) for p, n in f.items() if n >= 3}
