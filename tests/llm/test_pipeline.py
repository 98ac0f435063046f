"""The pipeline on planted documents, stage by stage and through run(), against plain Python; long and odd personal data."""

import random
import re
import string

import numpy as np

from ledgerline.llm import exact_dedup, language_id, lattice, pii
from ledgerline.llm.queries import tokenizer_file

LETTERS = "abcdefghilmnorstu"


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def _hit(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    hit = set()
    for item in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower())
        k = min(13, len(b))
        windows = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if k else set()
        hit |= {p for i in range(len(words) - k + 1) if tuple(words[i:i + k]) in windows for p in range(i, i + k)}
    return bool(hit) and 20 * len(hit) >= len(words)


def _expected(docs, items):
    one = {(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)}
    last = {}
    for i, t in one:
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    two = {(i, t) for i, t in one if (-1 if i is None else i) == last[t]}
    rows = sorted(two, key=lambda r: (-1 if r[0] is None else r[0], __import__("hashlib").sha256(r[1].encode()).hexdigest()))
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    three = {r for k, r in enumerate(rows) if root[k] == k}
    four = {(i, t) for i, t in three if not _hit(t, items)}
    return [one, two, three, four]


def test_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list(LETTERS), 5)) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [text(30), text(6)]
    docs = [(i, text(80)) for i in range(30)]
    docs += [(100 + i, docs[i][1]) for i in range(8)]  # copies
    docs += [(200 + i, docs[i + 10][1] + " " + text(6)) for i in range(8)]  # extended
    docs += [(300 + i, text(2) + " " + docs[i + 20][1].replace(" ", "  ")) for i in range(5)]
    docs += [(400 + i, text(20) + " " + items[0] + " " + text(20)) for i in range(4)] + [(410, text(40) + " " + items[1] + " " + text(400)), (411, items[1])]
    docs += [(500, None), (501, ""), (502, "123 456 ..."), (503, " \t ")]
    docs += [(None, text(50)), (None, docs[3][1]), (None, text(9) + " " + items[0]), (None, docs[12][1] + " end")]
    docs += [(600, text(40)), (600, text(10) + " " + items[0]), (600, docs[5][1]), (601, text(30)), (601, docs[600 % 30][1] + " tail"), docs[1], docs[12]]
    extra = "_text string, _ok string, _seed string, _id string, _s string, _hash string, sha string, key string, _part string, ids string"
    frame = spark.createDataFrame([(i, t, ["en", "fr"][k % 2], "s", 1, *["x"] * 10) for k, (i, t) in enumerate(docs)],
                                  f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, d = _expected(docs, items), spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(P.STAGES[:4]):
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert d.columns == frame.columns
        assert {(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()} == want[k], name
    out = P.run(spark, str(tmp_path)).select("doc_id", "lossless").collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in d.collect()) and all(r.lossless for r in out)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "en", "a", "b", "c", "d", "e") for i, t in enumerate(["one two", "one two", None, "x"])],
                                 "doc_id long, text string, lang string, _text string, _OK string, _seed string, _id string, _s string")
    assert language_id.identify(docs, language_id.learn(docs)).count() == 4
    assert lattice.sample_encode(docs, tokenizer_file("piece_bpe_32k.model")).count() == 4
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def test_long_and_odd_personal_data():
    random.seed(5)
    blob = "".join(random.choices(string.ascii_letters + string.digits, k=1 << 20))
    for text, n in ((blob, 0), ("q" * 300 + "@mail.example", 1), (blob[:200_000] + "@mail.example " + "Q1" * 40 + "@a.bc", 2), ("a@" * 40_000, 0)):
        new, spans = pii.Pseudonyms(b"k").apply(text)
        assert len(spans) == n and len(new) == len(text) and (new != text) == bool(n)
        assert pii.Pseudonyms(b"k", -1).apply(new)[0] == text
    two = [pii.Pseudonyms(b"k").apply(t)[0] for t in ("see " + "ab1" * 50 + "@x.org", "AB1" * 50 + "@y.net")]
    assert two[0][4:].split("@")[0] == two[1].split("@")[0].lower()
    for text in ("..john@x.com", "+1 555 1234567@x.com", "4111 1111 1111 1111@x.com", "12@x.io,13@y.io"):
        new, spans = pii.Pseudonyms(b"k").apply(text)
        assert spans and pii.Pseudonyms(b"k", -1).apply(new)[0] == text
