"""The ten operators against brute force on small tables with nulls, empty, long, repeated and odd rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import components, exact_dedup, importance, language_id, lattice, ngram_join, pii, sharding, substring_dedup
from ledgerline.llm import decontaminate, token_counts
from ledgerline.llm.queries import tokenizer_file

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, shard string, row string"


def _vocabulary(n):
    return ["".join(c) for c in itertools.islice(itertools.product("abcdeghilmnorstu", repeat=4), n)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    words = _vocabulary(400)
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    texts = [None, "", "   ", "word", "two words", "Ünï ▁ cödé\n\n tabs\t\tand  blanks ", "7 %% 9", "a\x00b c",
             "x " * 3000, "y" * 9000, base[0], base[0], base[1] + " " + base[2]]
    for b in base:
        texts.append(b)
        for _ in range(4):  # near copies: one word in twenty, or one in sixty, replaced
            w = b.split(" ")
            for i in rng.choice(len(w), int(rng.integers(1, 6)), replace=False):
                w[i] = str(rng.choice(words))
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(words, 30))
    texts += [" ".join(rng.choice(words, 25)) + " " + passage + " " + " ".join(rng.choice(words, 10)) for _ in range(15)]
    out = [(i, t, "en", "s", 1, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return out + [(None, base[3], None, None, None, None, None, None, None), out[20]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(docs, rows, none):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", []).append(i)
    want = {(i, max((x for x in by_text[t or ""] if x is not None), default=None), len(by_text[t or ""]),
             hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows}
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.select("text").distinct().count() == len(by_text)  # null counts as ""
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_drop_exact_duplicates_decides_by_id_and_text(spark):
    rows = [(5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "C"), (None, "D"), (1, "D"), (3, None), (4, ""), (4, "E")]
    left = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in left} == {(5, "B"), (9, "A"), (None, "C"), (1, "D"), (4, ""), (4, "E")} and len(left) == 6


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination(spark, docs, rows, none, limit):
    items = [(1, rows[13][1][:300].upper()), (1, "dup id"), (2, "two words"), (None, rows[14][1]), (3, ""), (4, None), (5, "%% !!"), (6, rows[10][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, limit=limit).collect() if r.doc_id is not None}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [(i, w[k:k + n]) for i, t in items for w in [lower(t)] if w for n in [min(13, len(w))] for k in range(len(w) - n + 1)]
    for i, t, *_ in rows:
        if i is None:
            continue
        w, hit, found = lower(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(item)} if item is not None else set()
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found)), i
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.contamination(none, bench, limit=limit).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_runs_no_python(docs):
    plan = decontaminate.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_substring_dedup(docs, rows, none, monkeypatch):
    got = {}
    for r in substring_dedup.remove_repeats(docs).collect():
        got[r.doc_id] = r
    order = [(-1 if i is None else i, t) for i, t, *_ in rows]
    words = {i: BLANK_WORDS.findall(t or "") for i, t in order}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][s:s + 20]), (i, s))
    for i, w in words.items():
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] < (i, s) for p in range(s, s + 20)}
        r = got[None if i < 0 else i]
        assert (r.n_words, r.n_removed, r.text) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)), i
    assert substring_dedup.remove_repeats(none).count() == 0


def test_fm_index_counts_and_statistics():
    from ledgerline.llm.fm_index import FMIndex

    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, 60), 0) for _ in range(6)])
    index = FMIndex(text)
    ends = np.flatnonzero(text > 0)
    length, lo, hi = index.matching_statistics(ends, 8)
    flat = [tuple(text[max(0, e - k + 1):e + 1]) for e in ends for k in (8,)]
    for e, n, a, b in zip(ends, length, lo, hi):
        def times(k):
            p = text[e - k + 1:e + 1]
            return 0 if k > e + 1 or (p == 0).any() else sum((text[s:s + k] == p).all() for s in range(len(text) - k + 1))
        assert n == max(k for k in range(9) if k == 0 or times(k) > 1)
        if n == 8:
            assert b - a == times(8)
    assert len(flat) == len(ends)


def test_jaccard_components(docs, rows, none):
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs).collect()}
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t, *_ in rows:
        w = BLANK_WORDS.findall((t or "").translate(fold))
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    key = lambda i: -1 if i is None else i
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in itertools.combinations(sorted(sets, key=key), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)), key=key)
            up[y] = x
    assert {i: (len(s), root(i)) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id) for i, r in got.items()}
    assert len({root(i) for i in sets}) < len(sets) - 10
    assert ngram_join.jaccard_components(none).count() == 0


def _shingles(text, n=4):
    w = BLANK_WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def _linked(one, two):
    return 100 * len(one & two) >= 85 * len(one | two)


def test_jaccard_components_of_longer_and_shorter_copies(spark):
    rng = np.random.default_rng(11)
    words = _vocabulary(3000)
    fresh = lambda n: list(rng.choice(words, n))
    texts = []
    for percent in range(3, 18):
        for size in (60, 103, 240):
            more = max(1, size * percent // 100)
            for change in (lambda w: w + fresh(more), lambda w: w[:-more], lambda w: fresh(more) + w):
                base = fresh(size)
                texts += [" ".join(base), " ".join(change(base))]  # groups of exactly two
    sets = [_shingles(t) for t in texts]
    want = {i: i - 1 if i % 2 and _linked(sets[i - 1], sets[i]) else i for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert sum(i != c for i, c in want.items()) > 80
    assert got == want, f"{sum(got[i] != c for i, c in want.items())} of {sum(i != c for i, c in want.items())} links are wrong"


def test_jaccard_pairs_lists_every_link(docs, rows, none):
    reps = {}
    for i, t, *_ in rows:
        i = substring_dedup.NO_ID if i is None else i
        reps.setdefault(frozenset(_shingles(t)), []).append(i)
    reps.pop(frozenset())
    sets = {min(ids): (s, len(ids)) for s, ids in reps.items()}
    want = {(a, b, len(sets[a][0] & sets[b][0])) for a, b in itertools.combinations(sorted(sets), 2) if _linked(sets[a][0], sets[b][0])}
    links, counts = ngram_join.jaccard_pairs(docs)
    got = [(r.a, r.b, r.overlap) for r in links.collect()]
    assert len(got) == len(want) and set(got) == want
    connecting = ngram_join.jaccard_links(docs.select(F.col("doc_id").alias("id"), "text").filter("id IS NOT NULL"))[2].count()
    assert len(want) > connecting  # more than connect the components
    ends = [x for a, b, _ in want for x in (a, b)]
    assert sorted((r.rep, r.members, r.n_links) for r in counts.collect()) == sorted((i, m, ends.count(i)) for i, (_, m) in sets.items())
    assert all(x.count() == 0 for x in ngram_join.jaccard_pairs(none))


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 50)] + [(7, 7), (200, 300), (300, 200)]
    got = dict(components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 50)}, 200: 200, 300: 200}


def test_token_counts(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(900, "a<|endoftext|> b'll it’s  x\r\n\n  42½ <|endoftext|>"), (901, "日本語 текст   y")], "doc_id long, text string")
    got = token_counts.token_counts(docs.select("doc_id", "text").union(odd), path).collect()
    text = {i: t for i, t, *_ in rows} | dict(odd.collect())
    assert len(got) == len(rows) + 2
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)), r.doc_id
    few = token_counts.token_counts(docs, path, head=3).select("doc_id", "n_tokens")  # nearly all by the shuffle join
    assert sorted(few.collect(), key=str) == sorted(((r.doc_id, r.n_tokens) for r in got if r.doc_id not in (900, 901)), key=str)
    assert token_counts.token_counts(none, path).count() == 0


def test_sampled_segmentation_is_lossless_and_reproducible(docs, rows, none):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    one = {r.doc_id: (r.text, r.ids, r.decoded) for r in lattice.decode(lattice.sample_encode(docs, path), path).collect()}
    two = {r.doc_id: r.ids for r in lattice.sample_encode(docs.repartition(2), path).collect()}
    other = {r.doc_id: r.ids for r in lattice.sample_encode(docs, path, seed=2).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, (text, ids, decoded) in one.items():
        assert decoded == text and ids == two[i] and (ids is None) == (text is None)
        assert all(0 <= x < sp.get_piece_size() for x in ids or [])
    assert one[20][1] != other[20]
    assert lattice.sample_encode(none, path).count() == 0


def test_sampler_follows_the_weights():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        p = lattice.load_pieces(f.read(), alpha=0.3)
    text = b"the"
    n = 40_000
    ids, sizes = lattice.Lattice(p).sample(np.frombuffer(text * n, np.uint8), np.arange(n + 1) * 3, np.arange(n, dtype=np.uint64))
    seen, at = {}, 0
    for s in sizes:
        path = tuple(ids[at:at + s])
        seen[path] = seen.get(path, 0) + 1
        at += s
    weight = {bytes(p.data[p.start[i]:p.start[i] + p.size[i]]): p.weight[i] for i in range(len(p.size)) if p.size[i] and p.weight[i] != lattice.BYTE_WEIGHT}
    paths = {}
    for cuts in range(4):
        parts = [text[a:b] for a, b in itertools.pairwise([0, *[k + 1 for k in range(2) if cuts >> k & 1], 3])]
        if all(x in weight for x in parts):
            paths[len(parts), parts[0]] = np.exp(sum(weight[x] for x in parts))
    total = sum(paths.values())
    best = max(seen.values()) / n
    assert abs(best - max(paths.values()) / total) < 0.02


def test_long_runs_are_split_only_where_no_piece_reaches_across():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        lat = lattice.Lattice(lattice.load_pieces(f.read()))
    rng = np.random.default_rng(5)
    letters = "".join(rng.choice(list("aeinorst"), 3 * lattice.LONGEST))
    signs = "".join(rng.choice(list("的一是不了人我在有他这中大来上国"), 2 * lattice.LONGEST))
    for text in (letters, signs, "y" * 9000, "the " * 9 + letters):
        data = np.frombuffer(text.encode(), np.uint8)
        n = len(data)
        frm, to, _ = lat.arcs(data, np.array([0]), np.array([n]))  # the lattice of the whole text
        start, size = lat.chunks(data, np.array([0, n]))
        assert start[0] == 0 and (start[1:] == (start + size)[:-1]).all() and start[-1] + size[-1] == n
        inside = [(a, b) for a, b in zip(frm.tolist(), to.tolist()) if b - a > 1 and not text.encode()[a:b].strip() == b""]
        ends = np.searchsorted(start, [b - 1 for _, b in inside], "right")
        assert (np.searchsorted(start, [a for a, _ in inside], "right") == ends).all()
        ids, count = lat.sample(data, np.array([0, n]), np.array([3], np.uint64))
        assert b"".join(bytes(lat.p.data[lat.p.start[i]:lat.p.start[i] + lat.p.size[i]]) for i in ids) == text.encode() and count[0] == len(ids)


def test_pseudonyms(spark, none):
    texts = ["card 4785380592391139, again 4785 3805 9239 1139 and 4785380592391138", "on 2024-02-29, 29.02.2024 or 02/29/2024 not 2023-02-29",
             "ip 97.51.17.173 and 999.1.1.1; ssn 123-45-6789, 000-12-3456", "+1 (017) 555-7713 joe.Doe7@mail.example.com GB82 WEST 1234 5698 7654 32",
             None, "", "no values 12 here", "97.51.17.173 " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, b"k").collect()}
    back = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame([(i, r.text) for i, r in out.items()], "doc_id long, text string"), b"k", way=-1).collect()}
    assert back == dict(enumerate(texts))
    kinds = {i: [s.kind for s in r.spans] for i, r in out.items()}
    assert kinds[0] == ["card", "card"] and kinds[1] == ["iso", "dotted", "slashed"] and kinds[2] == ["ip", "ssn"]
    assert kinds[3] == ["phone", "email", "iban"] and not kinds[4] and not kinds[5] and not kinds[6] and len(kinds[7]) == 2000
    new = re.findall(r"\d{16}", out[0].text.replace(" ", ""))
    assert new[0] == new[1] != "4785380592391139" and pii.luhn_digit(new[0][:-1]) == new[0][-1] and new[2] == "4785380592391138"
    days = re.match(r"on (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4}) or (\d\d)/(\d\d)/(\d{4}) not 2023-02-29", out[1].text).groups()
    assert days[:3] == (days[5], days[4], days[3]) == (days[8], days[6], days[7])
    assert out[7].text.split()[0] == out[2].text.split()[1] and len(out[2].text.split(";")) == 2
    for n in (1, 2, 10, 97, 1000):
        assert sorted(pii.Feistel(b"k", "t", n).hide(x) for x in range(n)) == list(range(n))
    assert pii.pseudonymise(none, b"k").count() == 0


def test_balanced_shards(spark, docs, rows, none):
    got = sharding.balanced_shards(docs, shards=4).collect()
    assert len(got) == len(rows)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 4) < 1
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())  # every group fits
    big = spark.range(900).select("id", F.when(F.col("id") < 400, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.balanced_shards(big, 8, id_col="id").filter(f"text_crc32 = {__import__('zlib').crc32(b'same')}")
    assert out.select("shard").distinct().count() <= 5  # 400 rows need four shards of 112 or 113
    assert sharding.balanced_shards(none).count() == 0


def test_balanced_shards_of_a_group_with_half_of_all_rows(spark):
    big = spark.range(3200).select("id", F.when(F.col("id") < 1600, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.balanced_shards(big, id_col="id").collect()
    same = __import__("zlib").crc32(b"same")
    assert len({r.shard for r in out if r.text_crc32 == same}) <= 10  # eight shards of 200, each filled to a twentieth first
    assert [sum(r.shard == s for r in out) for s in range(16)] == [200] * 16


def test_language_id(spark, none):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 !! 34", "de"), (None, "the and of that", None)], "doc_id long, text string, lang string")
    got = language_id.language_id(sf.select("doc_id", "text", "lang").union(odd)).toPandas()
    assert set(got[got.doc_id < 0].lang_pred) == {"und"} and got.score.between(0, 1).all()
    truth = got.merge(sf.select("doc_id", "lang").toPandas())
    held = truth[truth.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    assert language_id.language_id(none).count() == 0


def test_importance_resampling(docs, rows, none):
    target = docs.filter("doc_id between 10 and 40")
    got = importance.importance_sample(docs, target, 0.5).collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    assert sum(r.kept for r in got) == -(-len(rows) // 2)
    keys = [r.sample_key for r in sorted(got, key=lambda r: r["rank"])]
    assert keys == sorted(keys, reverse=True)
    blank = [r for r in got if r.doc_id in (0, 1, 2)]
    assert all(r.log_weight == 0 and r.n_grams == 0 for r in blank)
    again = importance.importance_sample(docs.repartition(3), target, 0.5).collect()
    assert {(r.doc_id, r.sample_key) for r in got} == {(r.doc_id, r.sample_key) for r in again}
    assert importance.importance_sample(none, target, 0.5).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, d, sf)
        if i < 4:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / str(i)))
        before, d = d, spark.read.parquet(str(tmp_path / str(i)))
        assert d.count() <= before.count()
    assert d.count() > 100 and d.filter("not lossless").count() == 0
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0
