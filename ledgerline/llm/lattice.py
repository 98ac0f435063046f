"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The lattice runs over UTF-8 bytes, a blank standing for the vocabulary's word
mark. Its arcs are the pieces; byte pieces are arcs of one byte with a weight so
low that they serve only where no piece fits, and they make every text -- also
one that holds the word mark itself -- decodable to its exact bytes.

No piece goes past the start of a run of blanks, so texts fall apart into
independent chunks. Long chunks fall apart further between two bytes that no
piece found there spans; nothing is cut elsewhere, so the paths are those of the
whole text. A chunk takes one step per byte, however long it is. Forward sums are computed once per distinct chunk of a block
of texts; every occurrence draws its own path backwards, all at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ledgerline.llm import kernels as K
from ledgerline.llm.common import arrow_batches, fresh

MARK = "▁"
#: Log weight of a byte piece.
BYTE_WEIGHT = -30.0
#: Bytes of text sampled at once; the tables of such a block stay in the processor's caches.
SAMPLED = 1 << 19
#: A chunk of more bytes than this is split where no piece of the text reaches across, which changes no path.
LONGEST = 4096


def _ordered(key: np.ndarray) -> np.ndarray:
    """The stable order of keys of at least 0: a sort of plain numbers, each with its place in the lower bits."""
    bits = int(len(key)).bit_length()
    if not len(key) or int(key.max()) >> (62 - bits):
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


class Pieces(NamedTuple):
    data: np.ndarray      # bytes of all pieces, one behind the other
    start: np.ndarray     # of each id; control pieces are empty
    size: np.ndarray
    weight: np.ndarray    # log weight
    byte_id: np.ndarray   # id of each of the 256 byte pieces
    solo: np.ndarray      # bytes that no piece of two or more bytes holds


def load_pieces(model: bytes, alpha: float = 1.0) -> Pieces:
    """Pieces of a model with byte fallback.

    Unigram scores are log probabilities and used as they are. The scores of a
    BPE model are merge ranks, not probabilities; there the weight is the Zipf
    law of the rank. ``alpha`` sharpens (> 1) or flattens (< 1) the draws.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    texts, weight, byte_id = [], np.zeros(n), np.full(256, -1, np.int64)
    scores = np.array([sp.get_score(i) for i in range(n)])
    ranks = bool(np.all(scores == np.round(scores)))
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[1:-1], 16)
            byte_id[value] = i
            texts.append(bytes([value]))
            weight[i] = BYTE_WEIGHT
            continue
        plain = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        texts.append(sp.id_to_piece(i).replace(MARK, " ").encode() if plain else b"")
        weight[i] = alpha * (-np.log(2.7 - scores[i]) if ranks else scores[i])
        if b" " in texts[-1].lstrip(b" "):
            raise ValueError("a piece crosses the start of a word")
    if (byte_id < 0).any():
        raise ValueError("the model has no byte fallback; decoding would lose text")
    size = np.array([len(t) for t in texts])
    solo = np.ones(256, bool)
    solo[list({b for t in texts if len(t) > 1 for b in t})] = False
    return Pieces(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, weight, byte_id, solo)


class Lattice:
    """Piece look-up by hash and the sampler."""

    def __init__(self, pieces: Pieces):
        self.p = p = pieces
        ids = np.flatnonzero((p.size > 0) & (p.weight != BYTE_WEIGHT))
        up, down = K._powers(len(p.data) + 1)
        run = np.concatenate([[K.U64(0)], np.cumsum((p.data.astype(K.U64) + K.U64(1)) * up[:len(p.data)])])
        h = K.mix((run[p.start[ids] + p.size[ids]] - run[p.start[ids]]) * down[p.start[ids]])
        order = np.argsort(h)
        self.hash, self.id = h[order], ids[order]
        # place of the first hash of every leading 20 bits, and the most hashes that share them
        held = np.bincount((h >> K.U64(44)).astype(np.int64), minlength=1 << 20)
        self.sieve, self.deep = held > 0, int(held.max())
        self.first = np.minimum(np.cumsum(held) - held, len(h) - 1).astype(np.int32)
        self.lengths = np.unique(p.size[ids])

    def chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and length of every chunk of the rows."""
        n = len(data)
        opens = np.zeros(n + 1, bool)
        opens[off] = True
        blank = data == 32
        opens[1:n] |= blank[1:] & ~blank[:-1]
        alone = self.p.solo[data]
        opens[:n] |= alone
        opens[1:] |= alone
        start = np.flatnonzero(opens[:n])
        size = np.diff(np.concatenate([start, [n]]))
        long = np.flatnonzero(size > LONGEST)
        if len(long):
            s, base = size[long], np.cumsum(size[long]) - size[long]
            at = np.repeat(start[long] - base, s) + np.arange(int(s.sum()))
            frm, to, _ = self.arcs(data[at], base, s)
            # bytes that an arc spans without starting at them
            span = np.bincount(frm + 1, minlength=len(at) + 2) - np.bincount(to, minlength=len(at) + 2)
            start = np.union1d(start, at[np.cumsum(span)[:len(at)] == 0])
            size = np.diff(np.concatenate([start, [n]]))
        return start, size

    def arcs(self, data: np.ndarray, base: np.ndarray, size: np.ndarray):
        """All arcs (from byte, to byte, id) inside chunks that lie one behind the other at ``base``."""
        n = len(data)
        up, down = K._powers(n + 1)
        run = np.concatenate([[K.U64(0)], np.cumsum((data.astype(K.U64) + K.U64(1)) * up[:n])])
        left = np.repeat(base + size, size) - np.arange(n)
        frm, to, ids = [np.arange(n)], [np.arange(1, n + 1)], [self.p.byte_id[data]]
        at = np.arange(n)
        for length in self.lengths:
            at = at[left[at] >= length]
            if not len(at):
                break
            h = K.mix((run[at + length] - run[at]) * down[at])
            lead = (h >> K.U64(44)).astype(np.int64)
            maybe = np.flatnonzero(self.sieve[lead])
            h, pos = h[maybe], self.first[lead[maybe]]
            for _ in range(self.deep - 1):
                pos = np.minimum(pos + (self.hash[pos] < h), len(self.hash) - 1)
            hit = (self.hash[pos] == h) & (self.p.size[self.id[pos]] == length)
            frm.append(at[maybe[hit]])
            to.append(at[maybe[hit]] + length)
            ids.append(self.id[pos[hit]])
        return np.concatenate(frm), np.concatenate(to), np.concatenate(ids)

    def sample(self, data: np.ndarray, off: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids per row); ``seed`` has one 64-bit value per row."""
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        start, size = self.chunks(data, off)
        up, down = K._powers(len(data) + 1)
        run = np.concatenate([[K.U64(0)], np.cumsum((data.astype(K.U64) + K.U64(1)) * up[:len(data)])])
        h = K.mix((run[start + size] - run[start]) * down[start] + size.astype(K.U64) * K.U64(K.BASE))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        # the distinct chunks, one behind the other
        usize = size[first]
        base = np.cumsum(usize) - usize
        total = int(usize.sum())
        text = data[np.repeat(start[first] - base, usize) + np.arange(total)]
        frm, to, ids = self.arcs(text, base, usize)
        # node k is "k bytes of its chunk are read"; chunk c has the nodes base[c] + c .. + usize[c]
        chunk = np.repeat(np.arange(len(usize)), usize)
        own = chunk[frm]
        frm, to = frm + own, to + own
        depth = to - (base + np.arange(len(base)))[own]
        alpha = np.zeros(total + len(usize))
        value = np.empty(len(frm))
        order = _ordered(depth * (len(alpha) + 1) + to)
        frm, to, ids, depth = frm[order], to[order], ids[order], depth[order]
        w = self.p.weight[ids]
        cut = np.searchsorted(depth, np.arange(1, depth[-1] + 2))
        for a, b in zip(cut[:-1], cut[1:]):  # forward filtering, one byte further each step
            v = alpha[frm[a:b]] + w[a:b]
            t = to[a:b]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            top = np.maximum.reduceat(v, head)
            k = np.diff(np.concatenate([head, [b - a]]))
            alpha[t[head]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, k)), head))
            value[a:b] = v
        order = _ordered(to)
        frm, to, ids = frm[order], to[order], ids[order].astype(np.int32)
        p = np.exp(value[order] - alpha[to])
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        k = np.diff(np.concatenate([head, [len(to)]]))
        run = np.cumsum(p)
        within = run - np.repeat(run[head] - p[head], k)
        within /= np.repeat(within[head + k - 1], k)
        rank = np.zeros(len(alpha), np.int64)
        rank[to[head]] = np.arange(len(head))
        ladder = np.repeat(np.arange(len(head)), k) + np.minimum(within, 1.0)
        leaps = [1 << i for i in reversed(range(int(k.max() - 1).bit_length()))]
        # backward sampling of every occurrence
        row = np.searchsorted(off, start, "right") - 1
        in_row = np.arange(len(start)) - np.searchsorted(row, row)
        draw = K.mix(seed[row] ^ (in_row.astype(K.U64) * K.U64(K.BASE)))
        node = (base + np.arange(len(base)) + usize)[which]
        stop = (base + np.arange(len(base)))[which]
        live, n, steps = np.arange(len(start)), np.zeros(len(start), np.int64), []
        while len(live):
            u = K.unit(K.mix(draw[live] + n[live].astype(K.U64) * K.U64(0xD1B54A32D192ED03)))
            at = rank[node]
            arc, last, u = head[at], head[at] + k[at] - 1, at + u
            for leap in leaps:  # the first arc of the node whose step of the ladder lies above the draw, or its last
                on = np.minimum(arc + leap, last)
                arc = np.where(ladder[on - 1] <= u, on, arc)
            steps.append((live, ids[arc]))
            n[live] += 1
            node = frm[arc]
            on = node != stop
            live, node, stop = live[on], node[on], stop[on]
        end = np.cumsum(n)
        out = np.empty(int(end[-1]), np.int32)
        for t, (occurrence, piece) in enumerate(steps):
            out[end[occurrence] - 1 - t] = piece
        return out, np.bincount(row, n, minlength=rows).astype(np.int64)


def decode_ids(p: Pieces, ids: np.ndarray) -> np.ndarray:
    """The bytes that the ids stand for."""
    size = p.size[ids]
    at = np.cumsum(size) - size
    return p.data[np.repeat(p.start[ids] - at, size) + np.arange(int(size.sum()))]


def _load(docs: DataFrame, model_file: str, alpha: float):
    arrow_batches(docs.sparkSession, rows=1024, mb=8)
    with open(model_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(load_pieces(f.read(), alpha))


def sample_encode(docs: DataFrame, model_file: str, seed: int = 1, alpha: float = 1.0, id_col: str = "doc_id",
                  text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: one segmentation of the whole text, drawn in proportion to its weight.

    The draw depends on (seed, row key, place of the chunk), so that every run,
    partitioning and retry gives the same ids. Null texts have null ids, empty
    ones none; rows that repeat get equal ids; a column named ``out_col`` is replaced.
    """
    pieces = _load(docs, model_file, alpha)
    keep = [c for c in docs.columns if c != out_col]
    text, seed_col = fresh(docs, "_text", "_seed")

    def encode(batches):
        lattice = Lattice(pieces.value)
        for batch in batches:
            column = batch.column(text)
            data, off = K.text_bytes(column)
            seeds = K.mix(batch.column(seed_col).to_numpy().view(np.uint64))
            ids, sizes = [np.zeros(0, np.int32)], []
            for lo, hi in K.slices(off, SAMPLED):
                i, s = lattice.sample(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], seeds[lo:hi])
                ids.append(i)
                sizes.append(s)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))])
            gone = column.is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.concatenate([gone, [False]])), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], [*keep, out_col])

    rows = docs.select(*keep, F.col(text_col).alias(text), F.xxhash64(F.lit(seed), id_col).alias(seed_col))
    return rows.mapInArrow(encode, docs.select(*keep).schema.add(out_col, ArrayType(IntegerType())))


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded``: the exact text of the ids (null for null)."""
    pieces = _load(encoded, model_file, 1.0)
    keep = [c for c in encoded.columns if c != out_col]

    def back(batches):
        p = pieces.value
        for batch in batches:
            lists = batch.column(ids_col)
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.where(gone, 0, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            off = np.concatenate([[0], np.cumsum(p.size[values])])[np.concatenate([[0], np.cumsum(n)])]
            data = b"".join(decode_ids(p, values[i:i + SAMPLED]).tobytes() for i in range(0, len(values), SAMPLED))
            text = pa.StringArray.from_buffers(len(batch), pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data),
                                               pa.array(~gone).buffers()[1] if gone.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [text], [*keep, out_col])

    return encoded.mapInArrow(back, encoded.select(*keep).schema.add(out_col, "string"))
