"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 8).

Each text is cut by the vocabulary's public pattern; the distinct pieces of an Arrow batch are
merged together. A piece's segment tree has its byte positions as leaves; a leaf holds the rank of
the pair that begins there, a node the leftmost minimum below it. The root thus names the next
merge, which updates the leaves of the three positions it touches (linked by live neighbours) and
their log(n) ancestors. NumPy runs step s of all pieces of a size class at once; a very long piece runs alone over plain lists.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import once

VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the public pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 60
CELLS = 1 << 20  # leaves handled at once
KEPT = 100_000  # pieces a worker remembers
LONG = 4096  # bytes from which a piece is merged alone
SLOTS = 20  # log2 of the pair table's size


def load_ranks(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> dict[bytes, int]:
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class PairTable:
    """Rank of the token that two neighbouring tokens make, by open addressing over NumPy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.width = np.int64(max(ranks.values()) + 1)
        self.keys = np.full(1 << SLOTS, -1, dtype=np.int64)
        self.values = np.full(1 << SLOTS, -1, dtype=np.int64)
        todo, self.probes = np.arange(len(r)), 0
        key = a * self.width + b
        slot = self.slot(key)
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.keys[s] < 0
            _, first = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            take = todo[first[free[first]]]
            self.keys[slot[take]], self.values[slot[take]] = key[take], r[take]
            todo = np.setdiff1d(todo, take, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << SLOTS) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where the two make no token; a or b may be negative for none."""
        key = a * self.width + b
        key[(a < 0) | (b < 0)] = -2
        slot = self.slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.values[slot], -1)
        left = np.flatnonzero((at != key) & (at >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << SLOTS) - 1)
            at = self.keys[slot[left]]
            hit = at == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (at >= 0)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.whole = ranks
        self.known: dict[str, np.ndarray] = {}
        self.ranks: dict[int, int] | None = None

    def merge(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``size`` bytes, size a power of two."""
        m = len(pieces)
        lens = np.array([len(p) for p in pieces])
        ids = np.full((m, size + 1), -1, dtype=np.int64)  # the last column is no position
        ids[:, :size][np.arange(size) < lens[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.minimum(np.tile(np.arange(1, size + 2), (m, 1)), lens[:, None])
        after[after == lens[:, None]] = size
        before = np.tile(np.arange(-1, size), (m, 1))
        before[:, 0] = size
        rank = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, size)
        tree = np.full((m, 2 * size + 1), NONE, dtype=np.int64)
        tree[:, size : 2 * size] = np.where(rank >= 0, rank * size + np.arange(size), NONE)
        k = size // 2
        while k:
            np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
            k //= 2
        tree[:, 2 * size] = NONE
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            top = tree[rows, 1]
            at, new = top % size, top // size
            gone = after[rows, at]
            nxt, prv = after[rows, gone], before[rows, at]
            ids[rows, at] = new
            ids[rows, gone] = -1
            after[rows, at] = nxt
            before[rows, nxt] = at
            right = self.pairs.rank(new, np.where(nxt < size, ids[rows, nxt], -1))
            left = self.pairs.rank(np.where(prv < size, ids[rows, prv], -1), new)
            tree[rows, size + gone] = NONE
            tree[rows, size + at] = np.where(right >= 0, right * size + at, NONE)
            tree[rows, size + prv] = np.where(left >= 0, left * size + prv, NONE)
            r3 = np.concatenate([rows, rows, rows])
            node = (size + np.concatenate([gone, at, np.where(prv < size, prv, at)])) >> 1
            while node[0]:
                tree[r3, node] = np.minimum(tree[r3, 2 * node], tree[r3, 2 * node + 1])
                node >>= 1
            rows = rows[tree[rows, 1] < NONE]
        return [x[x >= 0].astype(np.int32) for x in ids]

    def merge_one(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece, by the same tree over plain lists: its merges follow each other, so arrays don't help."""
        if self.ranks is None:
            at = self.pairs.keys >= 0
            self.ranks = dict(zip(self.pairs.keys[at].tolist(), self.pairs.values[at].tolist(), strict=True))
        rank, width, none, n = self.ranks, int(self.pairs.width), int(NONE), len(piece)
        size = 1 << (n - 1).bit_length()
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank.get(ids[i] * width + ids[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, key: int) -> None:
            node = size + i
            tree[node] = key
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a <= b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while (top := tree[1]) < none:
            new, at = divmod(top, size)
            gone = after[at]
            nxt, prv = after[gone], before[at]
            ids[at], ids[gone], after[at] = new, -1, nxt
            put(gone, none)
            right = None
            if nxt < n:
                before[nxt] = at
                right = rank.get(new * width + ids[nxt])
            put(at, none if right is None else right * size + at)
            if prv >= 0:
                left = rank.get(ids[prv] * width + new)
                put(prv, none if left is None else left * size + prv)
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def pieces(self, texts: list[str]) -> None:
        """Encode pieces that aren't known yet."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for t in texts:
            b = t.encode()
            if (r := self.whole.get(b)) is not None:
                self.known[t] = np.array([r], dtype=np.int32)
            elif len(b) > LONG:
                self.known[t] = self.merge_one(b)
            else:
                classes.setdefault(1 << max(1, (len(b) - 1).bit_length()), []).append((t, b))
        for size, group in classes.items():
            step = max(1, CELLS // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.known.update(zip((t for t, _ in part), self.merge([b for _, b in part], size), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets); null and empty texts have no ids."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        self.pieces([p for p in {p for c in cut for p in c} if p not in self.known])
        known = self.known
        parts = [known[p] for c in cut for p in c]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)]
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)), ends.astype(np.int32)


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): token ids of every document, without special tokens.

    Null and empty texts have an empty list. The strings of special tokens are ordinary text. A
    text has one list whatever its length; repeated rows are encoded each, an empty table gives an
    empty result. The vocabulary (1 MB, fixed) is read on the driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(name, folder))
    key = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(key, lambda: Encoder(ranks.value))
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                ids, ends = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
