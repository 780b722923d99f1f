"""Byte-level BPE: encoding and decoding by the ranks of a published vocabulary.

A text is cut by the vocabulary's pattern, and each match is merged on its
own. A segment tree over the byte positions of a match holds the rank of the
pair that starts at each position; its root knows the leftmost lowest one. A
merge joins two live neighbours and updates at most three positions, each in
logarithmic time, so a match of a million bytes is no special case. Short
matches that a task has not met before are merged together, a tree each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_PAIR = (1 << 31) - 1
CACHED_PIECES = 200_000  # matches a task remembers
CACHED_LENGTH = 64  # bytes of a match that is merged together with others
AT_ONCE = 4_000
PART_CHARS = 1_000_000  # of texts that are cut, merged and handed over at a time
ROWS = 500


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the lowest pair is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(n - 1, 1).bit_length()
    following = list(range(1, n + 1))  # start of the next live part
    before = list(range(-1, n - 1))
    tree = [NO_PAIR] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], NO_PAIR)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(position: int, rank: int) -> None:
        node = size + position
        tree[node] = rank
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def pair(position: int) -> int:
        middle = following[position]
        return NO_PAIR if middle >= n else ranks.get(piece[position : following[middle]], NO_PAIR)

    while tree[1] != NO_PAIR:
        node, rank = 1, tree[1]
        while node < size:
            node = 2 * node if tree[2 * node] == rank else 2 * node + 1
        left = node - size
        right = following[left]
        following[left] = following[right]
        if following[right] < n:
            before[following[right]] = left
        put(right, NO_PAIR)
        put(left, pair(left))
        if before[left] >= 0:
            put(before[left], pair(before[left]))
    ids, start = [], 0
    while start < n:
        ids.append(ranks[piece[start : following[start]]])
        start = following[start]
    return ids


class Merger:
    """Segment trees of many short matches at once, one row of an array each.

    Ranks of pairs of ids are looked up in a sorted table made from the
    vocabulary: every way to cut a word of it into two.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = {}
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                left, right = ranks.get(word[:i]), ranks.get(word[i:])
                if left is not None and right is not None:
                    cuts[left << 32 | right] = rank
        self.keys = np.array(sorted(cuts), np.int64)
        self.merged = np.array([cuts[k] for k in self.keys.tolist()], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_PAIR)

    def rows(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Ids of pieces of up to ``size`` bytes, a power of two."""
        n = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(-1, size)
        ids = self.byte[data]
        alive = np.arange(size) < n[:, None]
        following = np.tile(np.arange(1, size + 1, dtype=np.int32), (len(pieces), 1))
        before = following - 2
        tree = np.full((len(pieces), 2 * size), NO_PAIR, np.int32)
        tree[:, size:-1] = np.where(alive[:, 1:], self.pair(ids[:, :-1], ids[:, 1:]), NO_PAIR)
        width = size // 2
        while width:
            low = tree[:, 2 * width : 4 * width]
            tree[:, width : 2 * width] = np.minimum(low[:, ::2], low[:, 1::2])
            width //= 2
        levels = size.bit_length() - 1
        flat_tree, flat_ids = tree.ravel(), ids.ravel()
        flat_next, flat_before, flat_alive = following.ravel(), before.ravel(), alive.ravel()

        def put(r: np.ndarray, position: np.ndarray, rank) -> None:
            base, node = r * (2 * size), size + position
            flat_tree[base + node] = rank
            for _ in range(levels):
                below = base + (node & ~1)
                node = node >> 1
                flat_tree[base + node] = np.minimum(flat_tree[below], flat_tree[below + 1])

        r = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(r):
            base, at = r * (2 * size), r * size
            rank, node = flat_tree[base + 1], np.ones(len(r), np.int64)
            for _ in range(levels):
                node = 2 * node
                node += flat_tree[base + node] != rank
            left = node - size
            right = flat_next[at + left]
            past = flat_next[at + right]
            flat_ids[at + left], flat_next[at + left], flat_alive[at + right] = rank, past, False
            put(r, right, NO_PAIR)
            inside = past < n[r]
            near = at + np.minimum(past, size - 1)
            flat_before[near[inside]] = left[inside]
            put(r, left, np.where(inside, self.pair(rank, flat_ids[near]), NO_PAIR))
            previous = flat_before[at + left]
            some = previous >= 0
            q, where = r[some], previous[some]
            put(q, where, self.pair(flat_ids[at[some] + where], rank[some]))
            r = r[flat_tree[base + 1] != NO_PAIR]
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        flat = ids[alive].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        out, classes = {}, {}
        for piece in pieces:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                out[piece] = [rank]
            elif len(data) > CACHED_LENGTH:
                out[piece] = merge_piece(data, self.ranks)
            else:
                classes.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for size, members in classes.items():
            for a in range(0, len(members), AT_ONCE):
                part = members[a : a + AT_ONCE]
                out.update(zip([p for p, _ in part], self.rows([d for _, d in part], size)))
        return out


class Encoder:
    """Ids of texts. Matches are remembered; beyond a bound, only those of the last texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find, self.merger = regex.compile(pattern).findall, Merger(ranks)
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.find(t) for t in texts]
        seen = set(chain.from_iterable(cut))
        unseen = seen - self.known.keys()
        self.known.update(self.merger.encode(unseen))
        of = self.known.__getitem__
        out = [np.fromiter(chain.from_iterable(map(of, pieces)), np.int32) for pieces in cut]
        if len(self.known) > CACHED_PIECES:
            self.known = {p: self.known[p] for p in seen}
        return out


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch in parts of bounded size, each made when it is asked for."""
    part, size = [], 0
    for text in texts:
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size > PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(rows: list, kind: str) -> pa.Array:
    """A column of lists from numpy arrays, without an object for each number."""
    ends = np.cumsum([0] + [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


class ByteBpe:
    """Columns of ids and of bytes by one vocabulary, read here and broadcast.

    Its size is that of the vocabulary file; ``max_ranks`` bounds it.
    """

    def __init__(self, spark, path: str, pattern: str, max_ranks: int = 1_000_000):
        ranks = read_ranks(path)
        if len(ranks) > max_ranks:
            raise ValueError(f"{len(ranks)} ranks are too many to broadcast; the bound is {max_ranks}")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = spark.sparkContext.broadcast(ranks)
        self.pattern = pattern

    def encode(self, text):
        """Array of ids of a text column; null has none, like an empty text."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("array<int>")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = Encoder(ranks.value, pattern)
            for texts in batches:
                for part in _parts(texts):
                    yield _lists(encoder.encode(part), "i4")

        return ids(text)

    def decode(self, ids):
        """Bytes of a column of ids; null gives none. An unknown id is an error."""
        ranks = self.ranks

        @F.arrow_udf("binary")
        def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = dict(zip(ranks.value.values(), ranks.value))
            for rows in batches:
                for at in range(0, len(rows), ROWS):
                    part = rows.slice(at, ROWS)
                    lists = ([] if row.values is None else row.values.to_pylist() for row in part)
                    yield pa.array([b"".join(map(table.__getitem__, ids)) for ids in lists], pa.binary())

        return text(ids)

    def both(self, text):
        """Ids, and the bytes they decode to, in one pass of one worker."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("ids array<int>, decoded binary")
        def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = Encoder(ranks.value, pattern)
            table = dict(zip(ranks.value.values(), ranks.value))
            for texts in batches:
                for part in _parts(texts):
                    ids = encoder.encode(part)
                    decoded = [b"".join(map(table.__getitem__, x.tolist())) for x in ids]
                    columns = [_lists(ids, "i4"), pa.array(decoded, pa.binary())]
                    yield pa.StructArray.from_arrays(columns, ["ids", "decoded"])

        return coded(text)


def encode_documents(docs: DataFrame, bpe: ByteBpe, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): token ids of every whole text, and the bytes they decode to.

    One row for each row, repeated ones too. Null and empty texts have no ids
    and decode to no bytes. No row leaves its task, other columns are not read.
    """
    coded = docs.select(F.col(key), bpe.both(F.col(text)).alias("_coded"))
    return coded.select(key, "_coded.ids", "_coded.decoded")
