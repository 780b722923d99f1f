"""Benchmark decontamination by Wu-Manber search for many strings at once.

Texts are lower-cased and reduced to their words, each between single blanks.
The test strings are windows of words of the benchmark items, in the same
form, so a match begins and ends at words. Strings are put in classes by
length; in each class m is the shortest length and the first m bytes of the
strings are searched for:

- the shift table gives, for the last block of the m bytes under inspection,
  how far the search may move because no string holds that block further right;
  a block in no string skips m - B + 1 bytes. It is an array of bytes addressed
  by a hash of the block; blocks of one slot share the least shift;
- where the shift is zero, the bucket of that block, found by its whole 64-bit
  hash, lists the strings whose m bytes end with it;
- these are compared with the text byte by byte.

Blocks are long (up to 16 bytes), as words of a language share short ones.
Many stretches of text are searched side by side, each with its own skips.

Tables are built in tasks, one for each part of the items, and hold strings as
places in the text of their items: about 13 bytes for a byte of item text.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotsieve.llm.common import kept
from glotsieve.session import settle

WINDOW = 10
PART_BYTES = 4_000_000  # item text of one table, built in one task
PARTS = 8  # tables broadcast at once, for one pass over the documents
BLOCK = 16
LONGEST = 128  # bytes of a string that the shifts look at
SLOTS = 4  # of the shift table, for each block
STRETCH = 1 << 16  # places hashed at once
LANE = 512  # places searched one after the other, side by side with other lanes
PACK = 1 << 20  # bytes of text searched at once; a longer text is a pack of its own
#: odd multipliers of the block hash
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest ends a word
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def normalise(text: str | None) -> bytes:
    """Words of a text between single blanks, with one at both ends; empty without words."""
    words = (text or "").encode().translate(_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def _block_hash(buf: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
    """64-bit hashes of the blocks of ``b`` bytes that start at ``at``."""
    wide = np.zeros((len(at), 16), np.uint8)
    wide[:, :b] = np.lib.stride_tricks.sliding_window_view(buf, b)[at]
    x = wide.view(np.uint64)
    h = (x[:, 0] * _MIX[0] + x[:, 1]) * _MIX[1]
    h ^= h >> np.uint64(32)
    return h * _MIX[2]


class Shifts:
    """The tables of one length class; strings are places in ``buf``."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, block: int = BLOCK):
        self.m = m = int(min(size.min(), LONGEST))
        self.b = b = max(1, min(block, m // 2))
        self.far = m - b + 1
        # hashes of all places, a stretch at a time
        places = len(buf) - b + 1
        hashes = np.concatenate(
            [_block_hash(buf, np.arange(k, min(k + STRETCH, places)), b) for k in range(0, places, STRETCH)]
        )
        bits = max(8, (SLOTS * min(places, len(start) * self.far)).bit_length())
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.far, np.uint8)
        for end in range(b, m + 1):  # the least shift is written last
            self.shift[hashes[start + (end - b)] >> self.down] = m - end
        last = hashes[start + (m - b)]
        order = np.argsort(last, kind="stable")
        self.last, self.start, self.size, self.ids = last[order], start[order], size[order], ids[order]

    def candidates(self, buf: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of m bytes with a zero shift, and the hashes of their last blocks; texts are ``first`` to ``past``."""
        long = past - first >= self.m
        first, past = first[long] + self.m, past[long] + 1
        # lanes of LANE places each, the last one of a text shorter
        n = -(-(past - first) // LANE)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        end = np.repeat(first, n) + nth * LANE
        stop = np.minimum(end + LANE, np.repeat(past, n))
        ends, found = [], []
        while len(end):
            h = _block_hash(buf, end - self.b, self.b)
            move = self.shift[h >> self.down]
            zero = move == 0
            if zero.any():
                ends.append(end[zero])
                found.append(h[zero])
            end = end + np.maximum(move, 1)
            on = end < stop
            end, stop = end[on], stop[on]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(ends), np.concatenate(found)


class Patterns:
    """All windows of some items, in classes by length, with the items each stands for."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        self.names = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        number = {name: k for k, name in enumerate(self.names)}
        texts, place, owners, at = [], {}, defaultdict(set), 0
        for item, text in items:
            words = normalise(text)
            blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
            n = min(size, len(blanks) - 1)
            for lo, hi in zip(blanks, blanks[n:]) if n > 0 else ():
                window = words[lo : hi + 1]
                place.setdefault(window, at + lo)
                owners[window].add(number[item])
            texts.append(words)
            at += len(words)
        self.text = b"".join(texts)
        windows = list(place)
        start = np.array([place[w] for w in windows], np.int64)
        length = np.array([len(w) for w in windows], np.int64)
        given = [sorted(owners[w]) for w in windows]
        self.past = np.cumsum([0] + [len(g) for g in given])
        self.owner = np.array([k for g in given for k in g], np.int32)
        buf = np.frombuffer(self.text, np.uint8)
        kinds = np.minimum(np.frexp(length)[1], 6)  # bits of the length
        self.classes = []
        for kind in np.unique(kinds):
            ids = np.flatnonzero(kinds == kind)
            self.classes.append(Shifts(buf, start[ids], length[ids], ids))

    def nbytes(self) -> int:
        tables = sum(x.nbytes for c in self.classes for x in (c.shift, c.last, c.start, c.size, c.ids))
        return tables + len(self.text) + self.past.nbytes + self.owner.nbytes

    def occurrences(self, pack: bytes, first: np.ndarray, past: np.ndarray):
        """Yields (start, end, number of the window) of what the texts of a pack hold."""
        buf = np.frombuffer(pack, np.uint8)
        for c in self.classes:
            ends, found = c.candidates(buf, first, past)
            lo, hi = np.searchsorted(c.last, found, "left"), np.searchsorted(c.last, found, "right")
            some = np.flatnonzero(hi > lo)
            for end, a, b in zip(ends[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                begin = end - c.m
                for k in range(a, b):
                    n, at = int(c.size[k]), int(c.start[k])
                    if pack[begin : begin + n] == self.text[at : at + n]:
                        yield begin, begin + n, int(c.ids[k])

    def items_of(self, window: int) -> list[str | None]:
        return [self.names[k] for k in self.owner[self.past[window] : self.past[window + 1]]]


def find(parts: list[Patterns], texts: list[bytes]):
    """For each text, the byte ranges that any window covers, merged, and the items found.

    Texts are searched in packs of about ``PACK`` bytes. Each begins and ends
    with a blank and no window holds two in a row, so none crosses two texts.
    """
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) <= PACK):
            total += len(texts[to])
            to += 1
        past = np.cumsum([len(t) for t in texts[at:to]])
        first = past - [len(t) for t in texts[at:to]]
        pack = b"".join(texts[at:to])
        ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        found: dict[int, set] = defaultdict(set)
        for patterns in parts if total else ():
            seen: dict[int, set[int]] = defaultdict(set)
            for lo, hi, window in patterns.occurrences(pack, first, past):
                k = int(np.searchsorted(past, lo, "right"))
                ranges[k].append((lo - int(first[k]), hi - int(first[k])))
                seen[k].add(window)
            for k, windows in seen.items():
                for window in windows:
                    found[k].update(patterns.items_of(window))
        for k in range(to - at):
            yield merge(ranges[k]), found[k]
        at = to


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that share a blank or more become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def word_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in words, the end exclusive."""
    out, at, words = [], 0, 0
    for start, end in ranges:
        words += text.count(b" ", at, start)
        first = words
        words += text.count(b" ", start, end) - 1
        out.append((first, words))
        at = end - 1
    return out


FOUND = "n_words bigint, spans array<struct<first: bigint, past: bigint>>, items array<string>"
_FOUND_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def scan(parts, text, found=None):
    """Column of what one pass finds with broadcast tables, joined with ``found`` of the passes before."""

    def look(texts: list[str | None], earlier: list[dict | None]) -> pa.Array:
        words = [normalise(t) for t in texts]
        out = []
        for w, before, (ranges, items) in zip(words, earlier, find([p.value for p in parts], words)):
            spans = word_spans(w, ranges)
            if before:
                # neighbours are joined too, as in bytes, where they share a blank
                both = sorted(spans + [(s["first"], s["past"]) for s in before["spans"]])
                spans = [(a, b - 1) for a, b in merge([(a, b + 1) for a, b in both])]
                items |= set(before["items"])
            out.append(
                {
                    "n_words": max(0, w.count(b" ") - 1),
                    "spans": [{"first": a, "past": b} for a, b in spans],
                    "items": sorted(items, key=lambda i: (i is None, i or "")),
                }
            )
        return pa.array(out, _FOUND_TYPE)

    if found is None:

        @F.arrow_udf(FOUND)
        def first(texts: pa.Array) -> pa.Array:
            return look(texts.to_pylist(), [None] * len(texts))

        return first(text)

    @F.arrow_udf(FOUND)
    def again(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        return look(texts.to_pylist(), earlier.to_pylist())

    return again(text, found)


def pattern_tables(
    items: DataFrame, item_key: str, item_text: str, size: int, part_bytes: int, unnamed: bool
) -> tuple[DataFrame, int]:
    """(part, tables): pickled ``Patterns`` of the items in parts of about ``part_bytes``, and how many parts.

    Equal rows are one item, so a repeated item fills no part.
    """
    given = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text"))
    given = given.filter("text is not null" if unnamed else "text is not null and item is not null").distinct()
    given = settle(given, "benchmark-items")
    n = (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes + 1

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = rows.sort_by([("item", "ascending"), ("text", "ascending")])
        patterns = Patterns(list(zip(order["item"].to_pylist(), order["text"].to_pylist())), size)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "tables": [pickle.dumps(patterns)]})

    part = F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("part")
    built = given.select("item", "text", part).groupBy("part").applyInArrow(build, "part bigint, tables binary")
    return settle(built, "benchmark-tables"), n


def benchmark_overlaps(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    part_bytes: int = PART_BYTES,
    keep: tuple[str, ...] = (),
    unnamed: bool = False,
    parts: int = PARTS,
) -> DataFrame:
    """(key, *keep, n_words, spans, items), one row for each document.

    ``spans`` are the word ranges inside any occurrence of a window of an item,
    in order and apart from each other; ``items`` the ids, as strings and
    sorted, of the items with a window in the text. A null or empty text has no
    words. An item without words has no window, and one without an id has none
    unless ``unnamed``; then its windows are in ``spans`` and all such items
    are one null in ``items``, the last. One of fewer words than ``size`` is one window. Items with equal windows are all named,
    and repeated items once. Texts are searched whole, within their task: no
    shuffle. One pass over the documents searches for ``parts * part_bytes`` of
    item text, which bounds what is broadcast; the driver holds one table of
    ``part_bytes`` at a time. Items beyond that take further passes, each over
    a settled table. A ``keep`` column with the name of a column of the result
    comes back with ``kept_`` before it.
    """
    spark = docs.sparkSession
    out = docs.select(F.struct(F.col(key), *kept(keep, ("n_words", "spans", "items"))).alias("_row"), F.col(text).alias("_text"))
    tables, n = pattern_tables(items, item_key, item_text, size, part_bytes, unnamed)
    found = None
    for k in range(0, n, parts):
        if k:
            out = settle(out, "overlaps")
        here = tables.filter((F.col("part") >= k) & (F.col("part") < k + parts)).select("tables")
        sent = [spark.sparkContext.broadcast(pickle.loads(r.tables)) for r in here.toLocalIterator()]
        out = out.withColumn("_found", scan(sent, F.col("_text"), found))
        found = F.col("_found")
    return out.select("_row.*", "_found.n_words", "_found.spans", "_found.items")


def hit_words(spans):
    """Number of words inside ``spans``."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["past"] - s["first"])
