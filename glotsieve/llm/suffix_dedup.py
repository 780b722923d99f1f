"""Passages that repeat across documents, by suffix arrays of shards.

A passage is a string of ``length`` bytes. It goes from every document but
that of the smallest key it starts in.

1. Every passage is dealt to a shard by the smallest hash among its grams of
   ``GRAM`` bytes, so equal passages meet. Consecutive passages of one
   smallest gram are one piece of text. Grams are hashed in one pass, packed
   into a row for each task and bucket, and those of a single document are
   dropped: nothing there can repeat. Grams that very many pieces have are
   found first, with hashed counts; they are known to be shared, so no task
   gathers their documents.
2. Pieces of shared grams go to shards of fixed size, equal pieces once with
   the smallest key. A shard is sorted by induced sorting, the lengths that
   neighbours in the array have in common are computed in text order, and a
   run of at least ``length`` is one passage: its smallest key is found there.
   A piece without another one of its gram has nothing to share with. Pieces of
   a gram that very many have are dealt by the smallest of longer grams too.
3. Keys go back to the places of the pieces by a join, and every document
   drops the bytes that a passage of a smaller key covers.

Equal texts are found before, by hashes, and only the one of the smallest key
goes on. Equality of passages is decided on their bytes; hashes only tell
which may be equal, and 64 bits of them stand for a piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotsieve.llm.induced_sorting import common_prefixes, suffix_array
from glotsieve.session import settle

LENGTH = 50
GRAM = 20
PACK = 1 << 16  # bytes hashed at a time
AT_ONCE = 1 << 19  # pieces a task gathers before it hands them over
BUCKET = 8 << 20  # bytes of text whose grams meet in one group
SHARD = 2 << 20  # bytes of pieces in a shard
OFTEN = 2048  # pieces of one gram that count as very many, at least
GRAMS = 4_000_000  # at most so many grams of very many pieces, whatever the size of the corpus
LOCAL = 8  # pieces of one gram in what a task gathers that are counted
BROADCAST = 300_000  # identifiers of 16 bytes; more are joined by a shuffle
LOW_BITS = 40  # of a gram's hash that are kept beside its bucket

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(32)
    return h


class Grams:
    """Polynomial hashes of grams of any size, from those of sizes that are powers of two."""

    def __init__(self, data: np.ndarray):
        self.levels = [_BYTE[data]]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(0, len(last) - width)
            longer = last[:n] * np.uint64(pow(_ODD, width, 1 << 64))
            longer += last[width : width + n]
            self.levels.append(longer)
        return self.levels[k]

    def at(self, size: int, places: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the grams at the given places, or of all."""
        out, width = None, 0
        n = max(0, len(self.levels[0]) - size + 1)
        for k in range(size.bit_length() - 1, -1, -1):
            if size >> k & 1:
                level = self.level(k)
                part = level[width : width + n] if places is None else level[places + width]
                out = part if out is None else out * np.uint64(pow(_ODD, 1 << k, 1 << 64)) + part
                width += 1 << k
        return out


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        h, have = np.minimum(h[:-have], h[have:]), have * 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of every member, and its number there."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Pieces:
    """Pieces of some texts: hash of the smallest gram, place and number of passages."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.length, self.gram, ends = length, gram, np.cumsum(sizes)
        self.starts, self.ends, self.grams = ends - sizes, ends, Grams(self.data)
        n = len(self.data) - length + 1
        if n < 1:
            self.key, self.at, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        least = _smallest(_mix(self.grams.at(gram)), length - gram + 1)
        # a piece ends where the smallest gram changes, and where passages would run out of a text
        new = np.empty(n + 1, bool)
        new[0] = new[n] = True
        np.not_equal(least[1:], least[:-1], out=new[1:n])
        first, last = np.minimum(self.starts, n), np.clip(ends - length + 1, 0, n)
        new[first] = new[last] = True
        edges = np.flatnonzero(new)
        start, past = edges[:-1], edges[1:]
        inside = start < np.maximum(last, first)[np.searchsorted(ends, start, side="right")]
        self._take(start[inside], past[inside], least[start[inside]])

    def _take(self, start: np.ndarray, past: np.ndarray, key: np.ndarray) -> None:
        # a gram that recurs in a text of short period may go on; the ends of a piece hash all of it
        most = min(self.length, self.length - self.gram + 1)
        if len(start) and (past - start).max() > most:
            which, part = _each(-(-(past - start) // most))
            key, start, past = key[which], start[which] + part * most, np.minimum(start[which] + (part + 1) * most, past[which])
        self.at, self.count, self.key = start, past - start, key

    def owners(self, some: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, self.at[some], side="right")

    def content(self, some: np.ndarray) -> np.ndarray:
        """Hash of the bytes of pieces, from those of the first and the last passage."""
        at, count = self.at[some], self.count[some]
        first, last = (self.grams.at(self.length, x) for x in (at, at + count - 1))
        return _mix(first * np.uint64(_ODD) + last + count.astype(np.uint64))

    def finer(self, some: np.ndarray, gram: int) -> Pieces:
        """The given pieces, cut by the smallest of longer grams as well."""
        width = self.length - gram + 1
        which, place = _each(self.count[some] + width - 1)
        least = _smallest(_mix(self.grams.at(gram, self.at[some][which] + place)), width)
        inside = (place < self.count[some][which])[: len(least)]
        which, place, least = which[: len(least)][inside], place[: len(least)][inside], least[inside]
        new = np.append(True, (which[1:] != which[:-1]) | (least[1:] != least[:-1])) if len(which) else np.empty(0, bool)
        start = np.flatnonzero(new)
        at = self.at[some][which[start]] + place[start]
        out = Pieces.__new__(Pieces)
        out.__dict__.update(self.__dict__)
        out._take(at, at + np.diff(np.append(start, len(which))), _mix(self.key[some][which[start]] ^ least[start]))
        return out

    def bytes_of(self, some: np.ndarray) -> pa.Array:
        sizes = self.count[some] + self.length - 1
        which, place = _each(sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.Array.from_buffers(
            pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.data[self.at[some][which] + place])]
        )


def _packs(batches: Iterator[pa.RecordBatch], length: int, gram: int):
    """(rows, pieces): pieces of texts in packs; a text longer than a pack is cut, with an overlap."""
    rows, texts, held = [], [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for i, text in enumerate(batch.column(0)):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for start in range(0, max(1, len(data) - length + 1), PACK):
                part = data[start : start + PACK + length - 1]
                if len(part) < length:
                    continue
                rows.append((start, *(c[i] for c in columns)))
                texts.append(part)
                held += len(part)
                if held >= PACK:
                    yield rows, Pieces(texts, length, gram)
                    rows, texts, held = [], [], 0
    if texts:
        yield rows, Pieces(texts, length, gram)


def _is_among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _often(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[np.ndarray]) -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(found), return_counts=True)
            some = n >= LOCAL
            return pa.record_batch([pa.array(key[some].view(np.int64)), pa.array(n[some])], ["key", "n"])

        found, held = [], 0
        for _, pieces in _packs(batches, length, gram):
            found.append(pieces.key)
            held += len(pieces.key)
            if held > AT_ONCE:
                yield rows(found)
                found, held = [], 0
        if found:
            yield rows(found)

    return run


def _cut(key: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a hash that name its bucket, and the kept ones after them."""
    return (key >> np.uint64(64 - LOW_BITS - bits)).astype(np.int64)


def _grams(often, length: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            cut, ids = (np.concatenate(x) for x in zip(*found))
            bucket = cut >> LOW_BITS
            order = np.argsort(bucket, kind="stable")
            cut, ids, bucket = cut[order], ids[order], bucket[order]
            # documents of a bucket are named once, with their number of grams
            new = np.ones(len(cut), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1])
            group = np.flatnonzero(new)
            counts = np.diff(np.append(group, len(cut))).astype(np.uint32)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            edges = np.append(first, len(cut))
            of_group = np.append(np.searchsorted(group, first), len(group))
            low = (cut & 0xFFFFFFFF).astype(np.uint32)
            high = (cut >> 32 & 0xFF).astype(np.uint8)
            cells = [(low[a:b].tobytes(), high[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            sizes = [counts[a:b].tobytes() for a, b in zip(of_group[:-1].tolist(), of_group[1:].tolist())]
            named = pa.ListArray.from_arrays(pa.array(of_group, pa.int32()), pa.array(ids[group]))
            return pa.record_batch(
                [pa.array(bucket[first], pa.int32()), pa.array([c[0] for c in cells], pa.binary()),
                 pa.array([c[1] for c in cells], pa.binary()), named, pa.array(sizes, pa.binary())],
                ["bucket", "low", "high", "ids", "counts"],
            )

        found, held = [], 0
        for given, pieces in _packs(batches, length, gram):
            ids = np.array([row[1] for row in given], np.int64)
            some = np.flatnonzero(~_is_among(pieces.key, often.value))
            found.append((_cut(pieces.key[some], bits), ids[pieces.owners(some)]))
            held += len(found[-1][0])
            if held > AT_ONCE:
                yield rows(found)
                found, held = [], 0
        if held:
            yield rows(found)

    return run


def _shared(groups: int):
    """Grams of a bucket that documents of different keys have, a row for each group of documents."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])
        cut = join("low", np.uint32).astype(np.int64) | join("high", np.uint8).astype(np.int64) << 32 | bucket << LOW_BITS
        ids = np.concatenate([x.values.to_numpy() for x in table["ids"]])
        ids = np.repeat(ids, join("counts", np.uint32))
        order = np.argsort(cut, kind="stable")
        cut, ids = cut[order], ids[order]
        first = np.flatnonzero(np.diff(cut, prepend=-1))
        lowest, highest = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
        some = np.repeat(lowest < highest, np.diff(np.append(first, len(cut))))
        cut, ids = cut[some], ids[some]
        group = (_mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((ids, group))
        cut, ids, group = cut[order], ids[order], group[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        edges = pa.array(np.append(first, len(cut)), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (ids, cut)]
        return pa.table([pa.array(group[first]), *lists], ["part", "ids", "grams"])

    return run


def _by_key(table: pa.Table) -> pa.Table:
    """The grams of every document of a group."""
    ids, cut = (table[c].combine_chunks().flatten().to_numpy() for c in ("ids", "grams"))
    order = np.argsort(ids, kind="stable")
    ids, cut = ids[order], cut[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cut)), pa.int32()), pa.array(cut))
    return pa.table([pa.array(ids[first]), lists], ["key", "grams"])


def _ship(often, length: int, gram: int, longer: int, bits: int):
    """Pieces of shared grams: a row for each place, and one with the bytes for each different piece of what is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            content, gram_key, ids, digest, at = (np.concatenate(x) for x in zip(*(f[:5] for f in found)))
            order = np.lexsort((ids, content))
            first = order[np.flatnonzero(np.append(True, content[order][1:] != content[order][:-1]))]
            keep = np.zeros(len(content), bool)
            keep[first] = True
            data = pa.concat_arrays([f[5] for f in found]).filter(pa.array(keep))
            n, m = len(content), int(keep.sum())
            column = lambda x, y, kind: pa.concat_arrays([pa.array(x, kind), pa.array(y, kind) if y is not None else pa.nulls(m, kind)])
            return pa.record_batch(
                [
                    column(content.view(np.int64), content[keep].view(np.int64), pa.int64()),
                    column(ids, ids[keep], pa.int64()),
                    column(digest, None, pa.int64()),
                    column(at, None, pa.int64()),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(gram_key[keep].view(np.int64))]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), data]),
                ],
                ["content", "key", "digest", "at", "gram", "data"],
            )

        found, held = [], 0
        for given, pieces in _packs(batches, length, gram):
            known = _is_among(pieces.key, often.value)
            some = np.zeros(len(known), bool)
            asked = [(i, row[3]) for i, row in enumerate(given) if row[3] is not None]
            if asked:
                which = np.repeat([i for i, _ in asked], [len(x) for _, x in asked]).astype(np.uint64)
                grams = np.concatenate([np.array(x, np.int64) for _, x in asked]).view(np.uint64)
                wanted = np.sort(_mix(grams + _mix(which + np.uint64(1))))
                owner = pieces.owners(np.arange(len(known))).astype(np.uint64)
                some = _is_among(_mix(_cut(pieces.key, bits).view(np.uint64) + _mix(owner + np.uint64(1))), wanted) & ~known
            for part in (pieces, pieces.finer(np.flatnonzero(known), longer)):
                some = np.flatnonzero(some) if part is pieces else np.arange(len(part.at))
                if not len(some):
                    continue
                owner = part.owners(some)
                start, ids, digest = (np.array([row[k] for row in given], np.int64)[owner] for k in range(3))
                place = start + part.at[some] - part.starts[owner]
                found.append((part.content(some), part.key[some], ids, digest, place, part.bytes_of(some)))
                held += len(some)
            if held > AT_ONCE // 2:
                yield rows(found)
                found, held = [], 0
        if found:
            yield rows(found)

    return run


def passages(pieces: list[bytes], keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place, least) of every passage in the pieces: the least key among pieces that hold it."""
    m = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    ends = np.cumsum(sizes + 1)
    # pieces end with symbols that differ, so nothing common runs past an end
    text = np.empty(int(ends[-1]), np.int32)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32) + m
    text[~inside] = np.arange(m)
    order = suffix_array(text, m + 256)
    common = common_prefixes(text, order)[order]
    first = np.flatnonzero(common < length)
    owner = np.repeat(np.arange(m), sizes + 1)
    least = np.minimum.reduceat(keys[owner[order]], first)
    of_text = np.empty(len(text), np.int64)
    of_text[order] = np.repeat(least, np.diff(np.append(first, len(text))))
    which, place = _each(np.maximum(sizes - length + 1, 0))
    return which, place, of_text[(ends - sizes - 1)[which] + place]


def _sort_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        content, ids = table["content"].to_numpy(), table["key"].to_numpy()
        order = np.lexsort((ids, content))
        first = order[np.flatnonzero(np.append(True, content[order][1:] != content[order][:-1]))]
        # a piece without another one of its gram has nothing to share with
        _, of_gram, pieces = np.unique(table["gram"].to_numpy()[first], return_inverse=True, return_counts=True)
        alone = pieces[of_gram] == 1
        sizes = pc.binary_length(table["data"]).to_numpy()[first]
        which, place = _each(np.maximum(sizes - length + 1, 0))
        least = ids[first][which]
        if not alone.all():
            data = table["data"].take(pa.array(first[~alone])).to_pylist()
            least[~alone[which]] = passages(data, ids[first[~alone]], length)[2]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (least[1:] != least[:-1])
        start = np.flatnonzero(new)
        past = place[np.append(start[1:], len(which)) - 1] + 1
        of_piece = np.append(np.searchsorted(which[start], np.arange(len(first))), len(start))
        offsets = pa.array(of_piece, pa.int32())
        return pa.table({
            "content": content[first],
            "past": pa.ListArray.from_arrays(offsets, pa.array(past)),
            "least": pa.ListArray.from_arrays(offsets, pa.array(least[start])),
        })

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans of a text, and the bytes outside of them."""
    for batch in batches:
        names = batch.schema.names
        spans, kept, sizes = [], [], []
        for text, found in zip(batch.column("text"), batch.column("spans")):
            data = text.as_py().encode("utf-8", "surrogatepass")
            flat = found.values.flatten()
            start, end = (x.to_numpy() for x in flat)
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            start, end = start[new], reach[np.append(new[1:], len(reach)) - 1]
            edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
            sizes.append(len(data))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch(
            [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            ["key", "n_bytes", "spans", "kept"],
        )


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _listed(ids: DataFrame) -> DataFrame:
    """Settled ids, broadcast up to a checked number."""
    return F.broadcast(ids) if ids.limit(BROADCAST + 1).count() <= BROADCAST else ids


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """(key, n_bytes, spans, kept), one row for each row of ``docs``; ``key`` is a number.

    ``spans`` are the maximal runs of bytes (start, end) that are covered by a
    string of ``length`` bytes which also starts in a row of a smaller key, and
    ``kept`` the other bytes. Strings are judged on the input, in UTF-8; they
    may begin or end within a character, so ``kept`` is binary. A null text is
    empty. A row without a key has no smaller or larger one: it loses nothing
    and takes nothing from others. Rows of equal key take nothing from one
    another, and equal rows have equal results.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram has 1 to length bytes")
    spark = docs.sparkSession
    base = docs.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("digest", F.xxhash64("text"))
    size = F.octet_length("text")

    # equal texts: all but that of the smallest key go whole
    narrow = base.filter(F.col("key").isNotNull() & (size >= length))
    narrow = settle(narrow.select("key", "digest", F.crc32(F.col("text").cast("binary")).alias("crc"), size.alias("size")), "digests")
    same = ["digest", "crc", "size"]
    groups = narrow.groupBy(*same).agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    groups = settle(groups.select(*same, "low"), "equal-texts")
    copies = settle(narrow.join(_listed(groups), same).filter("key > low").select("key", "digest").distinct(), "copies")
    given = base.filter(F.col("key").isNotNull() & (size >= length)).join(_listed(copies), ["key", "digest"], "left_anti")
    if copies.limit(BROADCAST + 1).count() > BROADCAST:
        given = settle(given, "different-texts")
    total = narrow.agg(F.sum("size")).first()[0] or 0

    # grams of very many pieces
    counted = given.select("text").mapInArrow(_often(length, gram), "key bigint, n bigint")
    least = max(OFTEN, total // GRAMS)
    many = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key").collect()
    often = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in many], np.int64).view(np.uint64)))

    # grams of documents of different keys
    bits = min(64 - LOW_BITS - 1, max(0, math.ceil(math.log2(max(1, total / BUCKET)))))
    packed = given.select("text", "key").mapInArrow(
        _grams(often, length, gram, bits), "bucket int, low binary, high binary, ids array<bigint>, counts binary"
    )
    lists = "ids array<bigint>, grams array<bigint>"
    shared = packed.groupBy("bucket").applyInArrow(_shared(1 << bits), f"part bigint, {lists}")
    asked = settle(shared.groupBy("part").applyInArrow(_by_key, "key bigint, grams array<bigint>"), "shared-grams")

    # pieces, dealt to shards
    ids = settle(asked.select("key"), "shared-keys")
    texts = given.select("text", "key", "digest")
    ship = _ship(often, length, gram, min(2 * gram, length), bits)
    schema = "content bigint, key bigint, digest bigint, at bigint, gram bigint, data binary"
    with_grams = texts.join(_listed(ids), "key", "left_semi").join(asked.hint("merge"), "key").select("text", "key", "digest", "grams")
    without = texts.join(_listed(ids), "key", "left_anti").select("text", "key", "digest", F.lit(None).cast("array<bigint>").alias("grams"))
    pieces = with_grams.mapInArrow(ship, schema)
    if len(many):
        pieces = pieces.unionByName(without.mapInArrow(ship, schema))
    pieces = settle(pieces, "pieces")
    contents = pieces.filter("data is not null").select("content", "key", "gram", "data")
    volume = contents.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, math.ceil(volume / SHARD))
    dealt = contents.withColumn("shard", F.pmod("gram", F.lit(shards)))
    sorted_ = dealt.groupBy("shard").applyInArrow(_sort_shard(length), "content bigint, past array<bigint>, least array<bigint>")
    sorted_ = settle(sorted_, "passages")

    # back to the places, and to the documents
    places = pieces.filter("data is null").select("content", "key", "digest", "at")
    found = places.join(sorted_, "content").filter(F.exists("least", lambda x: x < F.col("key")))
    run = F.transform(
        "least",
        lambda x, i: F.struct(
            (F.col("at") + F.when(i > 0, F.get("past", i - 1)).otherwise(0)).alias("start"),
            (F.col("at") + F.get("past", i) + (length - 1)).alias("end"),
            x.alias("least"),
        ),
    )
    run = F.filter(run, lambda x: x["least"] < F.col("key"))
    run = F.transform(run, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    found = found.select("key", "digest", run.alias("spans"))
    found = settle(found.groupBy("key", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    touched = settle(found.select("key", "digest"), "touched")
    on = ["key", "digest"]
    changed = base.join(_listed(touched), on, "left_semi").join(found.hint("merge"), on)
    changed = changed.select("key", "text", "spans").mapInArrow(_drop, f"key bigint, n_bytes bigint, spans {_SPANS}, kept binary")
    rest = base.join(_listed(touched), on, "left_anti").join(_listed(copies.withColumn("copy", F.lit(True))), on, "left")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    rest = rest.withColumn("n_bytes", size.cast("bigint")).select(
        "key",
        "n_bytes",
        F.when(F.col("copy"), whole).otherwise(F.array().cast(_SPANS)).alias("spans"),
        F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"),
    )
    return changed.unionByName(rest).withColumnRenamed("key", key)
