"""N-gram Jaccard join by vertical partitioning.

The set of a text holds its word n-grams. All n-grams have one global order,
rarest first, and the order is cut into fragments of equal weight. Every set
is split along these cuts, the overlap of two sets is counted in each fragment
on its own, and the partial counts are summed for each pair.

1. One pass over the texts returns for each a set identifier, its size and a
   small bitmap, and for each task counts of n-grams in hashed counters. The
   order is that of the counters, then of the hash; counters are of fixed
   number, so the table that is broadcast does not grow with the corpus.
2. Two sets of Jaccard similarity t share an n-gram among the first
   n - ceil(t * n) + 1 of both. Only these prefixes are exchanged, by n-gram,
   and those of one set alone are dropped at once. Equal sets are one set.
3. Sets that meet in an n-gram of few sets become pairs. Those that meet in
   one of many sets (copies of one text) are linked in a cascade: inside small
   blocks of one n-gram, then one set of each component with those of other
   blocks, and so on up to one block. Then each component meets the largest one
   of every n-gram that holds several. Of n-grams that still hold different
   components, a set goes on where another one is in reach: an n-gram's place in
   a set tells how many n-grams can follow in common, and so how large a similar
   set may be. Such sets meet by pairs of blocks; bitmaps tell there which may be
   similar, and these alone are compared.
4. Pairs of few pass an exact bound by bitmaps, before any set is fetched; those
   in one component already are left out.

Comparing is done by fragment wherever it is done: a row is a set's segment in
one fragment, a task has the segments of one block (or pairs of them) in one
fragment and counts partial overlaps, and a second step sums them. More
fragments make smaller tasks.

Each link that counts for a component is verified on all n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.llm.common import components
from glotsieve.llm.embedding_tiles import join_labels
from glotsieve.session import settle

WORDS = 5
PERCENT = 75
FRAGMENTS = 8
COUNTED = 1 << 19  # n-grams counted at a time
COUNTER_BITS = 21  # of the counters that give the global order
CHUNKS = 64  # rows in which a task hands over its counters
FEW = 8  # sets in an n-gram that still become pairs
BLOCK = 64  # sets in a block
CROSS = 256  # sets in a block of which only bitmaps meet
BROADCAST = 300_000  # identifiers of 8 bytes; more are joined by a shuffle
KEY_BITS = 1 << 24  # bits that tell which texts are wanted, beyond BROADCAST
MEET = 1 << 13  # sets of one n-gram whose sizes and places are compared together
PIECE = 1 << 20  # bytes of a text hashed at a time
AT_ONCE = 1 << 17  # n-grams a task hands over at a time

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; the whole text as one if it has fewer words.

    A polynomial hash of the bytes from the first word to the last of each
    n-gram, words apart by one blank, from running sums over the text.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    width = min(words, len(tokens))
    out = []
    whole = np.frombuffer(b" ".join(tokens), np.uint8)
    ends = np.append(np.flatnonzero(whole == 32), len(whole))  # words hold no blank
    first = at = 0
    while first <= len(tokens) - width:
        # as many words as fit a piece, and n-grams that begin in it overlap the next one
        past = int(np.searchsorted(ends[first:], at + PIECE - 1)) + first
        past = min(len(tokens), max(past, first + width))
        data, stops = whole[at : ends[past - 1]], ends[first:past] - at
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE.take(data) * power[: len(data)], out=sums[1:])
        n = past - first - width + 1
        a, b = np.append(0, stops[: n - 1] + 1), stops[width - 1 :]
        out.append((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        first += n
        at = int(ends[first - 1]) + 1
    hashes = _mix(out[0] if len(out) == 1 else np.concatenate(out))
    hashes.sort()
    return hashes[np.append(True, hashes[1:] != hashes[:-1])]


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the number of hashes at each bit; about as many bits as hashes, a power of two from 64."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many hashes belong to one of two sets only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Order:
    """The global order: rank of a hash's counter, then the hash. A one-to-one map of hashes."""

    def __init__(self, counters: np.ndarray, bits: int, fragments: int):
        self.bits = bits
        by_count = np.argsort(counters, kind="stable")
        self.rank = np.empty(len(counters), np.uint32)
        self.rank[by_count] = np.arange(len(counters), dtype=np.uint32)
        weight = np.cumsum(counters[by_count])
        shares = weight[-1] * np.arange(1, fragments) // fragments
        self.cuts = np.searchsorted(weight, shares, side="right").astype(np.uint64) << np.uint64(64 - bits)
        #: counters far above the mean stand for common n-grams, which are salted
        self.sorted_counts, self.common = counters[by_count], 8 * int(counters.mean()) + 4096

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes as keys that sort by the order."""
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        low = hashes & np.uint64((1 << (64 - self.bits)) - 1)
        return np.sort(self.rank[bucket].astype(np.uint64) << np.uint64(64 - self.bits) | low)

    def salts(self, keys: np.ndarray, seed: int) -> np.ndarray:
        """0, or for common n-grams one of the numbers from 1 by which they are spread."""
        rank = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        counts = self.sorted_counts[rank]
        salts = np.where(counts > self.common, 1 + seed % np.maximum(1, counts // 4096), 0)
        return salts.astype(np.int32)

    def split(self, keys: np.ndarray) -> list[np.ndarray]:
        return np.split(keys, np.searchsorted(keys, self.cuts))


def _first_pass(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint32)
        places, held = [], 0

        def count() -> None:
            """Add up the counters of some texts at a time."""
            counts = np.bincount(np.concatenate(places), minlength=len(counters))
            np.add(counters, counts, out=counters, casting="unsafe")
            places.clear()

        for batch in batches:
            keys, sizes, ids, maps = batch.column(0), [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), words)
                places.append((hashes >> np.uint64(64 - bits)).astype(np.int64))
                held += len(hashes)
                if held > COUNTED:
                    count()
                    held = 0
                sizes.append(len(hashes))
                ids.append(set_id(hashes))
                maps.append(bitmap(hashes))
            n = len(sizes)
            yield pa.record_batch(
                [keys, pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32())],
                _FIRST_NAMES,
            )
        if places:
            count()
        if counters.any():
            parts = [_narrow(c) for c in np.split(counters, min(CHUNKS, len(counters)))]
            n = len(parts)
            yield pa.record_batch(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(parts, pa.binary()), pa.array(range(n), pa.int32())],
                _FIRST_NAMES,
            )

    return run


_FIRST = "key bigint, n bigint, sid bigint, bits binary, chunk int"
_FIRST_NAMES = ["key", "n", "sid", "bits", "chunk"]


def _narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _wide(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(counts) // n}").astype(np.int64)


def _add(n: int):
    """Sums of the counters of each chunk; one row after the other, so a task holds nothing but sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[chunk] = sums.get(chunk, 0) + _wide(counts.as_py(), n)
        if sums:
            parts = [_narrow(np.minimum(x, 0xFFFFFFFF)) for x in sums.values()]
            yield pa.record_batch([pa.array(sums, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "bits"])

    return run


def _counters(first: DataFrame, bits: int) -> np.ndarray | None:
    """Sums of all tasks' counters."""
    chunks = min(CHUNKS, 1 << bits)
    n = (1 << bits) // chunks
    rows = first.filter("chunk is not null").select("chunk", "bits").repartition(chunks, "chunk")
    parts = rows.mapInArrow(_add(n), "chunk int, bits binary").collect()
    return np.concatenate([_wide(r.bits, n) for r in sorted(parts)]) if parts else None


def _prefixes(order, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*found)]
            return pa.record_batch(columns, ["token", "sid", "place", "salt"])

        for batch in batches:
            found, held = [], 0
            for text in batch.column(0):
                hashes = shingles(text.as_py(), words)
                n = len(hashes)
                if not n or (sid := set_id(hashes)) in seen:
                    continue
                seen.add(sid)
                keys = order.value.keys(hashes)[: n - (-(-percent * n // 100)) + 1]
                salts = order.value.salts(keys, sid & 0x7FFFFFFF)
                found.append((keys.view(np.int64), np.full(len(keys), sid), np.arange(len(keys), dtype=np.int32), salts))
                held += len(keys)
                if held > AT_ONCE:
                    yield rows(found)
                    found, held = [], 0
            if found:
                yield rows(found)

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by n-gram, salt and set: those of n-grams that several sets have, or that are salted, and how many.

    The rows of the last n-gram of a batch wait for the next one; an n-gram of
    very many sets is salted.
    """
    names = ["token", "sid", "place", "salt", "m"]
    held: list[list[np.ndarray]] = []

    def of(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, sid, place, salt = (np.concatenate(x) for x in zip(*rows))
        new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
        once = new | np.append(True, sid[1:] != sid[:-1])
        token, sid, place, salt, new = (x[once] for x in (token, sid, place, salt, new))
        m = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
        some = np.flatnonzero((m > 1) | (salt > 0))
        if len(some):
            yield pa.record_batch([x[some] for x in (token, sid, place, salt, m)], names)

    for batch in batches:
        rows = [x.to_numpy() for x in batch.columns]
        if not len(rows[0]):
            continue
        others = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[3] != rows[3][-1]))
        last = int(others[-1]) + 1 if len(others) else 0  # where the rows of the last n-gram begin
        if last or held and (held[-1][0][-1] != rows[0][0] or held[-1][3][-1] != rows[3][0]):
            yield from of([*held, [x[:last] for x in rows]])
            held = []
        held.append([x[last:] for x in rows])
    if held:
        yield from of(held)


def _segments(order, words: int):
    """A row for each fragment in which a set has n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            ids, fragments, parts = zip(*found)
            ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).view(np.int64)))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(fragments, pa.int32()), lists], ["sid", "fragment", "part"])

        for batch in batches:
            found, held = [], 0
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingles(text.as_py(), words)
                if set_id(hashes) != sid:  # another text of a repeated key
                    continue
                found += [(sid, f, x) for f, x in enumerate(order.value.split(order.value.keys(hashes))) if len(x)]
                held += len(hashes)
                if held > AT_ONCE:
                    yield rows(found)
                    found, held = [], 0
            if found:
                yield rows(found)

    return run


def overlaps(parts: list[tuple[int, int, np.ndarray]], n: int) -> np.ndarray:
    """Overlaps of all pairs of ``n`` sets from (set, fragment, keys): fragment counts, summed."""
    total = np.zeros((n, n), np.float32)
    by_fragment: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, fragment, keys in parts:
        by_fragment.setdefault(fragment, []).append((i, keys))
    for members in by_fragment.values():
        rows = np.repeat([i for i, _ in members], [len(k) for _, k in members])
        _, columns, count = np.unique(np.concatenate([k for _, k in members]), return_inverse=True, return_counts=True)
        shared = count[columns] > 1
        rows, columns = rows[shared], columns[shared]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        for a, b in _column_ranges(columns):
            local = np.cumsum(np.diff(columns[a:b], prepend=columns[a]) != 0)
            held = np.zeros((n, local[-1] + 1), np.float32)
            held[rows[a:b], local] = 1
            total += held @ held.T  # whole numbers, exact below 2**24
    return total


def _column_ranges(columns: np.ndarray, most: int = 4096):
    """Ranges of a sorted array that hold up to ``most`` different values."""
    if not len(columns):
        return
    new = np.flatnonzero(np.diff(columns, prepend=columns[0] - 1))
    starts = [*new[::most].tolist(), len(columns)]
    yield from zip(starts, starts[1:])


def similar(overlap, n_a, n_b, percent: int = PERCENT):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _partial(table: pa.Table) -> pa.Table:
    """Overlaps of all pairs of a group's sets in one fragment, as the upper triangle of a matrix."""
    sid = table["sid"].to_numpy()
    order = np.argsort(sid)
    part = table["part"].combine_chunks()
    parts = [part[i].values.to_numpy() for i in order.tolist()]
    n = len(parts)
    upper = overlaps([(i, 0, x) for i, x in enumerate(parts)], n)[np.triu_indices(n, 1)].astype(np.uint32)
    columns = [table["group"][:1], table["fragment"][:1], [sid[order]], [np.array([len(x) for x in parts])], [upper.tobytes()]]
    return pa.table(columns, ["group", "fragment", "sids", "sizes", "shared"])


_PARTIAL = "group bigint, fragment int, sids array<bigint>, sizes array<bigint>, shared binary"


def _summed(percent: int):
    """A forest of the links that the sums over fragments show: each set but the roots with its root."""

    def run(table: pa.Table) -> pa.Table:
        fragments = [x.values.to_numpy() for x in table["sids"]]
        ids = np.unique(np.concatenate(fragments))
        overlap, n = np.zeros((len(ids), len(ids)), np.int64), np.zeros(len(ids), np.int64)
        for sid, sizes, shared in zip(fragments, table["sizes"], table["shared"]):
            at = np.searchsorted(ids, sid)
            i, j = np.triu_indices(len(at), 1)
            overlap[at[i], at[j]] += np.frombuffer(shared.as_py(), np.uint32)
            n[at] += sizes.values.to_numpy()
        a, b = np.nonzero(np.triu(similar(overlap, n[:, None], n, percent), 1))
        labels = join_labels(np.arange(len(ids)), a, b)
        some = np.flatnonzero(labels != np.arange(len(ids)))
        return pa.table({"a": ids[labels[some]], "b": ids[some]})

    return run


def _linked(dealt: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the groups of ``dealt(group, sid)``: a forest for each, from partial overlaps by fragment."""
    rows = segments.join(_small(dealt), "sid").select("group", "fragment", "sid", "part")
    partial = rows.groupBy("group", "fragment").applyInArrow(_partial, _PARTIAL)
    return partial.groupBy("group").applyInArrow(_summed(percent), "a bigint, b bigint")


def _small(rows: DataFrame) -> DataFrame:
    """Settled rows of a few numbers, broadcast up to a checked count."""
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    fragments: int = FRAGMENTS,
    counter_bits: int = COUNTER_BITS,
    few: int = FEW,
    block: int = BLOCK,
    cross: int = CROSS,
) -> DataFrame:
    """(key, n_shingles, component_id), one row for each row of ``docs``; ``key`` is a number.

    Words are what ASCII white space separates, with A-Z in lower case. Two
    rows link if ``100 * overlap >= percent * union`` of their sets of word
    n-grams; a text of fewer words is one n-gram. A null or empty text, or one
    of white space, has an empty set and links with nothing. ``component_id``
    is the smallest key in reach, the own one included; rows without a key take
    part, and have a null component only where no key is in reach. Repeated
    rows have equal sets and link. Sets stand for equal texts by 64-bit hashes.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    first = settle(given.mapInArrow(_first_pass(words, counter_bits), _FIRST), "sets")
    sets = first.filter("chunk is null").select("key", "n", "sid", "bits")
    counters = _counters(first, counter_bits)
    if counters is None:  # no text has a word
        return sets.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    order = spark.sparkContext.broadcast(Order(counters, counter_bits, fragments))

    # n-grams of prefixes that more than one set has
    prefixes = given.select("text").mapInArrow(_prefixes(order, words, percent), "token bigint, sid bigint, place int, salt int")
    # a set comes once from each task; all of it has one exchange
    sorted_ = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid")
    found = settle(sorted_.mapInArrow(_several, "token bigint, sid bigint, place int, salt int, m bigint"), "shared")
    salted = found.filter("salt > 0").select("token", "sid", "place")
    sizes = salted.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    shared = found.filter("salt = 0").select("token", "sid", "place", "m").unionByName(salted.join(sizes, "token"))

    # pairs that may be similar, and one text for each set still in question, with its segments
    least = sets.groupBy("sid").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.first("bits").alias("bits"))
    least = settle(least, "different-sets")
    pairs = settle(_pairs(shared.filter(F.col("m") <= few), least, percent), "pairs")
    many = shared.filter(F.col("m") > few)
    asked = many.select("sid").union(pairs.select("a")).union(pairs.select("b")).distinct()
    part = settle(asked.join(least.select("sid", "key"), "sid"), "part")
    wanted = _with_key(given, part.select("key", "sid")).select("sid", "text")
    unkeyed = part.filter("key is null").select("sid")
    # sets whose rows all lack a key are found by the set itself
    wanted = wanted.unionByName(_by_set(given, unkeyed, words))
    segments = wanted.mapInArrow(_segments(order, words), "sid bigint, fragment int, part array<bigint>")
    segments = settle(segments.dropDuplicates(["sid", "fragment"]), "segments")

    member = _hot_components(settle(many.select("token", "sid", "place", "m"), "hot"), least, segments, block, cross, percent)
    cold = settle(_verified(_apart(pairs, member), segments, percent), "cold-links")
    member = components(member.toDF("b", "a").unionByName(cold))

    # keys of a component: of all rows with one of its sets
    linked = sets.groupBy("sid").agg(F.min("key").alias("least"), F.max("n").alias("n")).filter("n > 0")
    linked = linked.join(member, F.col("sid") == F.col("node"), "left").withColumn("node", F.coalesce("component", "sid"))
    lowest = linked.groupBy("node").agg(F.min("least").alias("component_id"))
    linked = linked.join(lowest, "node").select("sid", "component_id")
    out = sets.join(linked, "sid", "left")
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _with_key(given: DataFrame, part: DataFrame) -> DataFrame:
    """Texts whose key is wanted. Beyond the bound of a broadcast, most others are left out by bits of hashed keys first."""
    small = _small(part)
    if small is not part:
        return given.join(small, "key")
    spark = given.sparkSession
    place = F.pmod(F.xxhash64("key"), F.lit(KEY_BITS))
    word = F.expr("shiftleft(1L, cast(place % 64 as int))")
    rows = part.select(place.alias("place")).groupBy(F.expr("cast(place div 64 as int)").alias("i")).agg(F.bit_or(word).alias("word"))
    rows = rows.toArrow()  # up to KEY_BITS / 64 rows
    words = np.zeros(KEY_BITS // 64, np.int64)
    words[rows["i"].to_numpy()] = rows["word"].to_numpy()
    bits = spark.createDataFrame([(words.tolist(),)], "words array<bigint>")
    there = F.expr("shiftright(words[cast(place div 64 as int)], cast(place % 64 as int)) & 1L") == 1
    likely = given.withColumn("place", place).join(F.broadcast(bits), there).select("key", "text")
    return likely.join(part, "key")


def _by_set(given: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Texts without a key whose set is wanted."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([set_id(shingles(t.as_py(), words)) for t in texts], pa.int64())

    rows = given.filter("key is null").withColumn("sid", of(F.col("text")))
    return rows.join(ids, "sid").select("sid", "text")


def _hot_components(shared: DataFrame, about: DataFrame, segments: DataFrame, block: int, cross: int, percent: int) -> DataFrame:
    """(node, component) of the sets that share an n-gram with many others."""
    home = shared.groupBy("sid").agg(F.max(F.struct("m", "token"))["token"].alias("token"))
    links = _cascade(settle(home, "homes"), segments, block, percent)
    member = components(links)
    for last in (False, True):
        # each component with the largest one of the same n-gram
        held = _with_component(shared, member).groupBy("token", "component").agg(F.count("*").alias("n"), F.max("sid").alias("other"))
        held = held.withColumn("several", F.count("*").over(Window.partitionBy("token"))).filter("several > 1")
        held = settle(held, "several-components")
        hub = held.groupBy("token").agg(F.max(F.struct("n", "component", "other")).alias("hub"))
        at = "other" if last else "component"  # another set speaks for a component the second time
        pairs = held.join(hub, "token").filter("component <> hub.component").select(F.col(f"hub.{at}").alias("a"), F.col(at).alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = settle(_verified(_bounded(pairs, about, percent), segments, percent), "hub-links")
        if found.isEmpty():
            break
        links = settle(links.unionByName(found), "links-so-far")
        member = components(links)
    more = settle(_cross_links(shared, member, about, segments, cross, percent), "cross-links")
    return member if more.isEmpty() else components(member.toDF("b", "a").unionByName(more))


def _with_component(shared: DataFrame, member: DataFrame) -> DataFrame:
    known = member.toDF("sid", "component")
    return shared.join(known, "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def _cascade(homes: DataFrame, segments: DataFrame, block: int, percent: int) -> DataFrame:
    """Links inside blocks of sets of one home n-gram; one set of each component goes on, until a block holds them all."""
    level, found = 0, None
    while True:
        sizes = homes.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
        dealt = homes.join(sizes, "token").withColumn("of", F.ceil(F.col("n") / F.lit(block)).cast("bigint"))
        salt = F.pmod(F.xxhash64("sid", F.lit(level)), F.col("of"))
        dealt = settle(dealt.select(F.xxhash64("token", salt).alias("group"), "sid", "token", "of"), "dealt")
        links = settle(_linked(dealt, segments, percent), "block-links")
        found = links if found is None else found.unionByName(links)
        homes = dealt.filter("of > 1").join(links.select(F.col("b").alias("sid")), "sid", "left_anti").select("sid", "token")
        homes = settle(homes, "homes")
        level += 1
        if homes.isEmpty() or links.isEmpty():
            return settle(found, "cascade-links")


def _in_reach(percent: int):
    """(sid, block, other): sets with the blocks of sets of other components that may be similar by their places.

    If the n-gram is the first one that two sets share, all they share is in the
    rest of either set; that bounds the size of the other one. The first n-gram
    of similar sets is in both prefixes, so no link is lost.
    """

    def run(table: pa.Table) -> pa.Table:
        group, sid, place, component, block, n = (table[c].to_numpy() for c in ("group", "sid", "place", "component", "block", "n"))
        group = np.unique(group, return_inverse=True)[1]
        order = np.lexsort((n, group))
        group, place, component, n = group[order].astype(np.int64), place[order], component[order], n[order]
        sids, sid = np.unique(sid[order], return_inverse=True)
        blocks, block = np.unique(block[order], return_inverse=True)
        reach = np.minimum((n - place) * (100 + percent) // percent - n, 0x7FFFFFFF)
        by_size = group << 32 | n
        # of similar sets the smaller one reaches its own size
        small = np.flatnonzero(reach >= n)
        start = np.searchsorted(by_size, by_size[small])
        count = np.searchsorted(by_size, group[small] << 32 | reach[small], side="right") - start
        found = [np.empty(0, np.int64)]
        cuts = np.searchsorted(np.cumsum(count), np.arange(AT_ONCE, count.sum() + AT_ONCE, AT_ONCE))
        for a, b in zip([0, *(cuts[:-1] + 1)], [*(cuts[:-1] + 1), len(small)]):
            x = np.repeat(small[a:b], count[a:b])
            y = np.arange(len(x)) + np.repeat(start[a:b] - np.cumsum(count[a:b]) + count[a:b], count[a:b])
            some = (reach[y] >= n[x]) & (component[y] != component[x])
            x, y = x[some], y[some]
            found.append(np.unique(np.concatenate([sid[x] * len(blocks) + block[y], sid[y] * len(blocks) + block[x]])))
        sid_at, other = np.divmod(np.unique(np.concatenate(found)), max(1, len(blocks)))
        own = np.zeros(len(sids), np.int64)
        own[sid] = block
        return pa.table([sids[sid_at], blocks[own[sid_at]], blocks[other]], ["sid", "block", "other"])

    return run


def _may_link(percent: int):
    """Sets of a pair of blocks that may be similar to one of the other block and another component."""

    def run(table: pa.Table) -> pa.Table:
        side, n, component, bits = (table[c].to_pylist() for c in ("right", "n", "component", "bits"))
        n = np.array(n, np.int64)
        widths = {len(x) for x in bits}
        # folded to one width, as `least_difference` does
        width = min(widths)
        rows = np.stack([_fold(x, width) for x in bits])
        left, right = (np.flatnonzero(np.array(side) == k) for k in (False, True))
        if not len(right):  # a block with itself
            right = left
        wanted = np.zeros(len(n), bool)
        component = np.array(component, np.int64)
        most = 100 - percent
        for i in left.tolist():
            low, high = np.minimum(n[i], n[right]), np.maximum(n[i], n[right])
            some = right[(component[right] != component[i]) & (low * 100 >= high * percent)]
            apart = np.bitwise_count(rows[some] ^ rows[i]).sum(axis=1, dtype=np.int64)
            some = some[apart * (100 + percent) <= (n[some] + n[i]) * most]
            # the whole bitmaps are a closer bound
            some = [j for j in some.tolist() if least_difference(bits[i], bits[j]) * (100 + percent) <= (n[i] + n[j]) * most]
            if some:
                wanted[i] = True
                wanted[some] = True
        some = pa.array(np.flatnonzero(wanted))
        return pa.table([table["group"].take(some), table["sid"].take(some)], ["group", "sid"])

    return run


def _fold(bits: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(bits, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _cross_links(shared: DataFrame, member: DataFrame, about: DataFrame, segments: DataFrame, cross: int, percent: int) -> DataFrame:
    """Links between sets of different components that share an n-gram of many sets.

    Only sets of n-grams that hold several components take part. Those of a
    large component fill blocks of their own; all others are dealt by the most
    common n-gram they share. A set goes to the blocks of sets that are in its
    reach, by the place of a common n-gram in both.
    """
    known = settle(_with_component(shared, member), "known")
    several = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k"))
    open_ = settle(known.join(several.filter("low < high").select("token", "k"), "token"), "open")
    sets = open_.groupBy("sid").agg(F.max(F.struct("k", "token")).alias("home"), F.max("component").alias("component"))
    sizes = sets.groupBy("component").agg(F.count("*").alias("size"))
    sets = sets.join(sizes, "component")
    large = F.col("size") >= cross
    own = F.when(large, F.col("component")).otherwise(F.col("home.token"))
    count = F.ceil(F.when(large, F.col("size")).otherwise(F.col("home.k")) / F.lit(cross)).cast("bigint")
    sets = sets.withColumn("block", F.xxhash64(own, large, F.pmod(F.xxhash64("sid"), count)))
    sets = sets.join(about.select("sid", "n", "bits"), "sid")
    sets = settle(sets.select("sid", "component", "block", "n", "bits"), "open-sets")
    # all of one n-gram together, or pairs of blocks of them
    row = open_.select("token", "sid", "place", F.ceil(F.col("k") / F.lit(MEET)).cast("bigint").alias("of"))
    row = row.join(sets.drop("bits"), "sid").withColumn("i", F.pmod(F.xxhash64("sid"), F.col("of")))
    row = row.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)))
    group = F.xxhash64("token", F.least("i", "j"), F.greatest("i", "j")).alias("group")
    row = settle(row.select(group, "sid", "place", "component", "block", "n"), "places")
    buckets = max(1, row.count() // AT_ONCE)
    met = row.groupBy(F.pmod("group", F.lit(buckets))).applyInArrow(_in_reach(percent), "sid bigint, block bigint, other bigint")
    met = settle(met.distinct(), "met")
    side = met.select(F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("group"), (F.col("block") > F.col("other")).alias("right"), "sid")
    rows = side.join(sets.select("sid", "component", "n", "bits"), "sid")
    near = settle(rows.groupBy("group").applyInArrow(_may_link(percent), "group bigint, sid bigint"), "may-link")
    return _linked(near, segments, percent)


def _apart(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs that are not in one component yet."""
    of_a, of_b = member.toDF("a", "of_a"), member.toDF("b", "of_b")
    known = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    same = F.coalesce("of_a", "a") == F.coalesce("of_b", "b")
    return settle(known.filter(~same).select(*pairs.columns), "pairs-apart")


def _pairs(shared: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with an n-gram of few sets in common that may be similar."""
    left, right = (shared.select("token", F.col("sid").alias(side)) for side in ("a", "b"))
    pairs = left.join(right, "token").filter("a < b").select("a", "b").distinct()
    return _bounded(pairs, about, percent)


def _bounded(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be similar, by sizes and bitmaps."""
    left, right = (about.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    pairs = pairs.join(left, "a").join(right, "b")
    pairs = pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    @F.arrow_udf("bigint")
    def apart(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([least_difference(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    # similar sets differ in at most (100 - percent) / (100 + percent) of the sum of sizes
    most = (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return pairs.filter(apart("bits_a", "bits_b") * (100 + percent) <= most).select("a", "b", "n_a", "n_b")


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs whose partial overlaps, counted by fragment and summed, make them links."""
    pairs = settle(pairs, "pairs-to-verify")
    left, right = segments.toDF("a", "fragment", "part_a"), segments.toDF("b", "fragment", "part_b")
    # only segments of sets in question go on
    right = right.join(_small(settle(pairs.select("b").distinct(), "second-sets")), "b", "left_semi")
    partial = left.join(_small(pairs), "a").join(right, ["b", "fragment"])
    partial = partial.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("shared"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("overlap"))
    return summed.filter(similar(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
