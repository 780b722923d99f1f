"""A unigram subword vocabulary, trained by expectation maximisation.

Spark counts the words, and all that follows works on distinct words with
their counts. Each step is a pass over that table: tasks segment their words
under the current piece scores, expected piece counts are summed by a grouped
aggregation, and new scores follow. Counts are rounded to millionths and summed
as whole numbers, so that a rerun agrees however tasks are ordered. The piece
table has ``seed_size`` rows and the characters needed, which bounds what is
sent to the tasks. Tasks walk over the pieces of many words at a time, in
arrays whose last axis is the word.
"""

from __future__ import annotations

import math
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotsieve.functions.text import char_ngrams
from glotsieve.operators.topk import largest_rows
from glotsieve.session import settle
from glotsieve.values import VOCABULARY_SIZE

WORD_START = "▁"  # marks the first piece of a word
SPECIAL = ["<unk>", "<s>", "</s>"]  # ids 0, 1, 2
UNKNOWN_ID = 0
FIRST_MAPPED_ID = 4
LONGEST_PIECE = 16
COVERAGE = 0.9995
_UNKNOWN_PENALTY = 10.0
_CACHED_WORDS = 50_000
_HELD_WORDS = 1 << 16  # words of texts that are cut into pieces together
_UNIT = 1_000_000  # counts are summed in millionths
_CELLS = 1 << 18  # edges of the words that are walked together
_DENSE = 1 << 24  # steps from prefix to prefix that are held as one table

# Tasks get the helpers below along with the functions that use them, so that
# workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _edges(word: str, scores: dict[str, float], floor: float, longest: int):
    """``(start, end, score, known)`` of pieces in a word, by end position.

    A character that is no piece still gets an edge, at a low score.
    """
    edges = []
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            score = scores.get(word[start:end])
            if score is not None:
                edges.append((start, end, score, True))
            elif start == end - 1:
                edges.append((start, end, floor, False))
    return edges


def best_pieces(
    word: str, scores: dict[str, float], floor: float, longest: int = LONGEST_PIECE, split: bool = False
):
    """The best segmentation and its score; with ``split``, the word itself is out."""
    best = [0.0] + [-math.inf] * len(word)
    back = [(0, True)] * (len(word) + 1)
    for start, end, score, known in _edges(word, scores, floor, longest):
        whole = split and start == 0 and end == len(word)
        if not whole and best[start] + score > best[end]:
            best[end], back[end] = best[start] + score, (start, known)
    pieces, end = [], len(word)
    while end:
        start, known = back[end]
        pieces.append((word[start:end], known))
        end = start
    return pieces[::-1], best[-1]


class Lattice:
    """The pieces of many words at a time, found by a walk over all prefixes of pieces.

    A prefix is a number: 0 is none, 1 the empty one. Words of about equal
    length are walked together, filled up with characters that are no pieces.
    """

    def __init__(self, scores: dict[str, float], floor: float | None = None):
        self.floor = _floor(scores) if floor is None else floor
        letters = sorted({ord(c) for piece in scores for c in piece})
        # Letters are numbered from 1; all other characters are 0.
        self.letter = np.zeros(max(letters, default=0) + 2, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number = {"": 1}
        steps: dict[int, int] = {}
        for piece in scores:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in number:
                    number[piece[:end]] = len(number) + 1
                    at = number[piece[: end - 1]] * self.width + int(self.letter[ord(piece[end - 1])])
                    steps[at] = number[piece[:end]]
        self.prefixes = ["", *number]
        self.score = np.array([-math.inf, *(scores.get(prefix, -math.inf) for prefix in number)])
        self.longest = _longest(scores)
        self.froms = np.array(sorted(steps), np.int64)
        self.tos = np.array([steps[at] for at in self.froms.tolist()], np.int32)
        self.table = None
        if (cells := len(self.prefixes) * self.width) <= _DENSE:
            self.table = np.zeros(cells, np.int32)
            self.table[self.froms] = self.tos

    def _next(self, prefix: np.ndarray, letter: np.ndarray) -> np.ndarray:
        at = prefix * np.int64(self.width) + letter
        if self.table is not None:
            return self.table[at]
        if not len(self.froms):
            return np.zeros_like(prefix)
        place = np.minimum(np.searchsorted(self.froms, at), len(self.froms) - 1)
        return np.where(self.froms[place] == at, self.tos[place], np.int32(0))

    def blocks(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places of the words, shortest first, in blocks of a bounded number of edges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            # The words after the first are no shorter, so a block is cut twice.
            length = max(int(sizes[order[start]]), 1)
            end = start + max(1, _CELLS // (length * min(length, self.longest)))
            length = max(int(sizes[order[min(end, len(order)) - 1]]), 1)
            end = min(end, start + max(1, _CELLS // (length * min(length, self.longest))))
            yield order[start:end]
            start = end

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(prefix, score)`` by end, start and word; starts end at the end itself.

        With ``k`` starts, place ``j`` is the start ``end - k + j``. A character
        that is no piece has the prefix 0 and the lowest score.
        """
        # Two words at least: sums over starts then run from start to start.
        words = words if len(words) > 1 else [*words, ""]
        length = max(1, max(map(len, words)))
        codes = np.frombuffer("".join(w.ljust(length, "\0") for w in words).encode("utf-32-le"), np.uint32)
        letters = self.letter[np.minimum(codes, len(self.letter) - 1)].reshape(len(words), length).T.copy()
        letters[np.arange(length)[:, None] >= np.fromiter(map(len, words), np.int64, len(words))] = 0
        found = [self._next(np.ones_like(letters), letters)]
        while len(found) < min(self.longest, length):
            longer = self._next(found[-1][:-1], letters[len(found) :])
            if not longer.any():
                break
            found.append(longer)
        prefix = np.zeros((length + 1, len(found), len(words)), np.int32)
        for size, numbers in enumerate(found, 1):
            prefix[size:, len(found) - size] = numbers
        score = self.score[prefix]
        prefix[score == -math.inf] = 0
        last = score[1:, -1]
        last[last == -math.inf] = self.floor
        return prefix, score

    def best(self, score: np.ndarray) -> np.ndarray:
        """The best score up to each position, after ``k`` rows without any."""
        positions, k, n = score.shape
        best = np.full((k + positions, n), -math.inf)
        best[k] = 0.0
        for end in range(1, positions):
            np.max(best[end : end + k] + score[end], axis=0, out=best[end + k])
        return best

    def expected(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(word, prefix, probability)`` of all pieces over all segmentations, block by block.

        Sums are relative to the best path up to each position, so that neither
        long words nor unlikely ones underflow.
        """
        for block in self.blocks(words):
            prefix, weight = self.edges([words[i] for i in block])
            positions, k, n = weight.shape
            best = self.best(weight)
            for end in range(1, positions):
                weight[end] += best[end : end + k]
                weight[end] -= best[end + k]
            weight[0] = 0.0
            np.exp(weight[1:], out=weight[1:])
            behind = np.zeros((k + positions, n))
            behind[-1] = 1.0
            # From the last end backwards every end is complete.
            for end in range(positions - 1, 0, -1):
                behind[end : end + k] += weight[end] * behind[end + k]
            ahead = np.zeros((k + positions, n))
            ahead[k] = 1.0
            for end in range(1, positions):
                weight[end] *= ahead[end : end + k]
                np.sum(weight[end], axis=0, out=ahead[end + k])
                weight[end] *= behind[end + k]
            weight /= ahead[-1]
            known = np.flatnonzero(prefix)
            yield block[known % n], prefix.ravel()[known], weight.ravel()[known]

    def add_expected(self, words: list[str], ns: np.ndarray, sums: np.ndarray) -> None:
        """Add the expected counts of the words' pieces, in millionths, by prefix."""
        for word, prefix, probability in self.expected(words):
            np.add.at(sums, prefix, np.rint(probability * _UNIT).astype(np.int64) * ns[word])

    def best_tokens(self, words: list[str], tokens: np.ndarray) -> Iterator[tuple[str, list[int]]]:
        """Every word with the tokens of its best segmentation, given by prefix.

        Neighbouring unknown characters are one unknown token.
        """
        for block in self.blocks(words):
            given = [words[i] for i in block]
            prefix, score = self.edges(given)
            positions, k, n = score.shape
            best = self.best(score)
            back = np.zeros((positions, n), np.int64)
            for end in range(1, positions):
                # Of equal ones the longest last piece.
                back[end] = np.argmax(best[end : end + k] + score[end], axis=0)
            place = np.arange(n)
            end = np.zeros(n, np.int64)
            end[: len(given)] = [len(word) for word in given]
            found = []
            while end.any():
                start = back[end, place]
                token = tokens[prefix[end, start, place]]
                found.append(np.where(end > 0, token, -1))
                end = np.where(end > 0, end - k + start, 0)
            by_word = np.array(found[::-1], np.int32).reshape(len(found), n).T
            before = np.hstack([np.full((n, 1), -1, np.int32), by_word[:, :-1]])[:, : len(found)]
            kept = (by_word >= 0) & ~((by_word == UNKNOWN_ID) & (before == UNKNOWN_ID))
            ends = np.cumsum(kept.sum(axis=1)).tolist()
            flat = by_word[kept].tolist()
            yield from ((word, flat[a:b]) for word, a, b in zip(given, [0, *ends], ends))


def expected_pieces(
    word: str, scores: dict[str, float], floor: float, longest: int = LONGEST_PIECE
) -> list[tuple[str, float]]:
    """``(piece, probability)`` over all segmentations of a word."""
    lattice = Lattice({p: score for p, score in scores.items() if len(p) <= longest}, floor)
    return [
        (lattice.prefixes[i], p)
        for which, prefix, probability in lattice.expected([word])
        for i, p in zip(prefix.tolist(), probability.tolist())
    ]


def _floor(scores: dict[str, float]) -> float:
    return min(scores.values(), default=0.0) - _UNKNOWN_PENALTY


def _longest(scores: dict[str, float]) -> int:
    return max(map(len, scores), default=1)


@dataclass(frozen=True)
class SubwordVocabulary:
    """``table`` holds ``(token, piece, score)``, at most ``size`` rows; settled."""

    table: DataFrame
    size: int
    #: Ids are complete, so a token is never looked up under another id.
    default: int | None = None

    @cached_property
    def _shared(self):
        # as many rows as the vocabulary's size
        rows = self.table.filter(F.col("token") >= len(SPECIAL)).collect()
        pieces = {r.piece: (r.token, r.score) for r in rows}
        return self.table.sparkSession.sparkContext.broadcast(pieces)

    def units(self, text: Column | str) -> Column:
        """Ids of a cleaned text, in order; no shuffle, and words are cached."""
        shared = self._shared

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            lattice = Lattice({piece: score for piece, (_, score) in shared.value.items()})
            tokens = np.array([shared.value.get(prefix, (UNKNOWN_ID,))[0] for prefix in lattice.prefixes])
            cached: dict[str, list[int]] = {}

            def flush(texts: list[list[str]], into: array, ends: array) -> None:
                """Add the tokens of some texts; all words not met before are cut together."""
                if len(cached) > _CACHED_WORDS:
                    cached.clear()
                new = {word for words in texts for word in words if word not in cached}
                marked = lattice.best_tokens([WORD_START + word for word in sorted(new)], tokens)
                cached.update((word[len(WORD_START) :], found) for word, found in marked)
                for words in texts:
                    for word in words:
                        into.extend(cached[word])
                    ends.append(len(into))
                texts.clear()

            # Texts are turned a few at a time into one flat array of a batch.
            for texts in batches:
                into, ends = array("i"), array("i", [0])
                held: list[list[str]] = []
                n = 0
                for value in texts:
                    held.append((value.as_py() or "").split())
                    n += len(held[-1])
                    if n > _HELD_WORDS:
                        flush(held, into, ends)
                        n = 0
                flush(held, into, ends)
                yield pa.ListArray.from_arrays(
                    pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(into), pa.int32())
                )

        return encode(F.col(text) if isinstance(text, str) else text)

    def with_tokens(self, df: DataFrame, spread_by: str) -> DataFrame:
        return df.withColumn("token", F.col("unit"))

    def by_unit(self, by_token: DataFrame) -> DataFrame:
        return by_token.withColumnRenamed("token", "unit")


def token_pieces(vocabulary: SubwordVocabulary) -> DataFrame:
    """``(token, piece)`` of the mapped ids."""
    mapped = F.col("token") >= FIRST_MAPPED_ID
    return vocabulary.table.filter(mapped).select("token", "piece")


def _words(counts: DataFrame) -> DataFrame:
    """Distinct words, marked, in files enough for every core: the passes are Python."""
    totals = counts.groupBy("word").agg(F.sum("n").alias("n"))
    marked = F.concat(F.lit(WORD_START), F.col("word")).alias("word")
    parts = 2 * counts.sparkSession.sparkContext.defaultParallelism
    return settle(totals.select(marked, "n").repartition(parts, "word"), "words")


def substring_counts(words: DataFrame, longest: int = LONGEST_PIECE) -> DataFrame:
    """``(piece, n)``: how often each substring of up to ``longest`` characters occurs.

    One linear scan a length, however long a word is.
    """
    of_length = [char_ngrams("word", size) for size in range(1, longest + 1)]
    pieces = words.select(F.explode(F.flatten(F.array(*of_length))).alias("piece"), "n")
    return pieces.groupBy("piece").agg(F.sum("n").alias("n"))


def _seed_pieces(
    words: DataFrame, seed_size: int, coverage: float, longest: int, least: int
) -> DataFrame:
    """``(piece, n, required)``: frequent substrings, and the characters needed."""
    counts = substring_counts(words, longest)
    counts = settle(counts.filter((F.col("n") >= least) | (F.length("piece") == 1)), "substrings")
    # A row a character of Unicode at most.
    by_count = Window.orderBy(F.desc("n"), "piece")
    before = F.coalesce(
        F.sum("n").over(by_count.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    single = counts.filter(F.length("piece") == 1)
    total = single.agg(F.sum("n")).first()[0] or 0
    characters = (
        single.withColumn("before", before)
        .filter(F.col("before") < F.lit(total) * coverage)
        .select("piece", "n", F.lit(True).alias("required"))
    )
    weighed = counts.filter(F.length("piece") > 1).withColumn(
        "weight", F.col("n") * F.length("piece")
    )
    longer = largest_rows(weighed, "weight", "piece", seed_size).select(
        "piece", "n", F.lit(False).alias("required")
    )
    return characters.union(longer)


def _scored(counts: DataFrame) -> DataFrame:
    """Log probabilities of expected counts, given in millionths; settled."""
    counts = settle(counts, "expected")
    total = counts.agg(F.sum("n")).first()[0]
    return counts.withColumn("score", F.log(F.col("n") / F.lit(total)))


def _share_scores(pieces: DataFrame):
    """Scores of all pieces for the tasks: as many as the seed and the characters needed."""
    rows = pieces.select("piece", "score").toLocalIterator()
    return pieces.sparkSession.sparkContext.broadcast({r.piece: r.score for r in rows})


def _expectation(words: DataFrame, pieces: DataFrame, least: float) -> DataFrame:
    """One EM step: ``(piece, required, n, score)`` with new expected counts."""
    shared = _share_scores(pieces)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        # One row a piece and task.
        sums = np.zeros(len(lattice.prefixes), np.int64)
        for batch in batches:
            lattice.add_expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(), sums)
        found = np.flatnonzero(sums)
        pieces = pa.array([lattice.prefixes[i] for i in found], pa.string())
        yield pa.record_batch([pieces, pa.array(sums[found])], ["piece", "n"])

    expected = (
        words.select("word", "n").mapInArrow(expect, "piece STRING, n BIGINT")
        .groupBy("piece")
        .agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    )
    floor = F.lit(int(least * _UNIT)).cast("decimal(38,0)")
    kept = (
        pieces.select("piece", "required")
        .join(expected, "piece", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("decimal(38,0)")))
        .filter(F.col("required") | (F.col("n") >= floor))
        .withColumn("n", F.greatest("n", floor))
    )
    scored = settle(_scored(kept.withColumn("n", F.col("n").cast("double"))), "pieces")
    shared.destroy()
    return scored


def _prune(pieces: DataFrame, keep: int) -> DataFrame:
    """Keep the pieces whose loss would cost most, and all needed characters.

    What a piece is worth is its count times how much better it scores than
    the best way to spell it with other pieces.
    """
    shared = _share_scores(pieces)

    def worth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = shared.value
        floor, longest = _floor(scores), _longest(scores)
        for batch in batches:
            gains = [
                n * (score - best_pieces(piece, scores, floor, longest, split=True)[1])
                for piece, n, score in zip(batch["piece"], batch["n"], batch["score"])
            ]
            yield batch.assign(worth=gains)

    schema = "piece STRING, required BOOLEAN, n DOUBLE, score DOUBLE, worth DOUBLE"
    tasks = 2 * pieces.sparkSession.sparkContext.defaultParallelism
    ranked = pieces.repartition(tasks, "piece").select("piece", "required", "n", "score").mapInPandas(
        worth, schema
    )
    ranked = settle(ranked, "worth")
    shared.destroy()
    required = ranked.filter("required")
    room = keep - required.count()
    # Losses below one count all alike; `largest_rows` takes weights from 1.
    weighed = ranked.filter("not required").withColumn("weight", F.greatest("worth", F.lit(0.0)) + 1)
    best = largest_rows(weighed, "weight", "piece", max(room, 0))
    return settle(required.drop("worth").unionByName(best.drop("worth", "weight")), "pruned")


def train_subwords(
    counts: DataFrame,
    size: int = VOCABULARY_SIZE,
    seed_size: int | None = None,
    shrink: float = 0.75,
    steps: int = 2,
    coverage: float = COVERAGE,
    longest: int = LONGEST_PIECE,
    least: int = 2,
    least_expected: float = 0.5,
) -> SubwordVocabulary:
    """Train ``size`` ids, the three special ones included, on ``word_counts``.

    Seeds are the ``seed_size`` heaviest substrings (four times ``size`` unless
    given) of up to ``longest`` characters that occur ``least`` times. A piece
    expected less often than ``least_expected`` leaves. The vocabulary is
    smaller only if the corpus has too few substrings.
    """
    seed_size = seed_size or 4 * size
    words = _words(counts)
    seeds = _seed_pieces(words, seed_size, coverage, longest, least)
    pieces = settle(_scored(seeds.withColumn("n", F.col("n").cast("double"))), "seeds")
    goal = size - len(SPECIAL)
    if pieces.filter("required").count() > goal:
        raise ValueError(f"{goal} pieces cannot hold every character needed")
    while True:
        for _ in range(steps):
            pieces = _expectation(words, pieces, least_expected)
        now = pieces.count()
        if now <= goal * 1.1:
            break
        pieces = _prune(pieces, max(int(goal * 1.1), int(now * shrink)))
    best = pieces.orderBy(F.desc("required"), F.desc("score"), "piece").limit(goal)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "piece"))
    ids = best.select(
        (place + len(SPECIAL) - 1).alias("token"), "piece", "score"
    )
    special = counts.sparkSession.createDataFrame(
        [(i, piece, 0.0) for i, piece in enumerate(SPECIAL)],
        "token INT, piece STRING, score DOUBLE",
    )
    return SubwordVocabulary(settle(special.unionByName(ids), "subwords"), size)
