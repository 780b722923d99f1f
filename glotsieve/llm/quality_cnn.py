"""Quality by a convolutional network over the bytes of a text, in numpy.

Every byte has a learned vector. Filters look at ``WIDTH`` bytes at every
second position, and each filter's largest answer is kept for each chunk of
512 bytes; chunks overlap by half, and together they cover the whole text. A
small layer judges every chunk; the largest and the mean judgement over all
chunks are combined into one probability.

Chunks tell junk by what they hold, such as marks between words, and also by
what they lack: where one word is repeated, few filters find anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotsieve.llm.common import class_counts, kept, labelled_sample

SAMPLE = 1_500  # labelled rows of each class that training takes, at most
TRAIN_BYTES = 6_000  # texts longer than this are scored, but not learned from
HALF = 256  # bytes of half a chunk
STEP = 2
WIDTH, EMBED, FILTERS, HIDDEN = 8, 8, 24, 16
EPOCHS, BATCH, RATE = 10, 32, 4e-3
PIECE = 128  # half chunks convolved at once, which bounds memory for long texts


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, fan: rng.normal(size=shape).astype(np.float32) * np.float32(np.sqrt(2 / fan))
    zeros = lambda n: np.zeros(n, np.float32)
    return {
        "bytes": draw(256, EMBED, fan=2),
        "filters": draw(WIDTH * EMBED, FILTERS, fan=WIDTH * EMBED), "filter_bias": zeros(FILTERS),
        "chunk": draw(FILTERS, HIDDEN, fan=FILTERS), "chunk_bias": zeros(HIDDEN),
        "out": draw(2 * HIDDEN, fan=2 * HIDDEN), "out_bias": zeros(1),
    }


def padded(text: str | None) -> np.ndarray:
    """Bytes of a text, with zeros up to whole half chunks, of which there are two at least."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    halves = max(2, -(-len(data) // HALF))
    return np.concatenate([data, np.zeros(halves * HALF - len(data), np.uint8)])


def filter_maxima(p: dict, data: np.ndarray, where: bool = False):
    """Largest answer of every filter in each half chunk, and at which position, if asked for."""
    halves = len(data) // HALF
    best = np.empty((halves, FILTERS), np.float32)
    spot = np.empty((halves, FILTERS), np.int64) if where else None
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    per = HALF // STEP
    for a in range(0, halves, PIECE):
        b = min(halves, a + PIECE)
        part = p["bytes"][data[a * HALF : b * HALF + WIDTH]].ravel()
        view = np.lib.stride_tricks.sliding_window_view(part, WIDTH * EMBED)[:: STEP * EMBED][: (b - a) * per]
        answers = (np.ascontiguousarray(view) @ p["filters"]).reshape(b - a, per, FILTERS)
        if where:
            at = answers.argmax(axis=1)
            best[a:b] = np.take_along_axis(answers, at[:, None], 1)[:, 0]
            spot[a:b] = (np.arange(a, b)[:, None] * per + at) * STEP
        else:
            best[a:b] = answers.max(axis=1)
    return best, spot


def probability(p: dict, text: str | None) -> float:
    best, _ = filter_maxima(p, padded(text))
    chunks = np.maximum(np.maximum(best[:-1], best[1:]) + p["filter_bias"], 0)
    judged = np.maximum(chunks @ p["chunk"] + p["chunk_bias"], 0)
    value = np.concatenate([judged.max(axis=0), judged.mean(axis=0)]) @ p["out"] + p["out_bias"][0]
    return float(1 / (1 + np.exp(-np.clip(np.float64(value), -35, 35))))


def gradients(p: dict, texts: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over a batch of padded texts."""
    data = np.concatenate(texts)
    halves = np.array([len(t) // HALF for t in texts])
    best, spot = filter_maxima(p, data, where=True)
    first = np.cumsum(halves) - halves
    left = np.concatenate([np.arange(f, f + h - 1) for f, h in zip(first, halves)])
    owner = np.repeat(np.arange(len(texts)), halves - 1)
    upper = best[left + 1] > best[left]
    raw = np.where(upper, best[left + 1], best[left]) + p["filter_bias"]
    chunks = np.maximum(raw, 0)
    before = chunks @ p["chunk"] + p["chunk_bias"]
    judged = np.maximum(before, 0)
    starts = np.cumsum(halves - 1) - (halves - 1)
    most, mean = np.maximum.reduceat(judged, starts), np.add.reduceat(judged, starts) / (halves - 1)[:, None]
    pooled = np.concatenate([most, mean], axis=1)
    value = pooled @ p["out"] + p["out_bias"][0]
    error = ((1 / (1 + np.exp(-np.clip(value, -35, 35))) - y) / len(y)).astype(np.float32)
    g = {"out": pooled.T @ error, "out_bias": error.sum(keepdims=True)}
    back = error[:, None] * p["out"]
    is_most = judged == most[owner]
    shared = np.add.reduceat(is_most, starts)
    d = back[owner, :HIDDEN] * is_most / shared[owner] + back[owner, HIDDEN:] / (halves - 1)[owner][:, None]
    d = (d * (before > 0)).astype(np.float32)
    g["chunk"], g["chunk_bias"] = chunks.T @ d, d.sum(axis=0)
    d = (d @ p["chunk"].T) * (raw > 0)
    g["filter_bias"] = d.sum(axis=0)
    # only the bytes under each largest answer get a share
    half = left[:, None] + upper
    at = np.take_along_axis(spot, half, 0)
    padded_data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    seen = padded_data[at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, offset
    vectors = p["bytes"][seen]
    g["filters"] = np.einsum("cf,cfwe->wef", d, vectors, optimize=True).reshape(WIDTH * EMBED, FILTERS)
    weights = p["filters"].reshape(WIDTH, EMBED, FILTERS)
    flat = seen.ravel()
    g["bytes"] = np.stack(
        [
            np.bincount(flat, (d[:, :, None] * weights[:, e, :].T[None]).ravel(), 256)
            for e in range(EMBED)
        ],
        axis=1,
    ).astype(np.float32)
    return g


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    """Adam over shuffled batches, with a falling rate."""
    p, data, rng = initial(seed), [padded(t) for t in texts], np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    step, steps = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            g = gradients(p, [data[i] for i in batch], y[batch])
            step += 1
            rate = RATE * (1 - 0.95 * step / steps)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
                p[k] = p[k].astype(np.float32)
    return p


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES, epochs: int = EPOCHS,
) -> dict[str, np.ndarray]:
    """The network, learned from at most ``sample`` labelled rows of each class.

    Rows whose text is longer than ``train_bytes`` are not learned from, so
    the one task that trains holds a bounded sample. What comes back are some
    thousand numbers. The bias is moved from the shares of the classes in the
    sample to those of all labels. With fewer than two classes every score is
    the share of class 1 (1 without labels, so that nothing is rejected).
    """
    zero, one = class_counts(labels, label, key)
    p = initial()
    p["out"] = np.zeros_like(p["out"])
    p["out_bias"] = np.array([np.log((one + 1e-9) / (zero + 1e-9))], np.float32)
    if not zero or not one:
        p["out_bias"] = np.array([35 if one or not zero else -35], np.float32)
        return p
    chosen = labelled_sample(docs, labels, label, sample, key, text, train_bytes)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        y = table["label"].to_numpy().astype(np.float32)
        if y.min() == y.max():
            return pa.table({"name": ["none"], "value": [[0.0]]})
        found = train(table["text"].to_pylist(), y, epochs)
        found["out_bias"] += np.float32(np.log(one / zero) - np.log(y.sum() / (len(y) - y.sum())))
        values = [v.ravel().astype(float).tolist() for v in found.values()]
        return pa.table({"name": list(found), "value": values})

    chosen = chosen.select(F.lit(0).alias("all"), F.xxhash64("_key").alias("at"), "label", "text")
    parts = chosen.groupBy("all").applyInArrow(learn, "name string, value array<double>").collect()
    for row in parts:
        if row.name in p:
            p[row.name] = np.array(row.value, np.float32).reshape(p[row.name].shape)
    return p


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score), one row for each row: the probability of class 1 by the whole text.

    A null text counts as an empty one, which is two half chunks of padding.
    Repeated rows get equal scores. Rows stay in their tasks. A ``keep`` column
    named ``score`` comes back as ``kept_score``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([probability(sent.value, t.as_py()) for t in texts], pa.float64())

    return docs.select(F.col(key), *kept(keep, ("score",)), judge(F.col(text)).alias("score"))
