import numpy as np

from glotsieve.llm import quality_cnn as qc
from glotsieve.llm import queries


def slow_probability(p, text):
    """The network spelled out: every chunk of 512 bytes, step by step."""
    data = [*(text or "").encode()]
    halves = max(2, -(-len(data) // qc.HALF))
    data += [0] * (halves * qc.HALF - len(data) + qc.WIDTH)
    judged = []
    for c in range(halves - 1):
        best = np.full(qc.FILTERS, -np.inf)
        for at in range(c * qc.HALF, (c + 2) * qc.HALF, qc.STEP):
            window = np.concatenate([p["bytes"][b] for b in data[at : at + qc.WIDTH]])
            best = np.maximum(best, window @ p["filters"])
        chunk = np.maximum(best + p["filter_bias"], 0)
        judged.append(np.maximum(chunk @ p["chunk"] + p["chunk_bias"], 0))
    pooled = np.concatenate([np.max(judged, axis=0), np.mean(judged, axis=0)])
    return 1 / (1 + np.exp(-(pooled @ p["out"] + p["out_bias"][0])))


def test_forward(monkeypatch):
    p = qc.initial(3)
    monkeypatch.setattr(qc, "PIECE", 3)
    for text in (None, "", "a", "é" * 300, "word and more " * 200):
        assert abs(qc.probability(p, text) - slow_probability(p, text)) < 1e-4


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(2)
    p = {k: v + rng.normal(size=v.shape).astype(np.float32) * 0.05 for k, v in qc.initial(2).items()}
    texts = ["abc de " * 60, "zz zz " * 200, "Q" * 700]
    y = np.array([1, 0, 1], np.float32)
    data = [qc.padded(t) for t in texts]
    g = qc.gradients(p, data, y)

    def loss(q):
        # as in training, a window at the end of a text reads on into the next
        best, _ = qc.filter_maxima(q, np.concatenate(data))
        total, first = 0.0, 0
        for d, label in zip(data, y):
            own = best[first : first + len(d) // qc.HALF]
            first += len(own)
            chunk = np.maximum(np.maximum(own[:-1], own[1:]) + q["filter_bias"], 0)
            judged = np.maximum(chunk @ q["chunk"] + q["chunk_bias"], 0)
            v = float(np.concatenate([judged.max(axis=0), judged.mean(axis=0)]) @ q["out"] + q["out_bias"][0])
            total += np.log1p(np.exp(v)) - label * v
        return total / len(y)

    for name in p:
        flat = np.abs(g[name]).ravel()
        for at in np.argsort(flat)[-3:]:
            up, down = ({k: v.astype(np.float64) for k, v in p.items()} for _ in range(2))
            up[name].ravel()[at] += 1e-4
            down[name].ravel()[at] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            assert abs(slope - g[name].ravel()[at]) < 0.02 * abs(slope) + 1e-3, name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_quality_cnn(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = [r for r in held if r.quality], [r for r in held if not r.quality]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert sum(1 - r.predicted for r in bad) / len(bad) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_cases(spark):
    rows = [(i, t, 0.5) for i, t in enumerate([None, "", "good", "bad!!", "good", "x " * 90000])] + [(None, "bad", 1.0)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, score double")
    def labels(*given):
        return spark.createDataFrame(list(given), "doc_id long, quality int, text string")

    for given, score in (((), 1.0), (((2, 0, "a"), (3, None, "a")), 0.0), (((2, 1, "a"), (None, 0, "a")), 1.0)):
        got = qc.score(docs, qc.fit(docs, labels(*given))).collect()
        assert len(got) == 10 and all(abs(r.score - score) < 1e-9 for r in got)
    mixed = labels(*((i, int(i != 3), None) for i in range(1, 6)), (3, 0, None))
    model = qc.fit(docs, mixed, epochs=2)
    got = qc.score(docs, model).collect()
    assert len(got) == 10 and all(0 < r.score < 1 for r in got)
    for r in got:
        text = dict((k, t) for k, t, _ in rows)[r.doc_id]
        assert abs(r.score - qc.probability(model, text)) < 1e-9
    assert qc.score(docs.limit(0), qc.fit(docs.limit(0), mixed)).count() == 0


def test_kept_columns_of_the_results_names(spark):
    docs = spark.createDataFrame([(1, "a", 9), (1, None, 8)], "doc_id long, text string, Score int")
    rows = qc.score(docs, qc.initial(3), keep=("Score", "text"))
    assert rows.columns == ["doc_id", "kept_Score", "text", "score"]
    assert sorted(r.kept_Score for r in rows.collect()) == [8, 9]
