import numpy as np
import pytest

from conftest import DATA
from glotsieve.llm import embedding_tiles, queries
from glotsieve.llm.embedding_tiles import bounded, join_labels, near_duplicates, quantise, reach
from parity import connect, differences


def brute(rows, threshold):
    """Links and components of (key, vector) rows by comparing all."""
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(keys) if keys else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return out


@pytest.mark.parametrize("dims", [3, 64, 2000])
def test_bounds_hold(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(300, dims))
    x[100:200] = x[:100] + rng.normal(size=(100, dims)) * rng.uniform(0.1, 0.5, (100, 1))
    unit, q, scale, error = quantise(x)
    side = q, scale, error
    true = unit @ unit.T
    about = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(true - about) <= error[:, None] + (1 + error[:, None]) * error + 1e-12).all()
    for t in (0.3, 0.9, 0.95):
        got = set()
        for i, j, sure in bounded(side, side, t, tile=64, same=True):
            linked = sure | reach(unit, unit, i, j, t)
            assert (true[i, j][sure] >= t).all()
            got |= set(zip(i[linked].tolist(), j[linked].tolist()))
        assert got == {(a, b) for a, b in zip(*np.nonzero(true >= t)) if a < b}


def test_labels():
    labels = join_labels(np.arange(9), np.array([8, 3, 5, 1]), np.array([3, 5, 2, 0]))
    assert labels.tolist() == [0, 0, 2, 2, 4, 2, 6, 7, 2]


@pytest.mark.parametrize("block", [8192, 25])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    vectors = [(base[i % 12] + rng.normal(size=6) * 0.28).tolist() for i in range(110)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 6, [None] + [1.0] * 5, [nan] * 6, [inf] + [1.0] * 5, [1.0, 2.0], [2.0, 4.0], [1e200] * 6, [3e200] * 6, [1e-200] * 6]
    rows = [(200 - i, v) for i, v in enumerate(vectors + odd)] + [(None, vectors[0]), (None, [7.0]), (200, vectors[0])]
    df = spark.createDataFrame([(k, v, 3) for k, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = near_duplicates(df, block=block).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows, 0.95)))


def test_doubles_are_fetched_for_open_pairs_only(spark, monkeypatch):
    """Vectors whose pairs the bound settles are compared as int8 values alone."""
    rng = np.random.default_rng(11)
    near = [(v / np.linalg.norm(v)) for v in rng.normal(size=(4, 32))]
    rows = [(i, rng.normal(size=32).tolist()) for i in range(300)]
    rows += [(1000 + i, (near[i % 4] + rng.normal(size=32) * 1e-3).tolist()) for i in range(60)]
    mixed = near[0] * 0.95 + near[1] * np.sqrt(1 - 0.95**2)
    rows += [(2000, mixed.tolist()), (2001, near[0].tolist())]
    seen = []

    def settle(df, name, inner=embedding_tiles.settle):
        out = inner(df, name)
        if name == "certain-links":
            seen.append(out)
        return out

    monkeypatch.setattr(embedding_tiles, "settle", settle)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_duplicates(df, block=50).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 0.95)))
    assert len(seen) == 1 and "vec" not in seen[0].columns
    assert 0 < seen[0].filter("open").select("uid").distinct().count() < 60


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(df).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, threshold=0)


def test_query(spark):
    name = "op3_embedding_tiles"
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.SQL[name]) is None
