import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from glotsieve.llm import merkle_manifest as mm
from glotsieve.llm import queries
from parity import connect, differences

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels of digests, from the leaves to the top."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        if place ^ 1 < len(level):
            out.append(level[place ^ 1])
        place >>= 1
    return out


def brute(rows):
    """(key, leaf, subroot, root, siblings) of every row of COLUMNS."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree(x[2] for x in sorted(groups[g], key=lambda x: x[:3])) for g in names]
    top = tree(t[-1][0] for t in trees)
    out = []
    for number, g in enumerate(names):
        for place, (_, _, leaf, key) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = siblings(trees[number], place) + siblings(top, number)
            out.append((str(key), leaf, trees[number][-1][0], top[-1][0], tuple(proof)))
    return sorted(out)


def result(found):
    return sorted(
        (str(r.key), r.leaf.hex(), r.subroot.hex(), r.root.hex(), tuple(s.hex() for s in r.siblings)) for r in found.collect()
    )


def test_missing_is_least():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 40)
        places = rng.sample(range(n), rng.randint(1, n))
        levels = tree([h(str(i)) for i in range(n)])
        asked = {(level, p) for level, ps in mm.missing(np.array(places), n) for p in ps.tolist()}
        needed, known = set(), set(places)
        for level in range(len(levels) - 1):
            needed |= {(level, p ^ 1) for p in known if p ^ 1 < len(levels[level]) and p ^ 1 not in known}
            known = {p >> 1 for p in known}
        assert asked == needed
        nodes = mm.climb({p: bytes.fromhex(levels[0][p]) for p in places}, {(a, p): bytes.fromhex(levels[a][p]) for a, p in asked}, n)
        assert nodes[-1][0].hex() == levels[-1][0]
        for p in places:
            steps = mm.path(p, n)
            proof = [bytes.fromhex(s) for s in siblings(levels, p)]
            assert mm.fold(bytes.fromhex(levels[0][p]), steps, proof).hex() == levels[-1][0]
            assert mm.fold(b"other", steps, proof).hex() != levels[-1][0]


def documents(n):
    rng = random.Random(n)
    langs = ["en"] * 6 + ["fr", "é", None, "z\U0001f600", "z￿"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "x" * rng.randint(1, 90), "é漢\n:-"])
        rows.append((rng.choice([i, i, i, None, 3]), rng.choice(["a", None, "3:b"]), rng.choice(langs), rng.choice([None, i]), text))
    return rows + rows[:3]


@pytest.mark.parametrize("n, levels, part", [(1, 12, 4096), (2, 12, 4096), (90, 12, 4096), (133, 2, 5), (70, 1, 1)])
def test_against_brute_force(spark, monkeypatch, n, levels, part):
    monkeypatch.setattr(mm, "RISE", levels)
    rows = documents(n) if n > 2 else documents(9)[:n]
    names = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame([(*r, "no", 1) for r in rows], names + ", leaf string, tree int").repartition(4)
    manifest = mm.build(df)
    found = mm.prove(manifest, part=part)
    assert result(found) == brute(rows)
    roots = found.select("root", mm.folded("leaf", "steps", "siblings").alias("to")).distinct().collect()
    assert len(roots) == 1 and roots[0].root == roots[0].to


def test_proofs_of_some_rows(spark):
    rows = documents(120)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = mm.build(df, carry={"size": F.length("text")})
    some = mm.prove(manifest, manifest.leaves.filter("key % 7 = 0"), part=16)
    assert result(some) == [r for r in brute(rows) if r[0] != "None" and int(r[0]) % 7 == 0]
    assert "size" in some.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert mm.prove(mm.build(df)).collect() == []


def test_query(spark):
    name = "op13_merkle_manifest"
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.SQL[name]) is None
