"""Whitening against plain numpy with whole numbers."""

import math
import random

import numpy as np
import pytest

from sliceframe.llm import whitening


def brute(rows, k=32):
    ok = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    sizes = [len(v) for _, v in ok]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    x = [(i, [min(max(math.floor(64 * c) + 1000000, -(2**63)), 2**63 - 1) for c in v]) for i, v in ok if len(v) == d]
    n, s = len(x), [sum(v[j] for _, v in x) for j in range(d)]
    y = [[n * a - b for a, b in zip(v, s)] for _, v in x]
    cov = np.array([[sum(r[a] * r[b] for r in y) / n**3 for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    z = np.array(y, dtype=float) / n @ vectors[:, order]
    return [(i, sum(a * a for a in r)) for (i, _), r in zip(x, y)], values[order], z, np.trace(cov), n


def check(spark, rows, tile=whitening.TILE, partitions=3):
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, component int").repartition(partitions)
    got = {}
    for r in whitening.query(d, tile).collect():
        got.setdefault(r["vec_id"], []).append(r)
    want, values, z, trace, n = brute([(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows])
    assert set(got) == {i for i, _ in want}
    for (i, deviation), line in zip(want, z):
        for r in got[i]:
            k = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["identity_error"] < 1e-4 and abs(r["explained"] - values[k] / trace) <= 1e-9
            assert abs(abs(r["whitened"]) - abs(line[k]) / math.sqrt(values[k])) < 1e-7
    return got


@pytest.mark.parametrize("tile,partitions", [(4, 1), (5, 7), (64, 3)])
def test_against_whole_numbers(spark, tile, partitions):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j) + (5 * j if i % 2 else 0) for j in range(13)]) for i in range(150)]
    rows += [(500 + i, rows[7][1]) for i in range(60)] + [(900, None), (901, []), (902, [None] * 13), (903, [float("nan")] * 13), (904, [float("inf")] * 13), (905, [1.0] * 5)]
    got = check(spark, rows, tile, partitions)
    assert len(got) == 210 and all(len(x) == 13 for x in got.values())


def test_stripes_and_row_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(11)]) for i in range(90)]
    monkeypatch.setattr(whitening, "BLOCK", 50)
    monkeypatch.setattr(whitening, "STRIPE", 18)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert len(whitening.stripes(11, 3)[1]) > 3
    model = whitening.fit(d, tile=3)
    _, values, *_ = brute([(i, [float(np.float32(e)) for e in v]) for i, v in rows])
    assert np.allclose(model.values, values)


def test_first_components_only(spark):
    rng = random.Random(3)
    got = check(spark, [(i, [rng.gauss(0, 1 + j) for j in range(40)]) for i in range(120)])
    assert all(sorted(r["component"] for r in x) == list(range(1, 33)) for x in got.values())


def test_degenerate_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.query(spark.createDataFrame([], kind)).count() == 0
    assert whitening.query(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = whitening.query(spark.createDataFrame([(1, [0.5, 2.0])], kind)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(0, None, None, None)] * 2
    # A dimension that repeats another one, and a constant one.
    rows = [(i, [float(i % 7), float(i % 7), 3.0, float(i * i % 5)]) for i in range(40)]
    got = whitening.query(spark.createDataFrame(rows, kind)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 2) and r["identity_error"] < 1e-9 for r in got)


def test_large_entries(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0]), (4, [2.0**50, 3.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1, 1]["deviation"] is None and len(got) == 8
    few = [(i, [2.0**40 * i, float(i)]) for i in range(3)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.query(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == 0 and got[0] is None


def test_extra_columns(spark):
    d = spark.createDataFrame([(i, [float(i), float(i * i % 3)], i, "x") for i in range(9)], "vec_id long, embedding array<float>, whitening int, row string")
    out = whitening.transform(d, whitening.fit(d))
    assert out.columns == ["vec_id", "embedding", "row", "whitening"] and {r["row"] for r in out.collect()} == {"x"}
