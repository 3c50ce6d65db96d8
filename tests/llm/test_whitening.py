import math

import numpy as np
import pytest

from tidemark.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows, components=4):
    """{(id, component): (deviation, whitened)}, eigenvalues and trace by a dense decomposition."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    once = np.array(sorted({tuple(x) for _, x in kept}), dtype=float)
    n = len(once)
    sums = [sum(int(x) for x in column) for column in once.T]
    mean = np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh((once - mean).T @ (once - mean) / n)
    order = np.argsort(values)[::-1][:components]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - mean) @ vectors[:, order] / np.sqrt(values[order])) for i, x in kept]
    return n, out, values[order], values.sum()


def check(found, rows, components=4):
    n, expected, values, trace = plain(rows, components)
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(got) == len(expected) * len(values)
    signs = {}
    for i, deviation, z in expected:
        for k, value in enumerate(z, 1):
            row = got[i, k]
            if k not in signs and abs(value) > 0.05:
                signs[k] = np.sign(value) * np.sign(row["whitened"])
            assert row["n"] == n and row["deviation"] == deviation
            assert abs(row["whitened"] * signs.get(k, 1) - value) < 1e-9 if k in signs else abs(row["whitened"]) < 0.051
            assert abs(row["explained"] - values[k - 1] / trace) < 1e-10
            assert row["identity_error"] < 1e-10


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_query_against_dense_decomposition(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_lanczos_whitening"](spark, SF).collect(), rows)


@pytest.mark.parametrize("width, rows, blocks", [(5, 40, 64), (12, 9, 1 << 16), (3, 200, 48)])
def test_small_matrices(spark, width, rows, blocks, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", blocks)
    draw = np.random.default_rng(width)
    data = [(i, [float(c) for c in draw.normal(size=width) * np.arange(1, width + 1)]) for i in range(rows)]
    data += [(1000 + i, data[0][1]) for i in range(30)]
    check(whitening.whitened(table(spark, data)).collect(), data, min(4, width))


def test_few_steps_are_enough_where_directions_stand_out(spark, monkeypatch):
    draw = np.random.default_rng(0)
    data = [(i, [float(c) for c in draw.normal(size=40) * np.array([900, 300, 90, 30] + [0.05] * 36)]) for i in range(300)]
    steps, summed = [], whitening._summed
    monkeypatch.setattr(whitening, "_summed", lambda *a: steps.append(1) or summed(*a))
    check(whitening.whitened(table(spark, data)).collect(), data)
    assert len(steps) < 30


def test_equal_variances(spark):
    """The corners of a cube: every direction is as good, so only the contract of whitening holds."""
    data = [(i, [float(i >> k & 1) for k in range(6)]) for i in range(64)]
    found = whitening.whitened(table(spark, data)).collect()
    assert len(found) == 256 and {r["component"] for r in found} == {1, 2, 3, 4}
    z = np.zeros((64, 4))
    for r in found:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - 1 / 6) < 1e-10 and r["identity_error"] < 1e-10
    assert np.abs(z.T @ z / 64 - np.eye(4)).max() < 1e-10


def test_low_rank(spark):
    """Two directions only: two components."""
    data = [(i, [float(i % 7), float(i % 5), 2.0 * (i % 7), 1.5]) for i in range(35)]
    check(whitening.whitened(table(spark, data)).collect(), data, 2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i, 0.3 * (i % 3), -0.2 * (i % 4)]) for i in range(12)]
    odd = [(None, [0.5, 0.5, 0.5]), (3, good[4][1]), (50, None), (51, [1.0, None, 2.0]), (52, [nan, 0.0, 0.0]), (53, [0.0, inf, 0.0]), (54, []), (55, [1.0]), (56, [-0.0, 0.0, -0.001])]
    found = whitening.whitened(table(spark, good + odd).selectExpr("*", "1 AS n", "2 AS x", "3 AS data", "'a' AS component")).collect()
    ids = sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found)
    assert len(found) == 3 * 15 and {i for _, i in ids} == {*range(12), 56}
    unique = [(100 + k, v) for k, (_, v) in enumerate(good + [odd[0], odd[1], odd[8]])]
    check(whitening.whitened(table(spark, unique)).collect(), unique, 3)
    floats = whitening.whitened(table(spark, good, "float")).collect()
    assert len(floats) == 36


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whitening.whitened(table(spark, rows)).collect() == []


def test_large_entries(spark):
    data = [(i, [1e15 * i, 3.0 * i * i, 1e15]) for i in range(6)]
    found = whitening.whitened(table(spark, data)).collect()
    assert found and all(r["deviation"] is None for r in found)
    small = [(i, [4e5 * i, 3.0 * i * i]) for i in range(6)]
    check(whitening.whitened(table(spark, small)).collect(), small, 2)
