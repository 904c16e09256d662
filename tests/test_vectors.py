"""Vector search against all pairs: exact search, measured recall, small blocks."""

import numpy as np
import pytest

from tests.oracle import DATA
from tidemark.operators import vectors
from tidemark.plans.catalogue import QUERIES

SCHEMA = "run_id string, place bigint, embedding array<float>"


def truth(rows, k, apart, first):
    out = {}
    for run, a, va in rows:
        if va is None:
            continue
        found = []
        for other, b, vb in rows:
            bad = b == a if apart == "any" else abs(a - b) <= 1 if apart == "next" else b >= a
            if other == run and vb is not None and not bad:
                x, y = np.array(va, np.float32).astype(float), np.array(vb, np.float32).astype(float)
                size = np.linalg.norm(x) * np.linalg.norm(y)
                found.append((-round(float(x @ y / size), 10) if size else 0.0, b if first else -b))
        if found:
            out[run, a] = [(abs(b), round(-c, 6)) for c, b in sorted(found)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 2
    out = [("large", i, (centres[rng.integers(6)] + rng.normal(size=8)).tolist()) for i in range(260)] + [("small", i, rng.normal(size=8).tolist()) for i in range(9)] + [("one", 4, [1.0] * 8)]
    out += [("large", 300 + i, out[i][2]) for i in range(5)]  # copies tie
    return [*out, ("large", 400, None), ("small", 50, None), ("small", 60, [0.0] * 8)]


@pytest.mark.parametrize(("apart", "first", "k"), [("any", False, 3), ("next", False, 3), ("earlier", True, 1)])
def test_exact_search_equals_all_pairs(spark, rows, monkeypatch, apart, first, k):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    d = spark.createDataFrame(rows, SCHEMA)
    index = vectors.fit(d, whole=20)
    assert len(index.centres) > 10 and index.lists.count() > 12
    got = {}
    for r in vectors.search(index, d, k, apart, first).orderBy("rank").collect():
        got.setdefault((r.run_id, r.a), []).append((r.b, round(r.cosine, 6)))
    assert got == truth(rows, k, apart, first)


def test_no_vectors(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert vectors.search(vectors.fit(d), d).collect() == []
    d = spark.createDataFrame([("r", 1, None), ("r", 2, [1.0])], SCHEMA)
    assert vectors.search(vectors.fit(d), d).collect() == []


def test_bounds_leave_lists_out(spark, rows):
    d = spark.createDataFrame([r for r in rows if r[2] and any(r[2])], SCHEMA)
    index = vectors.fit(d, whole=20)
    asked = vectors.search(index, d.where("place % 10 = 0"), 1, exact=False)
    assert index.probes < len(index.centres) and asked.count() > 20


def test_indexed_search_finds_nine_in_ten(spark):
    exact = {(r.a, r.b) for r in QUERIES["j09_nearest_exact"](spark, DATA).collect()}
    found = {(r.a, r.b) for r in QUERIES["j09_nearest_indexed"](spark, DATA).collect()}
    assert len(exact) == len(found) and len(exact & found) >= 0.9 * len(exact)
