"""Whitening and product codes of embeddings, against plain versions in exact numbers."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tesselith.llm import code_compression, queries, vectors, whitening

TABLE = "vec_id bigint, embedding array<float>, label int, vector string, n int, code string"


def table(spark, rows):
    """Rows of (vec_id, embedding, label), with further columns whose names clash."""
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], TABLE).repartition(3)


def odd_rows(d, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=d)], int(i % 3)) for i in range(80)]
    rows += [rows[5], (None, rows[7][1], None), (900, None, 1), (901, [None] + [0.5] * (d - 1), 1), (902, [math.nan] + [0.5] * (d - 1), 1), (903, [math.inf] + [0.5] * (d - 1), None), (904, [1.0], 2), (905, [], 2)]
    return rows, [x for x in rows if x[1] and len(x[1]) == d and all(c is not None and math.isfinite(c) for c in x[1])]


def test_whitening_equals_exact_covariances(spark):
    rows, kept = odd_rows(16)
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in kept]
    n, d = len(x), 16
    sums = [sum(r[i] for r in x) for i in range(d)]
    exact = np.array([[float(sum((Fraction(n * r[i] - sums[i])) * (n * r[j] - sums[j]) for r in x) / n**3) for j in range(d)] for i in range(d)])
    whole = vectors.kept(table(spark, rows).select("vec_id", "embedding"))
    model = whitening.fit(whole.where("size(vector) = 16"), d)
    assert model.n == n and list(model.sums) == sums
    values = np.sort(np.linalg.eigvalsh(exact))[::-1]
    np.testing.assert_allclose(model.values, values, rtol=1e-11)
    np.testing.assert_allclose(model.directions @ np.diag(model.values) @ model.directions.T, exact, atol=1e-9)
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == n * d and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append((r.whitened, r.deviation, r.explained))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-10
    for vec_id, own in zip((k[0] for k in kept), x, strict=True):
        assert {v[1] for v in by[vec_id][1]} == {sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))}
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(own, sums, strict=True)])
        for k in range(d):
            assert min(abs(v[0] - centred @ model.directions[:, k] / math.sqrt(model.values[k])) for v in by[vec_id][k + 1]) < 1e-9


def test_squares_of_large_numbers_are_exact():
    x = np.array([[2**26, -(2**26), 1], [2**26 - 1, 2**26, -5]] * 300)
    got = whitening._squares(x)
    for (i, j), total in got.items():
        assert total == sum((int(r[i]) + (int(r[j]) if j != i else 0)) ** 2 for r in x)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0] * 16, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 16, None)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


def test_directions_without_variance_are_left_out(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(a), float(a), float(b), 3.0], 0) for i, (a, b) in enumerate(r.normal(size=(50, 2)))]
    assert {r.component for r in whitening.whiten(table(spark, rows)).collect()} == {1, 2}


def test_huge_entries_have_null_deviations(spark):
    rows = [(i, [3e38 if i % 2 else -3e38, float(i)], 0) for i in range(100)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 200 and {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)


def by_brute_force(kept, parts, entries, rounds):
    """Codes, errors and codebooks in plain Python."""
    size = len(kept[0][1]) // parts
    x = [[math.floor(256 * c) for c in r[1]] for r in kept]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = [v for _, _, v in sorted((r[0] is None, (r[0] or 0, r[1]), v) for r, v in zip(kept, x, strict=True))][:entries]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    way = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda v, p: min((way(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        given = [[[] for _ in b] for b in books]
        for v in x:
            for p in range(parts):
                given[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for own, e in zip(g, b, strict=True)] for g, b in zip(given, books, strict=True)]
    found = [[near(v, p) for p in range(parts)] for v in x]
    errors = [sum(f[0] for f in row) for row in found]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{f[1]:02x}" for f in row), e, by_label[r[2]], digest) for r, row, e in zip(kept, found, errors, strict=True)]


@pytest.mark.parametrize("entries", [64, 5])
def test_codes_equal_brute_force(spark, entries):
    rows, kept = odd_rows(32)
    got = [tuple(r) for r in code_compression.compress(table(spark, rows), entries=entries).collect()]
    assert sorted(got, key=str) == sorted(by_brute_force(kept, 16, entries, 2), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0] * 15, 1)]])
def test_nothing_to_code(spark, rows):
    assert code_compression.compress(table(spark, rows)).collect() == []


def test_fewer_rows_than_entries_and_ties(spark):
    rows = [(i, [float(i // 2)] * 16, None) for i in range(6)]
    got = {r.vec_id: r.code for r in code_compression.compress(table(spark, rows), rounds=0).collect()}
    assert got == {i: f"{i // 2 * 2:02x}" * 16 for i in range(6)}


@pytest.mark.parametrize("spread", [2, 50, 1 << 26])
def test_the_tree_finds_the_nearest_entry_and_passes_subtrees_over(spread):
    r = np.random.default_rng(spread)
    for size, n in ((4, 64), (1, 30), (3, 256), (2, 1), (4, 9)):
        entries = r.integers(-spread, spread, (n, size))
        entries[n // 2 :] //= 7
        queries_ = np.concatenate([r.integers(-spread, spread, (400, size)), entries])
        tree = code_compression.Gnat.over(entries)
        at, way, taken = code_compression.nearest(entries, tree, queries_)
        ways = code_compression.squared(queries_, entries)
        assert (at == np.argmin(ways, axis=1)).all() and (way == ways.min(axis=1)).all()
        if size == 4 and n == 64 and spread > 2:
            assert taken < 0.8 * ways.size


def test_no_queries():
    entries = np.arange(20).reshape(-1, 2)
    assert [len(x) for x in code_compression.nearest(entries, code_compression.Gnat.over(entries), entries[:0])[:2]] == [0, 0]


def test_queries_on_the_smallest_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    got = [tuple(r) for r in queries.op13_code_compression(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(by_brute_force([(r.vec_id, r.embedding, r.label) for r in rows], 16, 64, 2))
    white = queries.op12_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(white) == 32 * len(rows) and max(r.identity_error for r in white) < 1e-10
