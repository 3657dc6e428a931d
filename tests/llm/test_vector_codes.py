"""Codes and codebooks against Lloyd's rounds with full comparisons, and the defined cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import queries
from loomery.llm import vector_codes as vc
from tests.compare import assert_same

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Every part compared with every entry in every round, in Python integers."""
    kept = [(v, [math.floor(scale * float(np.float32(x))) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    length = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == length]
    width = -(-length // parts)
    cut = [[(e + [0] * parts)[p * width : p * width + width] for p in range(parts)] for _, e, _ in kept]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda k: (far(books[p][k], x), k))
    for _ in range(rounds):
        owned = [[[] for _ in books[p]] for p in range(parts)]
        for v in cut:
            for p in range(parts):
                owned[p][nearest(p, v[p])].append(v[p])
        books = [[[sum(c) // len(xs) for c in zip(*xs)] if xs else books[p][k] for k, xs in enumerate(owned[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for (vec_id, _, label), v in zip(kept, cut):
        code = [nearest(p, v[p]) for p in range(parts)]
        coded.append((vec_id, label, "".join(f"{k:02x}" for k in code), sum(far(books[p][code[p]], v[p]) for p in range(parts))))
    totals = {}
    for _, label, _, error in coded:
        totals[label] = totals.get(label, 0) + error
    return sorted(((v, c, e, totals[label], digest) for v, label, c, e in coded), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def made_rows(seed, n, length=16, coarse=False):
    """Clustered vectors; coarse ones lie on a small grid, so that distances are often equal."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, length))
    e = middles[rng.integers(0, 5, n)] + rng.normal(size=(n, length)) / 3
    if coarse:
        e = np.round(e) / 4096
    return [(int(v), [float(x) for x in row.astype(np.float32)], int(v) % 3 if v % 7 else None) for v, row in zip(rng.permutation(n) * 3, e)]


@pytest.mark.parametrize(("seed", "coarse", "keep_every"), [(1, False, 8), (2, True, 8), (3, True, 2)])
def test_codes_equal_full_comparisons(spark, seed, coarse, keep_every):
    rows = made_rows(seed, 300, coarse=coarse)
    assert rows_of(vc.compress_vectors(spark.createDataFrame(rows, SCHEMA), keep_every=keep_every)) == plain_codes(rows)


def test_bounds_give_the_entries_of_a_full_scan_and_skip_most_groups():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(2000, 2, 4)) * 500 + rng.integers(0, 6, (2000, 1, 1)) * 3000).astype(np.int64)
    history = [x[:16].transpose(1, 0, 2).copy()]
    books = vc.Codebooks(history)
    b = vc.first_bounds(x, books)
    full = b.scanned
    for r in range(1, 9):
        new = history[-1].copy()
        for p in range(2):
            for k in range(16):
                if (b.own[:, p] == k).any():
                    new[p, k] = x[b.own[:, p] == k, p].sum(0) // (b.own[:, p] == k).sum()
        history.append(new)
        before = b.scanned
        vc.next_bounds(x, b, books, r)
        for p in range(2):
            assert (b.own[:, p] == vc.distances(x[:, p], new[p]).argmin(1)).all()
            every = np.sqrt(vc.distances(x[:, p], new[p]).astype(float))
            every[np.arange(2000), b.own[:, p]] = np.inf
            for g in range(books.n_groups):
                members = np.flatnonzero(books.groups[p] == g)
                assert (b.low[:, p, g] <= every[:, members].min(1, initial=np.inf)).all()
    assert b.scanned - before < full / 2


def test_odd_rows(spark):
    rows = made_rows(5, 40, length=13)  # filled up to 16
    rows += [rows[0], (None, rows[1][1], 1), (rows[2][0], rows[3][1], None)]  # repeats, a null id, an id with two vectors
    rows += [(1000, None, 1), (1001, [None] * 13, 1), (1002, [math.nan] * 13, 1), (1003, [math.inf] * 13, 1), (1004, [0.5] * 12, 1), (1005, [], 1)]
    assert rows_of(vc.compress_vectors(spark.createDataFrame(rows, SCHEMA))) == plain_codes(rows)


def test_few_rows_equal_rows_and_clashing_columns(spark):
    few = made_rows(6, 5)
    assert rows_of(vc.compress_vectors(spark.createDataFrame(few, SCHEMA))) == plain_codes(few)
    same = [(v, [0.25] * 16, v % 2) for v in range(30)]
    more = spark.createDataFrame(same, SCHEMA).withColumns({c: F.lit(7) for c in ("ints", "own", "low", "code", "error", "_label", "label_error")})
    assert rows_of(vc.compress_vectors(more)) == plain_codes(same)


def test_nothing_and_numbers_out_of_range(spark):
    assert rows_of(vc.compress_vectors(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(vc.compress_vectors(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA))) == []
    with pytest.raises(ValueError, match="exact"):
        vc.compress_vectors(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))


def test_query_equals_sql(spark):
    assert_same(spark, queries.QUERIES["op12_vector_codes"], queries.ORACLE_SQL["op12_vector_codes"], "/root/testdata/sf0.001")
