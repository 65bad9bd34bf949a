"""Exact top-k: against all pairs, on odd vectors."""

import math
import random

import numpy as np
import pytest

from seqrec.llm import topk

rng = random.Random(11)
SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(64 * float(np.float32(x))) for x in v]
        best[i] = min(best.get(i, ints), ints)
    out = []
    for q, a in best.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in best.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def rows(n, dim=12):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


def got(df, k, every, **options):
    found = topk.top_k(df.filter(f"vec_id % {every} = 0"), df, k, **options)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


@pytest.mark.parametrize("blocks", [{}, {"query_block": 16, "candidate_block": 50}, {"pivots": 1}])
def test_equals_all_pairs(spark, blocks):
    some = rows(700)
    assert got(spark.createDataFrame(some, SCHEMA), 9, 7, **blocks) == plain(some, 9, 7)


def tables(some, every):
    import pyarrow as pa

    ids = np.array([i for i, _ in some])
    vectors = np.floor(64 * np.array([v for _, v in some], np.float32).astype(float))
    pivots = vectors[:40]
    near = topk._to_pivots(vectors, pivots).argmin(axis=1)
    table = pa.table({"id": ids, "v": list(vectors), "near": near, "least": np.full(len(ids), -np.inf)})
    return table.filter(pa.array(ids % every == 0)), table, pivots


def test_a_cell_is_searched_in_groups(monkeypatch):
    some = rows(2000, 4)
    queries, candidates, pivots = tables(some, 5)
    products, real = [], np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda a, b, **kw: (products.append(len(a) * len(b)), real(a, b, **kw))[1])
    found = sorted(zip(*topk._cell(queries, candidates, pivots, 5)))
    assert found == sorted((q, i, s) for q, _, i, s in plain(some, 5, 5))
    assert sum(products) < 0.7 * queries.num_rows * candidates.num_rows


def test_most_cells_never_meet_on_clustered_data(spark):
    """Far clusters: a block of queries meets the blocks of its own cluster only."""
    centres = [[rng.gauss(0, 10) for _ in range(16)] for _ in range(40)]
    some = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(4000)]
    df = spark.createDataFrame(some, SCHEMA)
    met, real, every, bounds = [], topk._meet, [], topk.cells
    try:
        topk._meet = lambda chosen, *rest: (met.append(chosen.count()), real(chosen, *rest))[1]
        topk.cells = lambda *args: (every.append(bounds(*args).count()), bounds(*args))[1]
        found = got(df, 5, 20, query_block=20, candidate_block=100)
    finally:
        topk._meet, topk.cells = real, bounds
    assert found == plain(some, 5, 20)
    # a block of queries holds about five of the forty clusters
    assert sum(met) < 0.5 * every[0]


def test_copies_and_ties(spark):
    """Very many equal vectors in one group: parts by a hash, ties to the smaller id."""
    some = [(i, [1.0, 0.0, 0.5]) for i in range(900)] + [(1000 + i, [0.2, 0.1 * i, 0.0]) for i in range(30)]
    rng.shuffle(some)
    assert got(spark.createDataFrame(some, SCHEMA), 7, 50, query_block=8, candidate_block=64) == plain(some, 7, 50)


def test_odd_vectors(spark):
    some = [*rows(60, 3), (100, None), (101, [1.0, None, 2.0]), (102, [math.nan, 1.0, 1.0]), (103, [math.inf, 0.0, 0.0]),
            (None, [1.0, 1.0, 1.0]), (104, []), (105, [0.5]), (110, [2.0, 2.0, 2.0, 2.0]), (0, [9.0, 9.0, 9.0]),
            (111, [1.0, 1.0, 1.0]), (112, [1.0, 1.0, 1.0]), (112, [1.0, 1.0, 1.0])]
    assert got(spark.createDataFrame(some, SCHEMA), 20, 5) == plain(some, 20, 5)
    few = some[:3]
    assert got(spark.createDataFrame(few, SCHEMA), 20, 1) == plain(few, 20, 1)
    assert got(spark.createDataFrame([], SCHEMA), 20, 1) == []
    assert got(spark.createDataFrame([(5, [1.0])], SCHEMA), 20, 1) == []


def test_large_components_are_exact(spark):
    some = [(i, [float(np.float32(rng.uniform(-1e6, 1e6))) for _ in range(3)]) for i in range(30)]
    assert got(spark.createDataFrame(some, SCHEMA), 4, 3) == plain(some, 4, 3)


def test_other_columns_may_have_any_name(spark):
    df = spark.createDataFrame(rows(50, 3), SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as d", "4 as block")
    assert len(got(df, 3, 10)) == 15
