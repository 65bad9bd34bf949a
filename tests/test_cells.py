"""Cells of the top-k retrieval: bundles of blocks, single precision, odd vectors."""

import numpy as np
import pytest

from seqrec.operators import retrieval


def _expected(queries, items, k, excluded):
    with np.errstate(over="ignore", invalid="ignore"):
        found = []
        for q, gone in zip(queries, excluded):
            scores = (q * items).sum(axis=1)
            found.append([i for _, i in sorted((-s, i) for i, s in enumerate(scores.tolist()) if i not in gone and s > -np.inf)[:k]])
    return found


@pytest.mark.parametrize("kind", ["plain", "repeated", "zero", "tiny", "huge", "mixed", "nearly equal"])
@pytest.mark.parametrize("tile", [8, 2048])
def test_single_precision_only_preselects(monkeypatch, kind, tile):
    rng = np.random.default_rng(7)
    items, queries = rng.normal(size=(700, 12)), rng.normal(size=(300, 12))
    if kind == "repeated":
        items = items[rng.integers(0, 9, 700)]
    if kind == "zero":
        items[::2], queries[::3] = 0.0, 0.0
    if kind == "tiny":
        items, queries = items * 1e-150, queries * 1e-120
    if kind == "huge":
        items[5], queries[7] = 1e200, -1e180
    if kind == "mixed":
        items *= 10.0 ** rng.integers(-30, 30, (700, 1))
    if kind == "nearly equal":  # closer to each other than single precision tells
        items = items[:1] + rng.normal(size=(700, 12)) * 1e-11
    excluded = [set(rng.choice(700, 20).tolist()) for _ in queries]
    monkeypatch.setattr(retrieval, "TILE_ITEMS", tile)
    spans = [(0, 300), (300, 301), (301, 700)]
    lists = [np.array(sorted(e) + [10**6]) for e in excluded]
    got = {}
    for row, item, _ in retrieval._best_in_blocks(queries, lists, np.arange(700), items, 6, None, spans):
        for r, i in zip(row.tolist(), item.tolist()):
            got.setdefault(r, []).append(i)
    assert [got.get(r, []) for r in range(300)] == _expected(queries, items, 6, excluded)


@pytest.mark.parametrize("exclude", [None, "history"])
def test_queries_travel_by_bundles(spark, monkeypatch, exclude):
    """Vectors that point anywhere: nearly every block is met, but a query is sent once per bundle."""
    rng = np.random.default_rng(2)
    items, queries = rng.normal(size=(1200, 8)), rng.normal(size=(150, 8))
    gone = [rng.choice(1200, 9).tolist() for _ in queries]
    met, real = [], retrieval._meet
    monkeypatch.setattr(retrieval, "_meet", lambda asked, *rest: (met.append(asked.count()), real(asked, *rest))[1])
    bundled = {"cell_bytes": 400 * 64} if "cell_bytes" in retrieval.top_k.__kwdefaults__ else {}
    found = retrieval.top_k(
        spark.createDataFrame([(u, v.tolist(), g) for u, (v, g) in enumerate(zip(queries, gone))],
                              "user_id long, embedding array<double>, history array<long>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, embedding array<double>"),
        5, exclude=exclude, block_bytes=20 * 64, **bundled).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["user_id"], r["rank"])):
        got.setdefault(r["user_id"], []).append(r["item_id"])
    expected = _expected(queries, items, 5, gone if exclude else [[]] * len(gone))
    assert [got[u] for u in range(150)] == expected
    assert sum(met) <= 150 * 8


def test_only_what_may_be_among_the_best_is_scored_in_doubles(monkeypatch):
    """Products raise the bars, so little more than k pairs per query are scored again."""
    rng = np.random.default_rng(4)
    items, queries = rng.normal(size=(20_000, 16)), rng.normal(size=(100, 16))
    scored, real = [], retrieval._exact
    monkeypatch.setattr(retrieval, "_exact", lambda q, i, row, at: (scored.append(len(row)), real(q, i, row, at))[1])
    found = list(retrieval._best_in_blocks(queries, None, np.arange(20_000), items, 5))
    got = {r: found[0][1][found[0][0] == r].tolist() for r in range(100)}
    assert [got[r] for r in range(100)] == _expected(queries, items, 5, [set()] * 100)
    assert sum(scored) <= 100 * 10
