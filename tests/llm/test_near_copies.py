"""Near copies by ball hashing: components against brute-force Jaccard over five-word shingles, large groups, odd rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from seqrec.llm import linking, near_copies

from .test_minhash import families, plain_rows, plain_set, tested, with_passage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("crowd", [4, 2048])
def test_stage_reaches_similarity_of_four_fifths(spark, crowd):
    rows = families(random.Random(3), 60, 5, 60, 240, 5) + [(1000, None), (1001, " "), (1002, "a b"), (1003, "A  b"), (1004, "a c")]
    plain, pairs = plain_rows(rows, n=5, empty_alike=True)
    want = {i: c for i, _, c in plain}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, crowd=crowd).collect()}
    assert len(pairs) > 150 and len(found) == len(rows)
    # nothing is joined that is not near; nearly all pairs are joined
    assert all(want[i] == want[c] for i, c in found.items())
    by_set = {plain_set(t, 5): i for i, t in rows}
    assert sum(found[by_set[a]] == found[by_set[b]] for a, b in pairs) >= 0.98 * len(pairs)
    if crowd > 4:
        assert set(found.values()) == {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}


def test_one_chain(spark):
    """Every text is near its neighbours in the chain only; all are one component."""
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(150):
        base[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(base)))
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


def test_large_group_around_the_limit(spark):
    rows = families(random.Random(12), 1, 400, 200, 201, 9)
    plain, pairs = plain_rows(rows, n=5)
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, c) for i, _, c in plain)
    assert 0.02 < len(pairs) / (400 * 399 / 2) < 0.95


def test_pairs_of_a_common_passage_grow_with_the_texts(spark, monkeypatch, crowd=2048):
    """400 texts with a passage at similarity 0.6: a fingerprint alone would propose most of their 79,800 pairs."""
    counted = []
    for n in (200, 400):
        tried, real = [], linking.Corpus.confirmed
        monkeypatch.setattr(linking.Corpus, "confirmed", lambda self, lists, wanted: (tried.append(tested(lists)), real(self, lists, wanted))[1])
        rows = list(enumerate(with_passage(random.Random(n), n, 75, 25)))
        got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
        monkeypatch.undo()
        assert all(r["component_id"] == r["doc_id"] for r in got)
        counted.append(sum(tried))
    assert counted[0] <= 200 and counted[1] <= 400


def test_chance_to_meet():
    """Fingerprints of signatures that agree with chance 0.8 meet as often as the docstring says."""
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, (20000, near_copies.PRINTS * (near_copies.BITS + 1))).astype(np.uint16)
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 1 << 16, one.shape)).astype(np.uint16)
    met = near_copies._shared(one, two)
    assert 0.53 < met.mean() < 0.56 and met.any(axis=1).mean() > 0.997
    a, b = near_copies.fingerprints(one), near_copies.fingerprints(two)
    bits = np.array([[int(x ^ y).bit_count() for x, y in zip(r, s)] for r, s in zip(a[:500], b[:500])])
    same = (a[:500] >> near_copies.BITS) == (b[:500] >> near_copies.BITS)
    assert np.array_equal(same & (bits <= near_copies.RADIUS), met[:500])


def test_odd_rows(odd_docs, no_docs):
    kept = near_copies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 5, 7, 8]
    assert near_copies.near_copies(no_docs).count() == near_copies.keep_one(no_docs).count() == 0


def test_a_cell_gives_fewer_links_than_sets(spark):
    """All pairs of a group of equal sets and one set apart: enough links to connect them, not one per pair."""
    sets = [(i, list(range(40)) + ([100 + i] if i else [])) for i in range(30)] + [(30, list(range(200, 240)))]
    lists = spark.createDataFrame([(7, a, list(range(a + 1, 31))) for a in range(30)], "cell long, a long, others array<long>")
    wanted = spark.createDataFrame([(7, i) for i in range(31)], "cell long, tid long")
    rule = linking.Rule(linking.Sketch(5, 168), 4, 5)
    found = linking._confirmed(lists, wanted, spark.createDataFrame(sets, "tid long, shingles array<long>"), rule).collect()
    assert len(found) == 29 and {i for r in found for i in (r["a"], r["b"])} == set(range(30))
