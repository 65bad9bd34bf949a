"""SimHash: fingerprints and components against brute force, skewed graphs, odd rows."""

import random
import re

import pytest
import xxhash

from seqrec.llm import components, queries, simhash

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(60)]


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=2):
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, fa in prints:
        for b, fb in prints:
            if a < b and bin(fa ^ fb).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def texts(n):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 120))))
    return out


def test_fingerprints_equal_plain_ones(monkeypatch):
    cases = ["", " \n\t", "One", "one TWO", "É A\x1fb c\x85d e f g", *texts(60)]
    want = [plain_fingerprint(t) for t in cases]
    assert [simhash.fingerprint(t) for t in cases] == want
    monkeypatch.setattr(simhash, "BLOCK", 7)  # words of many blocks
    assert [simhash.fingerprint(t) for t in cases] == want
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_components_equal_all_pairs(spark, hot_rows):
    rows = list(enumerate(texts(300) + ["", " ", "a b"] + ["same words here again"] * 40))
    rng.shuffle(rows)
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot_rows)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in found.collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = plain_components(prints)
    assert got == {i: (f, want[i]) for i, f in prints}


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_connect_all_near_fingerprints(spark, radius):
    base = [rng.getrandbits(64) for _ in range(15)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(8)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius).collect()
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in found]
    assert all(bin(a ^ b).count("1") <= radius for a, b in edges)
    group = plain_components([(p, p) for p in prints], radius)
    linked = {p: p for p in prints}
    for _ in prints:
        for a, b in edges:
            linked[a] = linked[b] = min(linked[a], linked[b])
    assert linked == group
    with pytest.raises(ValueError):
        simhash.links(found and spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, edges[0], (None, 3)], "x long, y long")
    got = {r["u"]: r["root"] for r in components.components(df, "x", "y").collect()}
    want = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)} | {5001: 5000}
    assert got == want
    assert components.components(df.limit(0), "x", "y").count() == 0


def test_odd_rows(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert got[2] == got[3] == got[4] == 2 and got[6] == got[1] == 1
    assert got[None] is None  # alone, and without an id to name it
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # rows that repeat the id that stays all stay
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 5, 7, 8]
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_one(no_docs).count() == 0


def test_query(spark, sf_dir):
    got = queries.op4_simhash(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    want = plain_components(prints)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {
        (i, f"{f:016x}", want[i]) for i, f in prints}
