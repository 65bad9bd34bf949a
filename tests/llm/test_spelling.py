"""Spelling variants: counts, pivots, pairs and forms against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from seqrec.llm import queries, spelling

rng = random.Random(21)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows, every=31, min_chars=7, min_count=2):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if every:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= min_count}


def plain_variants(counts, factor=10):
    """By the words left when one place is cut out: neither grams nor lengths play a part."""
    near, cut, gone = {w: set() for w in counts}, {}, {}
    for w in counts:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1:]
            cut.setdefault((i, rest), []).append(w)
            gone.setdefault(rest, []).append(w)
    for group in cut.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    for rest, group in gone.items():
        for w in group if rest in counts else ():
            near[w].add(rest)
            near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def some_words(n, alphabet, low=7, high=12):
    words = set()
    while len(words) < n:
        base = "".join(rng.choice(alphabet) for _ in range(rng.randrange(low, high)))
        words.add(base)
        for _ in range(rng.randrange(6)):
            w = list(rng.choice([base, rng.choice(sorted(words)[:50])]))
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                w[i:i + (kind != 0)] = [] if kind == 2 else [rng.choice(alphabet)]
            if len(w) >= low:
                words.add("".join(w))
    return sorted(words)


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzßÿ"])
def test_variants_equal_all_pairs(spark, alphabet):
    words = some_words(600, alphabet)
    words += ["a" * n for n in range(7, 14)] + ["ab" * n for n in range(4, 8)]
    counts = {w: rng.choice([2, 3, 25, 30, 300, 4000, 40000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling.variants(df).collect())
    assert got == plain_variants(counts)
    pairs = {(a, b) for a in counts for b in counts if a < b and one_edit(a, b)}
    assert {(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()} == pairs and len(pairs) > 100


def test_pivots_are_the_lightest_disjoint_ones():
    for _ in range(500):
        places = sorted(rng.sample(range(9), rng.randrange(3, 8)))
        weights = [rng.randrange(1, 20) for _ in places]
        found = spelling.pivots(places, weights)
        cost = dict(zip(places, weights))
        legal = [p for p in itertools.combinations(places, 2) if p[1] - p[0] >= 2]
        assert tuple(found) in legal and sum(cost[p] for p in found) == min(sum(cost[p] for p in c) for c in legal)


@pytest.mark.parametrize("block", [16, 1 << 22])
def test_counts(monkeypatch, spark, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "FLUSH", 5)
    pieces = ["Straße", "Été×été", "letters", "LETTERS", "lettérs", "日本語text", "naïveté", "abcdefgh", "x", "𝒳words", "aĀlonger", "'", "-", " ", "\n", "9"]
    texts = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(60))) for i in range(80)]
    texts += [(None, "letters letters"), (5, None), (6, ""), (7, "q" * 3000 + " " + "q" * 3000), (7, "letters")]
    want = plain_counts(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df, slip_every=31).collect()}
    if block == 16:  # blocks are counted apart within tasks only
        monkeypatch.undo()
    assert got == want and len(want) > 20
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == plain_counts(texts, every=None)


def test_blocks_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 5)
    for text in ("ab cdéfgh 日本ij\xa0kl", "é" * 30, "日" * 9, "aĀb" * 7, ""):
        blocks = list(spelling._blocks(text.encode()))
        assert "".join(blocks) == text
        assert [r for b in blocks for r in spelling._RUN.findall(b)] == spelling._RUN.findall(text)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = plain_variants(plain_counts(rows, every=None))
    got = spelling.variants(spelling.word_counts(odd_docs))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(no_docs), factor=1)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_spelling(spark, sf_dir).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in got.collect()) == plain_variants(plain_counts(rows))
