"""Decontamination: edit distances, recall against brute force, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqrec.llm import decontaminate, queries, words

rng = random.Random(13)
WORDS = [f"{a}{b}{c}" for a in "bdklm" for b in "aeiou" for c in "nrst"]


def prose(n):
    return [rng.choice(WORDS) for _ in range(n)]


def plain_distance(item, text):
    """Fewest edits between the item and any run of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[:], i
        for j, b in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b))
    return min(row)


def edited(item, edits):
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out) or 1)
        kind = rng.randrange(3)
        out[at:at + (kind != 0)] = [] if kind == 2 else ["new" + rng.choice(WORDS)]
    return out


def hashes(tokens):
    return words.of_text(" ".join(tokens))


def test_edit_distance_equals_the_table():
    for _ in range(300):
        item, text = prose(rng.randrange(1, 90))[:rng.choice([3, 20, 90])], prose(rng.randrange(0, 40))
        if rng.random() < 0.7:
            text[5:5] = edited(item, rng.randrange(4))
        assert decontaminate.edit_distance(hashes(item), hashes(text))[0] == plain_distance(item, text)


def test_word_hashes_do_not_depend_on_place_or_case():
    assert (words.of_text("The, ÉTÉ; end") == words.of_text("  the\nété END!")).all()
    data = "one two".encode() + "two".encode()
    found = words.hashed(np.frombuffer(data, np.uint8), np.array([0, 7, 7, 10]))
    assert found.first.tolist() == [0, 2, 2, 3] and found.hashes[1] == found.hashes[2]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_slices_cover_all_texts(monkeypatch, size):
    monkeypatch.setattr(words, "SLICE", size)
    texts = ["", "a b", None, "x" * 500, "é è"] * 5
    array = pa.array(["skipped", *texts])[1:]
    got = [bytes(data[a:b]).decode() for _, data, o in words.slices(array) for a, b in zip(o, o[1:])]
    assert got == [t or "" for t in texts]


def test_recall_and_precision_against_brute_force():
    items = [prose(rng.randrange(8, 70)) for _ in range(120)]
    index = decontaminate.build_index([(i, " ".join(t)) for i, t in enumerate(items)])
    found = wanted = 0
    for share in (0.0, 0.05, 0.1, 0.15, 0.2):
        texts = []
        for item in items:
            text, at = prose(150), rng.randrange(150)
            text[at:at] = edited(item, int(share * len(item)))
            texts.append(text)
        got = decontaminate.matches(index, pa.array([" ".join(t) for t in texts]))
        for i, (matches, text) in enumerate(zip(got, texts)):
            for m in matches:  # whatever is reported is true
                assert m["edits"] == plain_distance(items[m["item_id"]], text) <= index.limits[m["item_id"]] or \
                    plain_distance(items[m["item_id"]], text) <= m["edits"] <= index.limits[m["item_id"]]
            found += any(m["item_id"] == i for m in matches)
            wanted += 1
            if share == 0:
                assert any(m["item_id"] == i and m["edits"] == 0 for m in matches)
    assert found >= 0.95 * wanted


@pytest.mark.parametrize("length", [90, 250, 500, 1000])
def test_recall_of_long_items(length):
    items = [prose(length) for _ in range(24)]
    index = decontaminate.build_index([(i, " ".join(t)) for i, t in enumerate(items)])
    texts = [" ".join([*prose(60), *edited(item, int(0.2 * length)), *prose(60)]) for item in items]
    got = decontaminate.matches(index, pa.array(texts))
    assert sum(any(m["item_id"] == i for m in found) for i, found in enumerate(got)) >= 0.9 * len(items)


def test_clean_text_is_left_alone():
    index = decontaminate.build_index([(i, " ".join(prose(30))) for i in range(50)])
    assert not any(decontaminate.matches(index, pa.array([" ".join(prose(400)) for _ in range(200)])))


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "The house and the garden of the old man"), (2, None), (3, ""), (4, "too short"),
                                   (None, "the HOUSE, and the garden of the old man")], "item_id long, text string")
    found = decontaminate.tagged(odd_docs, items)
    assert found.columns == [*odd_docs.columns, "matches_"] and found.count() == odd_docs.count()
    hit = {(r["doc_id"], m["item_id"], m["edits"]) for r in found.collect() for m in r["matches_"]}
    assert hit == {(d, i, 0) for d in (1, 6) for i in (1, None)}
    kept = decontaminate.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert decontaminate.clean(no_docs, items).count() == 0
    assert decontaminate.clean(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_items_in_blocks_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def hits(**options):
        found = decontaminate.tagged(docs, items, **options).collect()
        return sorted((r["doc_id"], m["item_id"], m["edits"]) for r in found for m in r["matches"])

    assert hits(block_bytes=3000) == hits()


def test_query_finds_every_item_that_is_there_word_for_word(spark, sf_dir):
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontaminate(spark, sf_dir).collect() if r["edits"] == 0}
    plain = lambda t: " " + " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split()) + " "
    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got == {(d, i) for d, t in docs for i, item in items if item in t} and got
