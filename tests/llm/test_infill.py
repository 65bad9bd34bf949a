"""Fill-in-the-middle: outputs against a plain version, exact round trips, odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqrec.llm import infill, queries, words

rng = random.Random(8)
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    assert "".join(units) == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_text():
    pieces = ["a", "bc", "Ärger", "日本", "𝒳", " ", "  ", "\n", "\t\r\n", "\x0b", "\x0c", "\x85", "\xa0", "<", "<P", "S>", "<X>", "P>", "<S", "M"]
    marks = ["<P>", "<S>", "<M>"] if rng.random() < 0.1 else []
    return "".join(rng.choice(pieces + marks) for _ in range(rng.randrange(0, 30)))


def results(df):
    made = infill.transform(df)
    done = made.select("doc_id", "text", "infill.*", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("back"))
    return done.collect()


def test_equals_plain_version(spark):
    rows = [(i, some_text()) for i in range(3000)] + [(i, w) for i in range(40) for w in ("", "one", " one", "one ", " ", "\n\n")]
    found = results(spark.createDataFrame(rows, "doc_id long, text string"))
    kinds = set()
    for r in found:
        assert tuple(r)[2:7] == plain(r["doc_id"], r["text"]), r
        assert r["back"] == r["text"]
        kinds.add(r["form"])
    assert len(found) == len(rows) and kinds == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_do_not_matter(monkeypatch, size):
    monkeypatch.setattr(words, "SLICE", size)
    texts = pa.array([some_text() for _ in range(200)] + [None, ""])
    drawn = np.array([[rng.getrandbits(32) for _ in range(4)] for _ in range(len(texts))])
    at = 0
    for begin, data, offsets in words.slices(texts):
        assert begin == at
        out, places, _, kind, _, _ = infill.scattered(data, offsets, drawn[at:at + len(offsets) - 1], rate=100)
        back, again = infill.gathered(out, places, kind)
        assert bytes(back) == bytes(data) and list(again) == list(offsets)
        at += len(offsets) - 1
    assert at == len(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("ab <>PSMé\n\t𝒳"), max_size=40),
                          st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), min_size=1, max_size=8))
def test_round_trip(rows):
    ((_, data, offsets),) = words.slices(pa.array([t for t, _ in rows]))
    out, places, *_, = made = infill.scattered(data, offsets, np.array([h for _, h in rows]), rate=100)
    back, again = infill.gathered(out, places, made[3])
    assert bytes(back) == bytes(data) and list(again) == list(offsets)


def test_broken_outputs_fail(spark):
    for output, form in (("<P>a<S>b", "psm"), ("<P>a<S>b<M>c", "spm"), ("x<P>a<S>b<M>c", "psm"), ("abc", "other"), ("abc", None)):
        df = spark.createDataFrame([(output, form)], "o string, f string")
        with pytest.raises(Exception, match="output"):
            df.select(infill.restored(F.col("o"), F.col("f"))).collect()


def test_odd_rows(odd_docs, no_docs):
    wide = odd_docs.selectExpr("*", "1 as infill", "'x' as FORM", "2 as n")
    made = infill.transform(wide)
    assert made.columns == [*wide.columns, "infill_"]
    rows = made.select("doc_id", "text", "infill_.*").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert tuple(r)[2:] == plain(r["doc_id"], r["text"])
    assert infill.transform(no_docs).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"wört{i}" for i in range(600_000))
    rows = results(spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string"))
    assert all(tuple(r)[2:7] == plain(r["doc_id"], r["text"]) and r["back"] == text for r in rows)
    assert {r["form"] for r in rows} > {"plain"}


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op11_infill(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, prefix, middle, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(output), sha(texts[r["doc_id"]]))
