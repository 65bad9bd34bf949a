"""Language identification: against strings and counters, on held-out documents, on odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqrec.llm import langid, queries

rng = random.Random(3)


def plain_profile(text, size):
    """Ranked n-grams by strings; ties by the number the module documents."""
    grams = Counter()
    padded = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i:i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                grams[g] += 1
    number = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    return [number(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], number(x[0])))][:size]


@pytest.mark.parametrize("size", [10, 400])
def test_profiles_equal_plain_counting(size):
    for _ in range(50):
        text = "".join(rng.choice("abcdé ß𝒳, \n1_A") for _ in range(rng.randrange(200)))
        assert langid.ranked(*langid.gram_counts(text), size).tolist() == plain_profile(text, size)


def test_blocks_count_the_whole_text(monkeypatch):
    text = "one two three four five six " * 50
    whole = dict(zip(*map(list, langid.gram_counts(text))))
    monkeypatch.setattr(langid, "BLOCK", 28)
    assert dict(zip(*map(list, langid.gram_counts(text)))) == whole


def test_fit_and_predict_equal_plain_distance(spark):
    texts = {"aa": ["abab abba", "bab aab"], "bb": ["xyxy yxx zz", "zyx"]}
    docs = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts] + [("qq", None)],
                                 "text string, lang string")
    profiles = langid.fit(docs, size=20)
    want = {lang: plain_profile(" 1 ".join(ts), 20) for lang, ts in texts.items()}
    assert profiles.grams == want
    for text in ("abba x", "zz y", "q", "abxy"):
        own = plain_profile(text, 20)
        distance = {lang: sum(abs(i - p.index(g)) if g in p else 20 for i, g in enumerate(own)) for lang, p in want.items()}
        best = min(sorted(distance), key=distance.get)
        assert profiles.classifier().predict(text) == (best, pytest.approx(1 - distance[best] / (20 * len(own))))


def test_held_out_documents(spark, sf_dir):
    found = queries.op3_language_id(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right = found.join(labels, "doc_id").filter("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right[1] > 20 and right[0] >= 0.95 and 0 <= right[2] <= right[3] <= 1


def test_held_out_labels_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(langid.learnable(docs), F.col("lang")).otherwise(F.lit("zz")))
    assert langid.fit(docs.filter(langid.learnable(docs))) == langid.fit(other.filter(langid.learnable(other)))


def test_odd_rows(odd_docs, no_docs):
    profiles = langid.fit(odd_docs)
    assert "xx" not in profiles.grams  # no letter, no n-gram
    found = langid.identify(odd_docs, profiles)
    assert found.columns == [*odd_docs.columns, "lang_pred_", "score_"]
    got = {(r["doc_id"], r["text"]): (r["lang_pred_"], r["score_"]) for r in found.collect()}
    assert found.count() == odd_docs.count()
    for key, (lang, score) in got.items():
        letters = any(c.isalpha() for c in key[1] or "")
        assert (lang == "und" and score == 0) if not letters else (lang in profiles.grams and 0 <= score <= 1)
    nothing = langid.fit(no_docs)
    assert nothing.grams == {} and langid.identify(no_docs, nothing).count() == 0
    assert {r["lang_pred_"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_only_letters_count(monkeypatch):
    for text in ("½", "² ③", "①", "Ⅷ", "१२", "_", "1 2", "٣"):
        assert not len(langid.gram_counts(text)[0])
    assert len(langid.gram_counts("ª")[0]) and len(langid.gram_counts("½ a")[0])
    text = "der haus² und ½ abc 日本" * 40
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, langid.gram_counts(text)))
