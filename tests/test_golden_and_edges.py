"""Golden metric values and the small edge cases of each operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrec.functions import arrays, scores, vectors
from seqrec.operators import (
    clean,
    examples,
    features,
    ids,
    item_text,
    losses,
    metrics,
    negatives,
    quantizer,
    rerank,
    retrieval,
    semantic_ids,
    sequences,
)


def row(df):
    return df.collect()[0].asDict()


# metrics

def test_retrieval_metrics_golden(spark):
    lists = spark.createDataFrame([([1, 2, 3], 2), ([4, 5, 6], 6), ([7, 8, 9], 3)],
                                  "top_k array<long>, target long")
    got = row(metrics.retrieval(metrics.target_ranks_wide(lists), [1, 2, 3], 3))
    want = {"ndcg_at_1": 0, "ndcg_at_2": 0.2103, "ndcg_at_3": 0.3770, "hr_at_1": 0,
            "hr_at_2": 0.3333, "hr_at_3": 0.6667, "mrr": 0.3611}
    assert got == pytest.approx(want, abs=5e-5)


def test_serendipity_metrics_golden(spark):
    schema = "top_k array<long>, target long, target_ser_label int"
    lists = spark.createDataFrame([([11, 12, 13], 11, 1), ([21, 22, 23], 22, 1),
                                   ([31, 32, 33], 99, 1)], schema)
    got = row(metrics.serendipity(metrics.target_ranks_wide(lists), [1, 2, 3], 3))
    want = {"ndcg_ser_at_1": 1 / 3, "ndcg_ser_at_2": 0.5436433, "ndcg_ser_at_3": 0.5436433,
            "hr_ser_at_1": 1 / 3, "hr_ser_at_2": 2 / 3, "hr_ser_at_3": 2 / 3}
    assert got == pytest.approx(want, abs=1e-5)
    none = spark.createDataFrame([([1, 2, 3], 1, 0)], schema)
    got = row(metrics.serendipity(metrics.target_ranks_wide(none), [1, 2, 3], 3))
    assert set(got.values()) == {0.0}


def test_long_and_wide_ranks_agree(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)],
                                   "user_id long, rank int, item_id long")
    targets = spark.createDataFrame([(1, 6), (2, 9), (3, 1)], "user_id long, target_ids long")
    got = {r["user_id"]: r["rank"] for r in metrics.target_ranks(targets, ranked, 2).collect()}
    assert got == {1: 2, 2: 3, 3: 3}


@pytest.mark.parametrize("cutoffs", [[], [0], [4]])
def test_cutoffs_are_checked(cutoffs):
    with pytest.raises(ValueError):
        metrics.check_cutoffs(cutoffs, 3)


def test_auroc_and_precision_with_ties(spark):
    values = [(0, 0.9), (0, 0.4), (1, 0.4), (1, 0.1), (0, 0.7), (1, 0.7)]
    df = spark.createDataFrame([(y, [s, 1 - s]) for y, s in values], "y int, s array<double>")
    got = {r["class"]: r for r in metrics.ranking_quality(df, F.col("s"), F.col("y")).collect()}
    for c in (0, 1):
        pos = [s if c == 0 else 1 - s for y, s in values if y == c]
        neg = [s if c == 0 else 1 - s for y, s in values if y != c]
        wins = [1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg]
        assert got[c]["auroc"] == pytest.approx(sum(wins) / len(wins))
        total = 0.0
        for t in set(pos):
            seen = sum(p >= t for p in pos)
            total += pos.count(t) * seen / (seen + sum(n >= t for n in neg))
        assert got[c]["ap"] == pytest.approx(total / len(pos))


# cleaning

def test_flags_in_any_case(spark):
    df = spark.createDataFrame([("true", None), ("TRUE", ""), ("False", "x"), (None, None)],
                               "a string, b string")
    assert [r["ser_label"] for r in clean.any_flag_label(df, ["a", "b"]).collect()] == [1, 1, 0, 0]
    with pytest.raises(ValueError):
        clean.any_flag_label(df, ["a", "missing"])


def test_bad_numbers(spark):
    df = spark.createDataFrame([("4.5", "1"), ("x", "2"), ("", "3"), (None, "4"), ("2", "z")],
                               "rating string, ts string")
    kinds = {"rating": "double", "ts": "long"}
    assert [tuple(r) for r in clean.lenient_numbers(df, kinds).collect()] == [(4.5, 1)]
    assert row(clean.invalid_numbers(df, kinds)) == {"invalid_rating": 3, "invalid_ts": 1}
    with pytest.raises(Exception, match="not numeric"):
        clean.strict_numbers(df, kinds).collect()


def test_presence_is_counted_once(spark):
    # item b has 2 rows before the filter and 1 after it: it stays
    rows = [("u", "a"), ("u", "b"), ("v", "b"), ("w", "a"), ("w", "a"), ("u", None)]
    df = spark.createDataFrame(rows, "user_id string, item_id string")
    got = sorted(map(tuple, clean.min_presence(df, 2).collect()))
    assert got == [("u", "a"), ("u", "b"), ("w", "a"), ("w", "a")]
    assert clean.min_presence(df, 9).count() == 0


def test_leaks_ignore_case_and_repeats(spark):
    df = spark.createDataFrame([("U1", "straße", 1), ("u2", "b", 2)],
                               "user_id string, item_id string, v int")
    held = spark.createDataFrame([("u1", "STRASSE"), ("U1", "strasse"), ("zz", "b")],
                                 "user_id string, item_id string")
    assert [r["v"] for r in clean.remove_leaks(df, held).collect()] == [2]


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_leaks_with_a_hot_pair(spark, hot_rows):
    df = spark.range(500).select(
        F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        F.when(F.col("id") < 200, "i").otherwise(F.col("id").cast("string")).alias("item_id"), "id")
    held = spark.createDataFrame([("hot", "i"), ("300", "300"), ("301", "x")],
                                 "user_id string, item_id string")
    got = sorted(r["id"] for r in clean.remove_leaks(df, held, hot_rows=hot_rows).collect())
    assert got == [i for i in range(200, 500) if i != 300]


# ids

def keys_of(spark, values, **options):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k string, ord long")
    return ids.raw_keys(df, "k", ["ord"], **options)


def lookup_rows(lookup):
    return sorted((r["normalized_id"], r["original_id"]) for r in lookup.collect())


def test_folded_ids_keep_the_first_spelling(spark):
    values = ["A", "a", "STRASSE", None, "straße", "ΟΔΟΣ", "οδος", "b"]
    got = lookup_rows(ids.assign_ids(keys_of(spark, values, fold=True)))
    assert got == [(0, "A"), (1, "STRASSE"), (2, "ΟΔΟΣ"), (3, "b")]


def test_incremental_ids_continue(spark):
    old = ids.assign_ids(keys_of(spark, ["a", "b", "c"], fold=True))
    got = lookup_rows(ids.assign_ids(keys_of(spark, ["d", "B", "e", "a"], fold=True), old))
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    empty = old.limit(0)
    assert lookup_rows(ids.assign_ids(keys_of(spark, ["x"]), empty)) == [(0, "x")]


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_encode_drops_unknown_values(spark, hot_rows):
    lookup = ids.assign_ids(keys_of(spark, ["a", "B"], fold=True))
    df = spark.createDataFrame([("A", 1), ("b", 2), ("zz", 3), (None, 4)], "k string, v int")
    got = sorted(map(tuple, ids.encode(df, "k", lookup, fold=True, hot_rows=hot_rows).collect()))
    assert got == [(0, 1), (1, 2)]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_ids_do_not_depend_on_partitions(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(0, 3000, 1, partitions).select(
            F.pmod(F.xxhash64("id"), F.lit(700)).cast("string").alias("k"), F.col("id").alias("ord"))
        got = ids.assign_ids(ids.raw_keys(df, "k", ["ord"]))
        numbers = {r["original_id"]: r["normalized_id"] for r in got.collect()}
        order = [r["k"] for r in df.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert numbers == {k: i for i, k in enumerate(dict.fromkeys(order))}


# sequences and examples

def ratings_of(spark, lengths):
    rows = [(u, 100 * u + i, float(i % 5) + 0.5, i // 2, i, i % 2)
            for u, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(
        rows, "user_id long, item_id long, rating double, ts long, ord long, ser_label int")


def test_ties_keep_input_order(spark):
    df = ratings_of(spark, {1: 5}).orderBy(F.desc("ord"))
    chunks = sequences.chunked(sequences.positions(df))
    assert [e["item_id"] for e in chunks.first()["seq"]] == [100, 101, 102, 103, 104]


@pytest.mark.parametrize("skip", [0, 1])
@pytest.mark.parametrize("chronological", [True, False])
def test_example_lengths(spark, skip, chronological):
    n = 4
    lengths = {i: i for i in (1, 2, 3, 4, 5, 6, 7)}
    got = {r["user_id"]: r for r in examples.build(
        ratings_of(spark, lengths), max_length=n, ignore_last_n=skip,
        chronological=chronological).collect()}
    assert set(got) == {u for u in lengths if u > skip}
    for user, e in got.items():
        kept = [100 * user + i + 1 for i in range(user - skip)]
        history = kept[:-1][-n:]
        if not chronological:
            history = history[::-1]
        assert e["target_ids"] == kept[-1]
        assert e["history_lengths"] == len(history)
        assert e["historical_ids"] == history + [0] * (n - len(history))
        assert len(e["historical_ratings"]) == n
    needed = examples.build(ratings_of(spark, lengths), max_length=n, ignore_last_n=skip,
                            require_history=True)
    assert needed.count() == len([u for u in lengths if u > skip + 1])


def test_integer_ratings_truncate(spark):
    e = examples.build(ratings_of(spark, {1: 4}), max_length=3, int_ratings=True).first()
    assert e["historical_ratings"] == [2, 1, 0] and e["target_ratings"] == 3.5


def test_sampling_is_repeatable_and_about_right(spark):
    df = ratings_of(spark, {u: 60 for u in range(1, 30)})
    options = dict(max_length=200, sample_ratio=0.3, pad=False)
    first = examples.build(df, seed=5, **options).collect()
    again = examples.build(df.repartition(7), seed=5, **options).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    kept = sum(r["history_lengths"] + 1 for r in first)
    assert 0.2 < kept / (29 * 60) < 0.4


def test_text_form_round_trip(spark):
    df = spark.createDataFrame([(1, "4", "4.5"), (2, "1,2", "1.0, 2.0"), (3, "", "")],
                               "user_id long, a string, b string")
    spec = {"a": ("item_id", "long"), "b": ("rating", "double")}
    got = {r["user_id"]: [tuple(e) for e in r["seq"]]
           for r in sequences.from_strings(df, spec).collect()}
    assert got == {1: [(4, 4.5)], 2: [(1, 1.0), (2, 2.0)], 3: []}
    uneven = spark.createDataFrame([(1, "4,5", "4.5")], "user_id long, a string, b string")
    with pytest.raises(Exception, match="differ in length"):
        sequences.from_strings(uneven, spec).collect()


def test_array_functions(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    got = df.select(
        arrays.drop_last(F.col("a"), 5), arrays.take_last(F.col("a"), 2),
        arrays.take_first(F.col("a"), 2), arrays.pad_right(F.col("a"), 5, F.lit(0)),
        arrays.pad_right(F.col("a"), 2, F.lit(0)), arrays.duplicate_each(F.col("a")),
        arrays.value_at_last(F.col("a"), F.lit(0))).first()
    assert list(got) == [[], [2, 3], [1, 2], [1, 2, 3, 0, 0], [1, 2, 3], [1, 1, 2, 2, 3, 3], None]


# features

def test_time_buckets(spark):
    gaps = [0, 1, -1, 2, 100, -86400, 10**15, 10**18]
    df = spark.createDataFrame([(g,) for g in gaps], "g long")
    got = [r[0] for r in df.select(features.time_bucket(F.col("g"))).collect()]
    assert got == [min(128, int(math.log(max(abs(g), 1)) / 0.301)) for g in gaps]


def test_user_features_check_their_range(spark):
    df = spark.createDataFrame([(1, 5)], "a int, b int")
    built = features.user_feature_vector(df, {"a": ("onehot", 3), "b": ("index", 6)})
    assert built.first()["features"] == [0.0, 1.0, 0.0, 5.0]
    with pytest.raises(Exception, match="outside"):
        features.user_feature_vector(df, {"b": ("index", 5)}).collect()
    with pytest.raises(ValueError):
        features.user_feature_vector(df, {"b": ("other", 5)})


def test_hashed_values_are_bounded(spark):
    df = spark.createDataFrame([([str(i) for i in range(40)],), (["a"],)], "v array<string>")
    for method in ("xxhash64", "md5"):
        got = [r[0] for r in df.select(features.hashed_values(F.col("v"), 63, method=method)).collect()]
        assert [g["length"] for g in got] == [16, 1]
        assert all(len(g["values"]) == 16 and 0 <= min(g["values"]) <= max(g["values"]) < 63 for g in got)


def test_padding_has_a_zero_vector(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (0, [9.0, 9.0])], "item_id long, embedding array<double>")
    ev = spark.createDataFrame([(0,), (1,), (7,)], "item_id long")
    got = {r["item_id"]: r["embedding"] for r in features.attach_vectors(ev, table, 2).collect()}
    assert got == {0: [0.0, 0.0], 1: [1.0, 2.0], 7: [0.0, 0.0]}


# vectors and scores

def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()]
    assert got == [[0.0, 0.0], pytest.approx([0.6, 0.8])]


def test_scores_are_stable(spark):
    xs = [-800.0, -3.0, 0.0, 2.5, 800.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(scores.softplus(F.col("x")).alias("p"), scores.sigmoid(F.col("x")).alias("s")).collect()
    assert [r["p"] for r in got] == pytest.approx([np.logaddexp(0, x) for x in xs])
    assert [r["s"] for r in got] == pytest.approx([0.0, 1 / (1 + math.exp(3)), 0.5,
                                                   1 / (1 + math.exp(-2.5)), 1.0], abs=1e-12)


# negatives and losses

def test_negatives_are_in_the_universe_and_repeatable(spark):
    pos = spark.range(200).select(F.col("id").alias("user_id"), F.lit(0).alias("pos"),
                                  (F.col("id") % 9 + 1).alias("item_id"))
    drawn = negatives.uniform(pos, 9, 16, seed=1)
    rows = sorted(map(tuple, drawn.collect()))
    assert rows == sorted(map(tuple, negatives.uniform(pos.repartition(5), 9, 16, seed=1).collect()))
    assert {r[-1] for r in rows} == set(range(1, 10))
    batch = negatives.in_batch(pos, 3, 4).collect()
    members = {}
    for r in batch:
        members.setdefault(r["batch"], set()).add(r["item_id"])
    assert len(batch) == 600 and all(r["negative_id"] in members[r["batch"]] for r in batch)


def test_losses_skip_collisions_and_zero_weights(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, 1.0, True), (2, 2.0, 5.0, 1.0, False)],
                               "k int, pos_logit double, neg_logit double, weight double, is_valid boolean")
    want = 0.5 * (math.log1p(math.exp(-2.0)) + math.log1p(math.exp(1.0)))
    assert losses.bce(df).first()["loss"] == pytest.approx(want)
    assert losses.bce(df.withColumn("weight", F.lit(0.0))).first()["loss"] is None
    soft = losses.sampled_softmax(df, ["k"]).first()["loss"]
    assert soft == pytest.approx(0.5 * math.log(1 + math.exp(-1.0)))


@pytest.mark.parametrize("call", [
    lambda d: losses.focal(d, gamma=-1), lambda d: losses.focal(d, alpha=2.0),
    lambda d: losses.probability_bce(d, eps=0.7), lambda d: losses.serendipity_bce(d, reduction="no")])
def test_loss_arguments_are_checked(spark, call):
    df = spark.createDataFrame([(1.0, 1, 0.5)], "ser_logit double, ser_label int, probability double")
    with pytest.raises(ValueError):
        call(df)


def test_loss_reductions(spark):
    df = spark.createDataFrame([(1.0, 1), (-2.0, 0), (0.5, 0)], "ser_logit double, ser_label int")
    each = [math.log1p(math.exp(-1.0)), math.log1p(math.exp(-2.0)), math.log1p(math.exp(0.5))]
    assert losses.serendipity_bce(df, reduction="sum").first()["loss"] == pytest.approx(sum(each))
    masked = losses.serendipity_bce(df, mask=F.col("ser_label") == 5)
    assert masked.first()["loss"] == 0.0


# retrieval

@pytest.fixture(scope="module")
def vector_tables(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    items = [(i + 1, base[i % 40].tolist()) for i in range(130)]  # copies: equal scores
    queries = [(u, rng.normal(size=8).tolist(), sorted(rng.choice(130, 12, replace=False) + 1))
               for u in range(60)]
    queries = [(u, v, [int(x) for x in h] + [0, 999]) for u, v, h in queries]
    return (spark.createDataFrame(queries, "user_id long, embedding array<double>, history array<long>"),
            spark.createDataFrame(items, "item_id long, embedding array<double>"), queries, items)


@pytest.mark.parametrize("block_bytes", [500, 3000, 10**8])
@pytest.mark.parametrize("exclude", [None, "history"])
def test_topk_in_any_blocking(vector_tables, block_bytes, exclude):
    queries, items, query_rows, item_rows = vector_tables
    got = {}
    for r in retrieval.top_k(queries, items, 15, exclude=exclude, block_bytes=block_bytes).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
    for user, vector, history in query_rows:
        scored = [(-float((np.asarray(vector) * np.asarray(v)).sum()), i) for i, v in item_rows
                  if exclude is None or i not in history]
        assert [i for _, i in sorted(got[user])] == [i for _, i in sorted(scored)[:15]]


@pytest.mark.parametrize("exclude", [None, "history"])
def test_most_cells_never_meet(spark, monkeypatch, exclude):
    """Far clusters: a query meets the block of its own cluster, and others only where its bound allows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 3
    items = [(i, (centres[i % 30] + rng.normal(size=16) * 0.05).tolist()) for i in range(3000)]
    queries = [(u, (centres[u % 30] + rng.normal(size=16) * 0.05).tolist(), [u % 30, u % 30 + 30, 10**6]) for u in range(200)]
    met, real = [], retrieval._meet
    monkeypatch.setattr(retrieval, "_meet", lambda asked, *rest: (met.append(asked.count()), real(asked, *rest))[1])
    found = retrieval.top_k(spark.createDataFrame(queries, "user_id long, embedding array<double>, history array<long>"),
                            spark.createDataFrame(items, "item_id long, embedding array<float>"), 10, exclude=exclude,
                            block_bytes=100 * 16 * 8).collect()
    vectors = np.array([v for _, v in items], np.float32).astype(float)
    got = {}
    for r in found:
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
    for user, vector, history in queries:
        scores = (np.asarray(vector) * vectors).sum(axis=1)
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if exclude is None or i not in history)[:10]
        assert [i for _, i in sorted(got[user])] == [i for _, i in best]
    assert sum(met) < 0.2 * 200 * 30


def test_topk_returns_what_is_left(spark):
    items = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "item_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0], [1]), (8, [1.0], [1, 2]), (9, [1.0], None)],
                              "user_id long, embedding array<double>, history array<long>")
    got = sorted((r["user_id"], r["rank"], r["item_id"]) for r in
                 retrieval.top_k(q, items, 5, exclude="history").collect())
    assert got == [(7, 1, 2), (9, 1, 1), (9, 2, 2)]
    with pytest.raises(ValueError):
        retrieval.top_k(q, items, 0)
    assert retrieval.top_k(q.limit(0), items, 3).count() == 0


def test_rerank_is_stable(spark):
    df = spark.createDataFrame([(1, 1, 10, 0.5, 0.0), (1, 2, 11, 0.5, 0.0), (1, 3, 12, 0.4, 3.0)],
                               "user_id long, rank int, item_id long, score double, ser_logit double")
    got = [(r["rank"], r["item_id"]) for r in rerank.rerank(df, 1.0).orderBy("rank").collect()]
    assert got == [(1, 12), (2, 10), (3, 11)]
    same = [r["item_id"] for r in rerank.rerank(df, 0.0).orderBy("rank").collect()]
    assert same == [10, 11, 12]


def test_fitted_classifier_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=2).tolist(), (rng.normal(size=2) + y).tolist(), y)
            for y in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "user_vector array<double>, item_vector array<double>, ser_label int")
    model = rerank.fit_classifier(df, pos_weight=2.0)
    scored = rerank.expert_logits(df, rerank.classifier_layers(model))
    means = {r["ser_label"]: r["m"] for r in
             scored.groupBy("ser_label").agg(F.avg("ser_logit").alias("m")).collect()}
    assert means[1] > means[0] + 0.5


# item text and semantic ids

def test_category_forms(spark):
    rows = [([["Books", " A  b "], ["C", ""]],), ([[""], []],), (None,), ([["one"]],)]
    df = spark.createDataFrame(rows, "c array<array<string>>")
    got = [r[0] for r in df.select(item_text.category_text(F.col("c"))).collect()]
    assert got == ["Books > A b; C", "", "", "one"]


def test_custom_encoder_skips_blank_texts(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", "  "), ("c", "xyz")], "item_id string, text string")
    built = item_text.embed(df, lambda texts: np.array([[len(t), 1.0, 9.0] for t in texts]),
                            truncate_dim=2)
    got = {r["item_id"]: r["embedding"] for r in built.collect()}
    assert set(got) == {"a", "c"}
    assert got["a"] == pytest.approx([2 / 5 ** 0.5, 1 / 5 ** 0.5])


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4))
    points = [(f"i{i}", (centres[i % 6] + 0.05 * rng.normal(size=4)).tolist()) for i in range(300)]
    return spark.createDataFrame(points, "item_id string, embedding array<double>")


def test_quantizer_invariants(spark, cloud):
    model = quantizer.fit(cloud, num_layers=3, codebook_size=[6, 4, 4], max_iterations=10, seed=2,
                          normalize=False)
    costs = [quantizer.distortion(cloud, model, n).first()["distortion"] for n in (1, 2, 3)]
    assert costs[0] >= costs[1] >= costs[2]
    coded = model.quantize(cloud).collect()
    assert len(coded) == 300
    assert all(0 <= c < k for r in coded for c, k in zip(r["codes"], (6, 4, 4)))
    again = quantizer.ResidualQuantizer.from_table(model.to_table(spark), normalize=False)
    assert sorted(map(str, again.quantize(cloud).collect())) == sorted(map(str, coded))
    slots = semantic_ids.dedup_slots(model.quantize(cloud), ["item_id"], cardinality=None).collect()
    assert len({(tuple(r["codes"]), r["dedup_slot"]) for r in slots}) == 300


def test_quantizer_equals_plain_lloyd(cloud):
    model = quantizer.fit(cloud, num_layers=1, codebook_size=6, max_iterations=4, seed=2)
    other = quantizer.fit(cloud.repartition(5), num_layers=1, codebook_size=6, max_iterations=4, seed=2)
    assert np.allclose(model.codebooks[0], other.codebooks[0])
    points = quantizer.unit_rows(np.asarray([r["embedding"] for r in cloud.collect()]))
    codes, _ = quantizer.nearest(points, model.codebooks[0])
    means = np.array([points[codes == c].mean(axis=0) for c in range(6)])
    assert np.abs(means - model.codebooks[0]).max() < 0.1


def test_quantizer_with_empty_clusters(spark):
    same = spark.createDataFrame([(f"i{i}", [1.0, 0.0] if i < 30 else [0.0, 1.0]) for i in range(40)],
                                 "item_id string, embedding array<double>")
    model = quantizer.fit(same, num_layers=1, codebook_size=8, max_iterations=3, seed=1)
    assert np.isfinite(model.codebooks[0]).all()
    with pytest.raises(ValueError):
        quantizer.fit(same, num_layers=1, codebook_size=50)
    with pytest.raises(ValueError):
        quantizer.fit(same, num_layers=2, codebook_size=[4])


def test_mini_batches_come_close(cloud):
    model = quantizer.fit(cloud, num_layers=1, codebook_size=6, max_iterations=4, seed=2, mini_batches=3)
    full = quantizer.fit(cloud, num_layers=1, codebook_size=6, max_iterations=4, seed=2)
    a = quantizer.distortion(cloud, model, 1).first()["distortion"]
    b = quantizer.distortion(cloud, full, 1).first()["distortion"]
    assert a < 3 * b + 0.05


def test_nearest_takes_the_lowest_code_on_ties():
    points = np.array([[1.0, 0.0], [0.0, 1.0]])
    book = np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert quantizer.nearest(points, book)[0].tolist() == [1, 0]


def test_slot_overflow_fails(spark):
    df = spark.createDataFrame([(i, [1, 2]) for i in range(3)] + [(9, [1, 3])], "item_id long, codes array<int>")
    got = {r["item_id"]: r["dedup_slot"] for r in semantic_ids.dedup_slots(df, ["item_id"]).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 9: 0}
    with pytest.raises(Exception, match="share a code tuple"):
        semantic_ids.dedup_slots(df, ["item_id"], cardinality=2).collect()


def test_lookup_status(spark):
    coded = spark.createDataFrame([("A", [0]), ("b", [1]), ("7", [2]), ("zz", [3]), ("c", [4])],
                                  "item_id string, codes array<int>")
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (8, "c")], "normalized_id long, key string")
    got = {r["item_id"]: (r["item_number"], r["status"])
           for r in semantic_ids.join_lookup(coded, lookup, 5).collect()}
    assert got == {"A": (1, "ok"), "b": (2, "ok"), "7": (None, "missing"), "zz": (None, "missing"),
                   "c": (9, "out_of_range")}
    numeric = {r["item_id"]: (r["item_number"], r["status"])
               for r in semantic_ids.join_lookup(coded, lookup, 8, numeric_as_is=True).collect()}
    assert numeric["7"] == (7, "ok")
