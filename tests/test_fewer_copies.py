"""Preparation jobs move and write their rows less often."""

from unittest import mock

import pytest
from pyspark.sql import functions as F

from seqrec.checks import jobs
from seqrec.operators import clean, ids, skew
from seqrec.plans import prepare, views
from seqrec.session import cut_lineage

ROWS = [(u, i) for u, i in [("a", "x")] * 9 + [("b", "x"), ("b", "y"), (None, "x"), ("c", None), ("b", "z")]]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot_rows", [5, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_looking_first_gives_the_same_rows(spark, how, hot_rows):
    facts = spark.createDataFrame(ROWS, "k string, v string")
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "k string, w int")
    counts = cut_lineage(skew.key_counts(facts.filter("k is not null"), ["k"]))
    plain = skew.spread_join(facts, dim, ["k"], how, hot_rows=hot_rows)
    looked = skew.spread_join(facts, dim, ["k"], how, counts=counts, hot_rows=hot_rows, look=True)
    assert sorted(map(tuple, looked.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert looked.columns == plain.columns
    # without a hot key there is nothing to put together, but for the null keys of an outer join
    if hot_rows == 100 and how in {"inner", "left_semi"}:
        assert "Union" not in _plan(looked)


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_presence_and_encoding_join_once(spark, hot_rows):
    rows = cut_lineage(spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], "ord int, user_id string, item_id string"))
    kept = clean.min_presence(rows, 2, hot_rows=hot_rows)
    assert sorted((r["user_id"], r["item_id"]) for r in kept.collect()) == [("a", "x")] * 9 + [("b", "x")]
    keys = cut_lineage(ids.raw_keys(rows, "user_id", ["ord"]))
    encoded = ids.encode(rows, "user_id", cut_lineage(ids.assign_ids(keys)), counts=keys, hot_rows=hot_rows)
    assert sorted((r["user_id"], r["ord"]) for r in encoded.collect()) == [(0, n) for n in range(9)] + [(1, 9), (1, 10), (1, 13)] + [(2, 12)]
    if hot_rows > 100:
        assert "Union" not in _plan(kept) + _plan(encoded)


def test_rows_are_not_written_between_the_two_ids(spark):
    stored = []

    def store(df):
        stored.append(set(df.columns))
        return cut_lineage(df)

    rows = spark.createDataFrame([(f"u{n % 5}", f"i{n % 7}", "3", str(n), n) for n in range(60)],
                                 "user_id string, item_id string, rating string, ts string, ord int")
    done = prepare.prepare_ratings(rows, minimum=2, store=store)
    assert done.ratings.count() == 60
    # as read, clean, and encoded
    assert len([c for c in stored if "rating" in c]) == 3


def test_names_meet_the_orders(spark, sf_dir):
    """A row per line item is joined once, with orders that have their name."""
    named = views.named_interactions(spark, sf_dir)
    plain = views.interactions(spark, sf_dir).join(
        views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")
    expected = plain.select(F.col("c_name").alias("user_id"), F.col("item_id").cast("string").alias("item_id"), "rating", "ts", "ser_label", "ord")
    assert named.dtypes == expected.dtypes and named.count() == expected.count()
    assert not named.exceptAll(expected).count()
    top = next(line for line in _plan(named).splitlines() if "Join" in line)
    assert "l_orderkey" in top


def test_held_rows_pass_a_bit_filter(spark, sf_dir):
    with mock.patch.object(clean, "possible_hits", side_effect=clean.possible_hits) as call:
        jobs.job_holdout_on_shared_lookups(spark, sf_dir)
    assert "l_orderkey" in [k for c in call.call_args_list for k in c.args[1]]


def test_no_second_key_travels_with_a_drawn_id(spark):
    from seqrec.operators import features

    events = spark.createDataFrame([(0, 0), (1, None), (2, 1), (3, 99), (4, 1), (5, 2)], "n int, item_id long")
    table = spark.createDataFrame([(0, [9.0, 9.0]), (1, [1.0, 2.0]), (2, None), (None, [5.0, 5.0])], "item_id long, embedding array<double>")
    found = features.attach_vectors(events, table, 2, skewed=False)
    assert found.columns == ["n", "item_id", "embedding"]
    zeros = [0.0, 0.0]
    assert [r["embedding"] for r in found.orderBy("n").collect()] == [zeros, zeros, [1.0, 2.0], zeros, [1.0, 2.0], zeros]
    assert "CASE WHEN" not in _plan(found)
