"""Counts taken in passing, the bit filter of the hold-out, and jobs that are left without rows."""

import random

import pytest
from pyspark.sql import functions as F

from seqrec.operators import clean
from seqrec.operators.counts import Counts, NothingLeft
from seqrec.plans import prepare
from seqrec.session import cut_lineage


def test_lenient_numbers_are_counted_in_the_same_pass(spark, tmp_path):
    rows = [("4.5", "1"), ("x", "2"), ("3", None), (None, "NaN"), ("2", "7")]
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "rating string, ts string").write.parquet(path)
    counts = Counts()
    kept = clean.lenient_numbers(spark.read.parquet(path), {"rating": "double", "ts": "long"}, counts=counts)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan parquet") <= 2 and "Aggregate" not in plan
    assert sorted(tuple(r) for r in kept.collect()) == [(2.0, 7), (4.5, 1)]
    assert counts["numbers"] == {"rows": 5, "kept": 2, "invalid_rating": 2, "invalid_ts": 2}
    counts.require_rows("numbers")
    with pytest.raises(ValueError):
        counts.watch("numbers", kept, rows=F.count(F.lit(1)))


def pairs_and_rows(spark, n_pairs=300, n_rows=20000):
    rng = random.Random(2)
    held = [(f"U{rng.randrange(500)}", f"i{rng.randrange(500)}") for _ in range(n_pairs)]
    rows = [(f"u{rng.randrange(500)}", f"I{rng.randrange(500)}", i) for i in range(n_rows)]
    rows += [(None, "i1", -1), ("u1", None, -2), *((u.lower(), i, 10**6) for u, i in held[:50])]
    return (cut_lineage(spark.createDataFrame(rows, "user_id string, item_id string, n long")),
            cut_lineage(spark.createDataFrame([*held, (None, "i1")], "user_id string, item_id string")), rows, held)


@pytest.mark.parametrize("filtered", [True, False])
def test_only_possible_hits_meet_the_pairs(spark, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(clean, "MOST_FILTER_BYTES", 0)
    facts, holdout, rows, held = pairs_and_rows(spark)
    gone = {(u.lower(), i) for u, i in held}
    want = [r for r in rows if r[0] is None or r[1] is None or (r[0].lower(), r[1].lower()) not in gone]
    counts = Counts()
    kept = clean.remove_leaks(facts, holdout, counts=counts)
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    removed, possible = counts["leaks"]["removed"], counts["leaks"]["possible"]
    assert removed == len(rows) - len(want) > 50
    if filtered:
        # about one in 420 of the other rows
        assert possible - removed < 0.01 * len(rows)
    else:
        assert possible == len(rows) - 2


def test_filter_knows_every_pair(spark):
    pairs = cut_lineage(spark.range(5000).select(F.col("id").cast("string").alias("u"), (F.col("id") * 7).cast("string").alias("i")))
    hit = clean.possible_hits(pairs, ["u", "i"])
    assert pairs.filter(~hit()).count() == 0
    other = spark.range(5000, 25000).select(F.col("id").cast("string").alias("u"), F.col("id").cast("string").alias("i"))
    assert cut_lineage(other).filter(hit()).count() < 200
    assert cut_lineage(other).filter(clean.possible_hits(pairs.limit(0), ["u", "i"])()).count() == 0


def test_jobs_report_and_refuse_nothing(spark):
    rows = spark.createDataFrame([("a", "x", "1", "5", 0), ("a", "y", "2", "6", 1), ("b", "x", "z", "7", 2)],
                                 "user_id string, item_id string, rating string, ts string, ord long")
    with pytest.raises(NothingLeft):
        prepare.prepare_ratings(rows.filter("rating <> 'z'"), minimum=5)
    empty = prepare.prepare_ratings(rows.filter("rating <> 'z'"), minimum=5, allow_empty=True)
    assert empty.ratings.count() == 0
    first = prepare.prepare_ratings(rows.filter("rating <> 'z'"))
    assert first.counts.report() == {"read": {"rows": 2}, "cleaned": {"kept": 2}}
    labelled = rows.withColumn("ser_label", F.lit("1"))
    second = prepare.prepare_holdout(labelled, users=first.user_lookup, items=first.item_lookup)
    assert second.counts["numbers"] == {"rows": 3, "kept": 2, "invalid_rating": 1, "invalid_ts": 0, "invalid_ser_label": 0}
    held = spark.createDataFrame([("A", "Y")], "user_id string, item_id string")
    numbers = rows.withColumn("rating", F.expr("try_cast(rating AS DOUBLE)"))
    third = prepare.prepare_product_ratings(numbers, held, minimum=1)
    assert third.counts["leaks"]["removed"] == 1 and third.counts["complete"] == {"rows": 2, "kept": 1}


def test_configured_statistics_and_extra_columns(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 5, 0, "web"), ("a", "y", 2.0, 6, 1, None), ("b", "x", 3.0, 7, 2, "app")],
                                 "user_id string, item_id string, rating double, ts long, ord long, device string")
    done = prepare.prepare_ratings(rows)
    assert done.item_statistics(num_items=2, max_id=1).first() == done.item_statistics().first()
    with pytest.raises(Exception, match="num_items is configured as 3, the lookup has 2"):
        done.item_statistics(num_items=3).collect()
    found = {r["user_id"]: [e["device"] for e in r["seq"]] for r in done.sequences(extra=["device"]).collect()}
    assert found == {0: ["web", None], 1: ["app"]}
    assert "device" not in done.sequences().schema["seq"].dataType.elementType.names
    with pytest.raises(ValueError):
        done.sequences(extra=["nowhere"])


@pytest.mark.parametrize("name", ["encode_ratings", "encode_ratings_balanced"])
def test_encoding_joins_its_tables_once(spark, tmp_path, name):
    """What several steps of the encoding read is a written table, not the join of the source tables again."""
    from seqrec.checks import REGISTRY

    lines = [(o, n, (o * 7 + n) % 5, 1, float(o % 9 + n), 10.0 * o, "R" if o % 3 else "N", "O") for o in range(30) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                                 "l_extendedprice double, l_returnflag string, l_linestatus string") \
         .withColumn("l_shipdate", F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, cast(l_orderkey % 11 as int))")) \
         .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 8) for o in range(30)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, f"Customer#{c}") for c in range(7)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = REGISTRY[name].run(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if "lineitem.parquet" in f]
    first = {}
    for o, n, item, *_ in sorted(lines, key=lambda x: (x[0] % 11, x[0], x[1])):
        if o % 8 < 7:
            first.setdefault("u", {}).setdefault(o % 8, len(first["u"]))
            first.setdefault("i", {}).setdefault(item, len(first["i"]))
    expected = sorted((first["u"][o % 8], first["i"][item], float(-(-q // 10))) for o, n, item, _, q, *_ in lines if o % 8 < 7)
    assert sorted((r["user_id"], r["item_id"], r["rating"]) for r in found.collect()) == expected
