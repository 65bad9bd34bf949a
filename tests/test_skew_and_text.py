"""The balanced joins and running totals, and the text functions."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from seqrec.functions import text
from seqrec.operators import skew
from seqrec.session import conf_bytes

rng = random.Random(7)
ROWS = [("hot" if rng.random() < 0.4 else f"u{rng.randrange(40)}", rng.randrange(50), i, rng.randrange(9))
        for i in range(4000)]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(ROWS, "user string, ts long, ord long, v long").repartition(5)


@pytest.mark.parametrize("group", [["user"], []])
def test_running_totals_equal_a_loop(facts, group):
    got = skew.running_totals(facts, group, ["ts", "ord"], {"n": F.lit(1), "s": F.col("v")}).collect()
    seen, expected = {}, {}
    for user, ts, ord_, v in sorted(ROWS, key=lambda r: (r[1], r[2])):
        n, s = seen.get(user if group else None, (0, 0))
        seen[user if group else None] = n + 1, s + v
        expected[ord_] = n + 1, s + v
    assert {r["ord"]: (r["n"], r["s"]) for r in got} == expected


def test_running_totals_with_null_groups_and_small_groups(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 500}", i, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, at long, v long").repartition(7)
    got = skew.running_totals(df, ["g"], ["at"], {"s": F.col("v")}).collect()
    seen, expected = {}, {}
    for g, at, v in rows:
        seen[g] = seen.get(g, 0) + v
        expected[at] = seen[g]
    assert {r["at"]: r["s"] for r in got} == expected


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_next_rows_across_ranges(spark, facts, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = skew.number_and_next(facts, ["user"], ["ts", "ord"], "n", ["ord", "v"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by_user = {}
    for row in sorted(ROWS, key=lambda r: (r[1], r[2])):
        by_user.setdefault(row[0], []).append(row)
    want = {}
    for rows in by_user.values():
        for n, (row, after) in enumerate(zip(rows, [*rows[1:], None])):
            want[row[2]] = (n, after and after[2], after and after[3])
    assert {r["ord"]: (r["n"], r["next_ord"], r["next_v"]) for r in got} == want


def rows_per_task(df):
    return sorted(len(p) for p in df.rdd.glom().collect())


def test_hot_group_is_cut_into_ranges(spark, facts):
    """A group of 40 % of the rows may not stay in one window task."""
    with adaptive_off(spark):
        numbered = skew.number_rows(facts, ["user"], ["ts", "ord"], "n")
        sizes = rows_per_task(numbered.filter(F.col("user") == "hot"))
    assert sizes[-1] < 0.7 * sum(sizes)


class adaptive_off:
    """Neither re-planning nor automatic broadcasts; 16 shuffle partitions."""

    OFF = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
           "spark.sql.shuffle.partitions": "16"}

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k) for k in self.OFF}
        for k, v in self.OFF.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


def test_numbered_rows_travel_once(spark):
    """Small groups by one shuffle that a later grouping shares, large ones by the ranges they are sorted in."""
    small = spark.range(4000).select((F.col("id") % 400).alias("user"), "id")
    large = spark.range(4000).select((F.col("id") % 2).alias("user"), "id")
    with adaptive_off(spark):
        numbered = skew.number_rows(small, ["user"], ["id"], "n")
        plan = numbered.groupBy("user").agg(F.max("n"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
        ranges = skew.number_rows(large, ["user"], ["id"], "n")
        assert {r["id"]: r["n"] for r in ranges.collect()} == {i: i // 2 for i in range(4000)}
        ranges = skew.number_rows(large, [], ["id"], "n").filter("n >= 0")
        assert {r["id"]: r["n"] for r in ranges.collect()} == {i: i for i in range(4000)}
        plan = ranges._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(_part#") <= 1  # the counts of the ranges
    assert {r["id"]: r["n"] for r in numbered.collect()} == {i: i // 400 for i in range(4000)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_spread_join_equals_plain_join(spark, facts, how, hot_rows):
    dim = spark.createDataFrame([("hot", 1), *[(f"u{i}", i) for i in range(0, 60, 2)]],
                                "user string, w long")
    got = skew.spread_join(facts, dim, ["user"], how, hot_rows=hot_rows)
    want = facts.join(dim, ["user"], how).select(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_spread_join_keeps_null_keys_of_the_left_side(spark, how):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 5)], "k string, w int")
    got = skew.spread_join(left, right, ["k"], how, hot_rows=0).collect()
    assert sorted(r["v"] for r in got) == ([1, 2] if how == "left" else [1])


@pytest.mark.parametrize("hot_keys", [1, 25, 5000])
def test_hot_rows_are_spread_over_all_tasks(spark, hot_keys):
    """Without broadcasts by size and without AQE, no task holds over twice the mean."""
    n = 40_000
    facts = spark.range(n, numPartitions=16).select((F.col("id") % hot_keys).alias("k"), "id")
    dim = spark.range(hot_keys).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
    with adaptive_off(spark):
        sizes = rows_per_task(skew.spread_join(facts, dim, ["k"], hot_rows=n // hot_keys - 1))
    assert sum(sizes) == n and sizes[-1] <= 2 * n / 16


def test_null_keys_are_spread_over_all_tasks(spark):
    n = 20_000
    facts = spark.range(n, numPartitions=16).select(F.lit(None).cast("long").alias("k"), "id")
    dim = spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("w"))
    with adaptive_off(spark):
        sizes = rows_per_task(skew.spread_join(facts, dim, ["k"], "left"))
        anti = rows_per_task(skew.salted_anti_join(facts.withColumn("j", F.col("id")),
                                                   dim.select("k", F.col("w").alias("j")), ["k", "j"], ["k"]))
        hot = facts.select(F.lit(1).alias("k"), F.lit(2).alias("j"), "id")
        pair = dim.select(F.lit(7).alias("k"), F.lit(2).alias("j"))
        salted = rows_per_task(skew.salted_anti_join(hot, pair, ["k", "j"], ["k"], hot_rows=n // 200))
    assert sum(salted) == n and salted[-1] <= 2 * n / 16
    assert sum(sizes) == sum(anti) == n
    assert sizes[-1] <= 2 * n / 16 and anti[-1] <= 2 * n / 16


@pytest.mark.parametrize("hot_rows", [30, 10**6])
def test_salted_anti_join_equals_plain_join(spark, facts, hot_rows):
    dim = spark.createDataFrame([("hot", i) for i in range(0, 50, 2)], "user string, ts long")
    got = skew.salted_anti_join(facts, dim, ["user", "ts"], ["user"], hot_rows=hot_rows)
    want = facts.join(dim, ["user", "ts"], "left_anti").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_top_per_group_limits_before_the_shuffle(facts):
    top = skew.top_per_group(facts, ["user"], [F.desc("ts"), F.desc("ord")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    best = {}
    for r in sorted(ROWS, key=lambda r: (-r[1], -r[2])):
        best.setdefault(r[0], []).append(r[2])
    got = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["user"], []).append(r["ord"])
    assert got == {u: o[:3] for u, o in best.items()}


def test_casefold_matches_python_for_every_character(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    # only characters that the interpreter and the JVM both know as letters with case
    df = spark.createDataFrame([(c, chr(c)) for c in codes if chr(c).casefold() != chr(c)],
                               "code int, s string")
    wrong = [r["code"] for r in df.select("code", "s", text.casefold(F.col("s")).alias("f")).collect()
             if r["f"] != r["s"].casefold()]
    assert len(wrong) < 60, wrong  # newer Unicode versions only
    assert all(c > 0x1C88 for c in wrong), [hex(c) for c in wrong]


def test_casefold_words(spark):
    words = ["A", "STRASSE", "straße", "ΟΔΟΣ", "οδος", "ﬁn", "", None, "İ", "plain"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = [r["f"] for r in df.select(text.casefold(F.col("s")).alias("f")).collect()]
    assert got == [w.casefold() if w is not None else None for w in words]


def test_normalize_space(spark):
    values = ["  a  b\t\nc ", " x y ", "", " ", "a"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [tuple(r) for r in df.select(text.normalize_space(F.col("s")), text.strip(F.col("s")),
                                       text.is_blank(F.col("s"))).collect()]
    assert got == [(" ".join(v.split()), v.strip(), not v.strip()) for v in values]


def test_size_settings(spark):
    for text, want in [("10485760b", 10485760), ("10MB", 10485760), ("-1", -1), ("2g", 2 * 1024**3),
                       ("nonsense", 7)]:
        spark.conf.set("seqrec.test.size", text)
        assert conf_bytes(spark, "seqrec.test.size", 7) == want


def test_top_per_group_beyond_the_window_group_limit(spark, facts):
    """Above the threshold the group is limited in parts first, with the same result."""
    order = [F.desc("ts"), F.desc("ord")]
    plain = skew.top_per_group(facts, ["user"], order, 50)
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "20")
    try:
        parted = skew.top_per_group(facts, ["user"], order, 50)
        assert parted.columns == plain.columns
        assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set(key, old)
