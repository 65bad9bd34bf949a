"""Joins and running totals that stay balanced when one key holds much of the data.

``spread_join`` answers the rows of every key above ``hot_rows`` rows from a
broadcast and never shuffles them. There are at most ``rows / hot_rows`` such
keys, whatever the data: that bounds the broadcast, and no key above
``hot_rows`` is left to a single join task. ``running_totals`` runs along the
rows of a group in the task that the shuffle gives it. A group above a task's
fair share is sorted by range, so it is cut into as many ranges as the shuffle
has partitions, and the totals of the ranges before are added. The two kinds
of group go by the same rule for every size of input; nothing is capped or
sampled away.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqrec.session import cut_lineage, once

HOT_ROWS = 1_000_000
PARTS = 64


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key as ``n_rows`` (combined on the map side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def spread_join(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner", *,
                counts: DataFrame | None = None, hot_rows: int = HOT_ROWS, look: bool = False) -> DataFrame:
    """Join facts with a table that is unique on ``keys``, hot keys included.

    Three kinds of facts go three ways and are put together again: rows of keys
    above ``hot_rows`` look up a broadcast of those keys' rows and stay where
    they are; rows with a null key pass the join by; all others join as usual.
    The facts are read once per way, so a costly input should be a written
    table. ``counts`` may give known rows per key of the facts as ``n_rows``.
    With ``look`` they are a written table and looked at first: where no key is
    hot there is one way, and the facts need not be written; else they are here.

    ``how``: inner, left, left_semi or left_anti.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"unsupported join type {how}")
    keys = list(keys)
    if how in {"left_semi", "left_anti"}:
        dim = dim.select(*keys)
    payload = [c for c in dim.columns if c not in keys]
    clash = set(payload) & set(facts.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    out = [*facts.columns, *payload]
    spread = not look or not counts.filter(F.col("n_rows") > hot_rows).isEmpty()
    if look and spread:
        facts = once(facts)
    known = facts.filter(_all_known(keys))
    if spread:
        if counts is None:
            counts = key_counts(known, keys)
        # at most rows / hot_rows keys
        hot_keys = F.broadcast(counts.filter(F.col("n_rows") > hot_rows).select(*keys))
        hot_dim = F.broadcast(dim.join(hot_keys, keys, "left_semi"))
        hot = known.join(hot_keys, keys, "left_semi").join(hot_dim, keys, how).select(*out)
        cold = known.join(hot_keys, keys, "left_anti").join(dim, keys, how).select(*out)
        joined = hot.unionByName(cold)
    else:
        joined = known.join(dim, keys, how).select(*out)
    if how in {"left", "left_anti"}:
        kinds = dict(dim.dtypes)
        unmatched = facts.filter(~_all_known(keys)).select(
            *facts.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in payload])
        joined = joined.unionByName(unmatched)
    return joined


def salted_anti_join(facts: DataFrame, dim: DataFrame, keys: Sequence[str], coarse: Sequence[str], *,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of the facts without a match in ``dim``, for fine keys such as pairs.

    Counting fine keys would cost as much as the join. A key that is frequent
    makes its ``coarse`` part frequent too, and those are few and cheap to
    count: the facts of each coarse key above ``hot_rows`` are spread over one
    salt per ``hot_rows`` rows, and its rows of ``dim`` are repeated once per
    salt. Rows with a null key have no match and pass the join by.

    The salt is a hash of the whole row: a task that runs again deals its rows
    as before, whatever order they come in. Only rows equal in all columns
    stay together.
    """
    keys, coarse = list(keys), list(coarse)
    known = facts.filter(_all_known(keys))
    salts = F.ceil(F.col("n_rows") / F.lit(hot_rows)).cast("int").alias("_salts")
    heavy = F.broadcast(key_counts(known, coarse).filter(F.col("n_rows") > hot_rows).select(*coarse, salts))
    many = F.coalesce(F.col("_salts"), F.lit(1))
    left = known.join(heavy, coarse, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c, kind in facts.dtypes if not kind.startswith("map")]), many).cast("int"))
    right = dim.select(*keys).distinct().join(heavy, coarse, "left").select(
        *keys, F.explode(F.sequence(F.lit(0), many - 1)).alias("_salt"))
    kept = left.join(right, [*keys, "_salt"], "left_anti").select(*facts.columns)
    return kept.unionByName(facts.filter(~_all_known(keys)))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str],
                   totals: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums per group in ascending ``order``.

    The order must be total within a group. Groups of at most a task's fair
    share of the rows take one window. The rows of larger ones are dealt out by
    ranges of (group, order) and written once, with the number of their range.
    Sums run within a range; what the ranges before hold of a group that began
    there is added. At most one group goes on from one range into the next, so
    the added sums have at most one row per range: a broadcast of a proven
    size. With no ``group`` the whole table is one group.
    """
    def together(rows: DataFrame) -> DataFrame:
        running = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.select("*", *[F.sum(v).over(running).alias(n) for n, v in totals.items()])

    return _by_size(df, list(group), together, lambda rows: _over_ranges(rows, list(group), list(order), totals, ()))


def number_and_next(df: DataFrame, group: Sequence[str], order: Sequence[str], number: str,
                    following: Sequence[str]) -> DataFrame:
    """Add a zero-based running number per group, and ``next_<c>`` of the row after it, null in the last row."""
    def together(rows: DataFrame) -> DataFrame:
        ordered = W.partitionBy(*group).orderBy(*order)
        return rows.select("*", (F.row_number().over(ordered) - 1).cast("long").alias(number),
                           *[F.lead(c).over(ordered).alias(f"next_{c}") for c in following])

    def ranges(rows: DataFrame) -> DataFrame:
        out = _over_ranges(rows, list(group), list(order), {number: F.lit(1)}, following)
        return out.withColumn(number, F.col(number) - 1)

    return _by_size(df, list(group), together, ranges)


def _by_size(df: DataFrame, keys: list[str], together: Callable[[DataFrame], DataFrame],
             ranges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``together`` of the rows of groups within a task's fair share, ``ranges`` of those of larger groups, null groups included.

    There are fewer larger groups than shuffle partitions or, above
    ``HOT_ROWS``, than rows / ``HOT_ROWS``.
    """
    if not keys:
        return ranges(df)
    df = once(df)
    share = min(HOT_ROWS, df.count() // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    large = cut_lineage(key_counts(df, keys).filter(F.col("n_rows") > share).select(*keys))
    if large.isEmpty():
        return together(df)
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"r.{key}").eqNullSafe(F.col(f"l.{key}"))
    rows, large = df.alias("r"), F.broadcast(large).alias("l")
    return together(rows.join(large, on, "left_anti")).unionByName(ranges(rows.join(large, on, "left_semi")))


def _over_ranges(df: DataFrame, keys: list[str], order: list[str], totals: Mapping[str, Column],
                 following: Sequence[str]) -> DataFrame:
    """Running totals and following values within ranges of the order, put together at their edges."""
    plain, names = list(df.columns), list(totals)
    placed = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    ordered = W.partitionBy("_part", *keys).orderBy(*order)
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    values = F.struct(*following) if following else F.lit(None)
    local = placed.select(*plain, "_part", *[F.sum(v).over(running).alias(f"_local_{n}") for n, v in totals.items()],
                          *([F.lead(values).over(ordered).alias("_next")] if following else []))
    sums = placed.groupBy(*keys, "_part").agg(
        *[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()],
        *([F.min_by(values, F.struct(*order)).alias("_first")] if following else []))
    edge = _edges(sums, keys, names, bool(following))
    same = F.col("_part") == F.col("_at_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_at_{key}"))
    out = local.join(F.broadcast(edge), same, "left")
    return out.select(
        *plain, *[(F.col(f"_local_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in totals],
        *[F.coalesce("_next", "_after")[c].alias(f"next_{c}") for c in following])


def _edges(sums: DataFrame, keys: list[str], names: list[str], following: bool) -> DataFrame:
    """For the groups at the ends of each range: the totals of the ranges before, the first row of the range after.

    Only the first and the last group of a range can be cut, so two rows per
    range are enough, however many groups there are.
    """
    ends = sums.groupBy("_part").agg(F.max(F.struct(*keys, "_part")).alias("last"),
                                     F.min(F.struct(*keys, "_part")).alias("first"))
    ends = ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("at")).select("at.*")
    on = F.col("s._part") == F.col("e._part")
    for key in keys:
        on = on & F.col(f"s.{key}").eqNullSafe(F.col(f"e.{key}"))
    cut = sums.alias("s").join(F.broadcast(ends).alias("e"), on, "left_semi")
    by_range = W.partitionBy(*keys).orderBy("_part")
    before = by_range.rowsBetween(W.unboundedPreceding, -1)
    placed = cut.select(*[F.col(k).alias(f"_at_{k}") for k in keys], F.col("_part").alias("_at_part"),
                        *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in names],
                        *([F.lead("_first").over(by_range).alias("_after")] if following else []))
    useful = F.coalesce(*[F.col(f"_before_{n}") for n in names]).isNotNull()
    return placed.filter(useful | F.col("_after").isNotNull() if following else useful)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add a zero-based running number per group as ``name``."""
    def together(rows: DataFrame) -> DataFrame:
        return rows.select("*", (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("long").alias(name))

    return _by_size(df, list(group), together, lambda rows: _by_place(rows, list(group), list(order), name))


def _by_place(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Running numbers of few large groups, or of the whole table: the place in the sorted ranges, less where the group begins.

    The rows are written sorted, with their place, and meet one row per range
    and group; they do not travel a second time.
    """
    placed = cut_lineage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    cut = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_begin"), F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(f"_at_{k}") for k in keys], F.col("_part").alias("_at_part"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_begin")).alias("_shift"))
    same = F.col("_part") == F.col("_at_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_at_{key}"))
    return placed.join(F.broadcast(cut), same).select(*df.columns, (F.col("_place") + F.col("_shift")).alias(name))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """The first ``k`` rows per group with their one-based rank.

    Spark limits each group before the shuffle as well as after it (the window
    group limit), so a hot group sends at most ``k`` rows per input task. It
    does so up to ``spark.sql.optimizer.windowGroupLimitThreshold``; beyond it
    each group is first limited in ``PARTS`` parts, dealt by a hash of the row,
    so no task holds a whole hot group.
    """
    window = W.partitionBy(*group).orderBy(*order)
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = F.pmod(F.xxhash64(*[F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(PARTS))
        within = W.partitionBy(*group, "_group_part").orderBy(*order)
        df = (df.withColumn("_group_part", part).withColumn("_group_rank", F.row_number().over(within))
              .filter(F.col("_group_rank") <= k).drop("_group_part", "_group_rank"))
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
