"""Cleaning and filtering of rating tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqrec.functions.text import casefold
from seqrec.operators import skew
from seqrec.operators.counts import Counts
from seqrec.session import cut_lineage, once


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail while the plan is built when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename those of the given columns that are present."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def project(df: DataFrame, required: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    wanted = [*required, *extra]
    return require_columns(df, wanted).select(*wanted)


# Fixed value: decimal numbers as the rating files write them.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number(df: DataFrame, name: str, kind: str) -> Column:
    """A column as a number of the given type, null where it is none.

    Texts must be written as decimal numbers (no NaN, no type suffix). Whole
    numbers are read as such, so none is rounded; others are cut to whole
    numbers where the type asks for it. What the type cannot hold is null.
    """
    column = F.col(name)
    if dict(df.dtypes)[name] == "string":
        column = F.trim(column)
        column = F.when(column.rlike(NUMBER), column)
    wide = column.try_cast("double")
    wide = F.when(~F.isnan(wide), wide)
    return wide.try_cast(kind) if kind in {"double", "float"} else F.coalesce(
        F.when(~F.isnan(column.try_cast("double")), column.try_cast(kind)), wide.try_cast(kind))


def strict_numbers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast text columns; a value that is not a number fails the job when read."""
    checked = {}
    for name, kind in columns.items():
        value = number(df, name, kind)
        fail = F.raise_error(F.concat(F.lit(f"column {name} is not numeric: "),
                                      F.coalesce(F.col(name).cast("string"), F.lit("null"))))
        checked[name] = F.when(value.isNull(), fail.cast(kind)).otherwise(value)
    return df.withColumns(checked)


def invalid_numbers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row with the number of values per column that are no number of its type."""
    return df.agg(*[F.count_if(number(df, c, k).isNull()).alias(f"invalid_{c}") for c, k in columns.items()])


def lenient_numbers(df: DataFrame, columns: dict[str, str], *, counts: Counts | None = None,
                    step: str = "numbers") -> DataFrame:
    """Cast text columns and drop the rows where any of them is not a number.

    ``counts`` gets ``rows``, ``kept`` and, per column, ``invalid_<column>`` in the same pass.
    """
    cast = df.withColumns({n: number(df, n, k) for n, k in columns.items()})
    if counts is not None:
        valid = F.lit(True)
        for name in columns:
            valid = valid & F.col(name).isNotNull()
        cast = counts.watch(step, cast, rows=F.count(F.lit(1)), kept=F.count_if(valid),
                            **{f"invalid_{c}": F.count_if(F.col(c).isNull()) for c in columns})
    return cast.dropna(subset=list(columns))


def drop_incomplete(df: DataFrame, columns: Sequence[str] = ("rating", "ts")) -> DataFrame:
    return df.dropna(subset=list(columns))


def any_flag_label(df: DataFrame, flags: Sequence[str], name: str = "ser_label") -> DataFrame:
    """1 when any flag column says "true" in whatever case, else 0."""
    require_columns(df, flags)
    is_true = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "true"
               for c in flags]
    return df.withColumn(name, F.greatest(*is_true, F.lit(False)).cast("int"))


def min_presence(ratings: DataFrame, minimum: int, *, user: str = "user_id",
                 item: str = "item_id", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Keep rows whose item and user both occur at least ``minimum`` times.

    Both are counted once on the unfiltered table; this is not a k-core.
    Rows with a null id are dropped.
    """
    if minimum <= 1:
        return ratings.filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    ratings = once(ratings)
    kept = ratings.filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    for key in (item, user):
        counts = once(skew.key_counts(ratings.filter(F.col(key).isNotNull()), [key]))
        enough = counts.filter(F.col("n_rows") >= minimum).select(key)
        kept = skew.spread_join(kept, enough, [key], "left_semi", counts=counts, hot_rows=hot_rows, look=True)
    return kept


FOLDED = ["_fold_user", "_fold_item"]


def folded(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Add the case-folded ids, unless they are there."""
    if set(FOLDED) <= set(df.columns):
        return df
    return df.withColumns({f: casefold(F.col(c).cast("string")) for f, c in zip(FOLDED, (user, item))})


# sixteen bits a pair and four hashes: about one row in 420 of those not held out is a possible hit
BITS_PER_PAIR, HASHES = 16, 4
MOST_FILTER_BYTES = 64 << 20


def possible_hits(pairs: DataFrame, keys: Sequence[str]) -> Callable[[], Column] | None:
    """A filter for rows that may be among ``pairs``: never false for one that is.

    The bits are set and merged in the tasks, 32,768 of them a row, and handed
    to every task as one array. Beyond ``MOST_FILTER_BYTES`` there is no filter.
    """
    n = pairs.count()
    bits = 1 << max(15, (n * BITS_PER_PAIR - 1).bit_length())
    if bits // 8 > MOST_FILTER_BYTES:
        return None

    def places() -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(HASHES)]

    found = pairs.select(F.explode(F.array(*places())).alias("at")).groupBy(
        F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    # bucket b holds the places from (b - 1) * 32768 + 1 on; place 0 is in bucket 0
    table = np.zeros(bits // 8 + 8192, np.uint8)
    for row in found.collect():
        begin = row["bucket"] * 4096
        table[begin:begin + 4096] |= np.frombuffer(bytes(row["bits"]), np.uint8)

    @F.arrow_udf("boolean")
    def maybe(*columns: pa.Array) -> pa.Array:
        hit = np.ones(len(columns[0]), bool)
        for column in columns:
            at = column.to_numpy(zero_copy_only=False)
            bucket = np.where(at > 0, 1 + (at - 1) // 32768, 0)
            position = np.where(at > 0, (at - 1) % 32768, 0)
            hit &= (table[bucket * 4096 + position // 8] >> (position % 8).astype(np.uint8)) & 1 == 1
        return pa.array(hit)

    return lambda: maybe(*places())


def remove_leaks(ratings: DataFrame, holdout: DataFrame, *, user: str = "user_id",
                 item: str = "item_id", hot_rows: int = skew.HOT_ROWS, counts: Counts | None = None,
                 step: str = "leaks") -> DataFrame:
    """Drop ratings whose case-folded (user, item) pair is in the hold-out.

    Rows that a bit filter of the pairs rules out stay where they are; only
    possible hits meet the pairs. ``counts`` gets ``possible``, the rows that
    met them, and ``removed``.
    """
    pairs = once(folded(holdout, user, item).select(*FOLDED).dropna().distinct())
    # the rows are read more than once
    facts = once(folded(ratings, user, item))
    hit = possible_hits(pairs, FOLDED)
    known = F.col(FOLDED[0]).isNotNull() & F.col(FOLDED[1]).isNotNull()
    passed = facts.filter(~known)
    if hit is None:
        possible = facts.filter(known)
    else:
        marked = facts.filter(known).withColumn("_possible", hit())
        passed = passed.unionByName(marked.filter(~F.col("_possible")).drop("_possible"))
        possible = marked.filter("_possible").drop("_possible")
    seen = Observation()
    possible = cut_lineage(possible.observe(seen, F.count(F.lit(1)).alias("rows")))
    kept = cut_lineage(skew.salted_anti_join(possible, pairs, FOLDED, FOLDED[:1], hot_rows=hot_rows))
    if counts is not None:
        counts.record(step, possible=int(seen.get["rows"]), removed=int(seen.get["rows"]) - kept.count())
    return passed.unionByName(kept).drop(*FOLDED)


def column_status(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Name, type, smallest and largest value of the listed columns."""
    require_columns(df, columns)
    kinds = dict(df.dtypes)
    row = df.agg(*[f(c).cast("string").alias(f"{n}_{c}") for c in columns
                   for n, f in (("min", F.min), ("max", F.max))])
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"),
                        F.col(f"min_{c}").alias("min_value"), F.col(f"max_{c}").alias("max_value"))
               for c in columns]
    return row.select(F.inline(F.array(*entries)))
