"""Queries over fixed-length examples."""

from pyspark.sql import functions as F

from seqrec.checks.registry import AGED, check, hash_number
from seqrec.functions import arrays
from seqrec.operators import examples
from seqrec.plans import views


def _joined(column):
    return arrays.format_sequence(F.col(column))


def _flat(df):
    """Arrays as text."""
    return df.select(*[_joined(n).alias(n) if t.startswith("array") else F.col(n)
                       for n, t in df.dtypes])


def _example_sql(n: int, skip: int, *, newest_first: bool, source: str = "aged",
                 rating: str = "rating", zero: str = "0.0", pad: bool = True) -> str:
    """CTEs ending in ``ex``: one row per user with lists and the target."""
    order = "age" if newest_first else "age DESC"

    def column(expression, fill, kind):
        gathered = f"""coalesce(list(CAST({expression} AS {kind}) ORDER BY {order})
          FILTER (age > {skip + 1} AND age <= {skip + 1 + n}), CAST([] AS {kind}[]))"""
        if not pad:
            return gathered
        return f"""list_concat({gathered}, list_transform(range({n} - CAST(count(*)
          FILTER (age > {skip + 1} AND age <= {skip + 1 + n}) AS BIGINT)), lambda x: CAST({fill} AS {kind})))"""

    return f"""ex AS (SELECT user_id,
  {column('item_id + 1', '0', 'BIGINT')} AS historical_ids,
  {column(rating, zero, 'DOUBLE' if '.' in zero else 'BIGINT')} AS historical_ratings,
  {column('ts', '0', 'BIGINT')} AS historical_timestamps,
  CAST(count(*) FILTER (age > {skip + 1} AND age <= {skip + 1 + n}) AS INTEGER) AS history_lengths,
  max(item_id + 1) FILTER (age = {skip + 1}) AS target_ids,
  max(rating) FILTER (age = {skip + 1}) AS target_ratings,
  max(ts) FILTER (age = {skip + 1}) AS target_timestamps,
  {column('ser_label', '0', 'BIGINT')} AS historical_ser_labels,
  CAST(max(ser_label) FILTER (age = {skip + 1}) AS BIGINT) AS target_ser_label
  FROM {source} GROUP BY user_id HAVING count(*) > {skip})"""


def _text(column: str) -> str:
    return f"array_to_string({column}, ',') AS {column}"


_LISTS = ["historical_ids", "historical_ratings", "historical_timestamps", "historical_ser_labels"]
_ALL = f"""SELECT user_id, {', '.join(_text(c) for c in _LISTS)}, history_lengths, target_ids,
  target_ratings, target_timestamps, target_ser_label FROM ex"""


@check(f"WITH {AGED}, {_example_sql(30, 1, newest_first=True)} {_ALL}")
def examples_train(spark, sf_dir):
    """Newest first, last event left out."""
    return _flat(examples.build(views.interactions(spark, sf_dir), max_length=30, ignore_last_n=1))


@check(f"WITH {AGED}, {_example_sql(50, 0, newest_first=False)} {_ALL}")
def examples_test(spark, sf_dir):
    return _flat(examples.build(views.interactions(spark, sf_dir), max_length=50,
                                chronological=True))


@check(f"""WITH {AGED}, {_example_sql(200, 0, newest_first=False, rating='trunc(rating)', zero='0',
                                       pad=False)}
{_ALL} WHERE history_lengths > 0""")
def examples_unpadded(spark, sf_dir):
    return _flat(examples.build(views.interactions(spark, sf_dir), chronological=True, pad=False,
                                int_ratings=True, require_history=True))


_SAMPLED = f"""sampled AS (
  SELECT * EXCLUDE (age), CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS INTEGER) AS age
  FROM aged WHERE age > 1
    AND {hash_number("concat('7|', user_id, '|', pos)")} / 4294967296.0 < 0.5)"""


@check(f"WITH {AGED}, {_SAMPLED}, {_example_sql(20, 0, newest_first=True, source='sampled')} {_ALL}")
def examples_sampled(spark, sf_dir):
    """Every position kept with probability one half, by hash."""
    return _flat(examples.build(views.interactions(spark, sf_dir), max_length=20, ignore_last_n=1,
                                sample_ratio=0.5, seed=7))


@check(f"""WITH {AGED}, {_example_sql(10, 0, newest_first=True)}
SELECT user_id, {', '.join(_text(c) for c in _LISTS)}, history_lengths, target_ids, target_ratings,
  target_timestamps, target_ser_label, c_acctbal, c_mktsegment
FROM ex JOIN customer ON c_custkey = user_id""")
def examples_with_user_columns(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment")
    return _flat(examples.build(views.interactions(spark, sf_dir), max_length=10, extra=customers))


def _chronological(spark, sf_dir, n=20):
    return examples.build(views.interactions(spark, sf_dir), max_length=n, chronological=True)


_CHRONO = f"WITH {AGED}, {_example_sql(20, 0, newest_first=False)}"


def _put(column: str, value: str, zero: str) -> str:
    return f"""array_to_string(list_transform(list_concat({column}, [{zero}, {zero}, {zero}]),
      lambda x, i: CASE WHEN i = history_lengths + 1 THEN {value} ELSE x END), ',') AS {column}"""


@check(f"""{_CHRONO} SELECT user_id, {_put('historical_ids', 'target_ids', '0')},
  {_put('historical_ratings', 'target_ratings', '0.0')},
  {_put('historical_timestamps', 'target_timestamps', '0')}, history_lengths FROM ex""")
def output_slots(spark, sf_dir):
    slotted = examples.with_output_slots(_chronological(spark, sf_dir), 3, put_target=True)
    return _flat(slotted.select("user_id", "historical_ids", "historical_ratings",
                                "historical_timestamps", "history_lengths"))


@check(f"""{_CHRONO}, full_list AS (
  SELECT user_id, list_concat(list_slice(historical_ids, 1, history_lengths), [target_ids],
         list_transform(range(21 - history_lengths), lambda x: 0)) AS l FROM ex),
pairs AS (SELECT user_id, unnest(range(21)) AS pos, l FROM full_list)
SELECT user_id, CAST(pos AS INTEGER) AS pos, l[pos + 1] AS item_id, l[pos + 2] AS next_item_id,
  CASE WHEN l[pos + 2] <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM pairs""")
def supervision_pairs(spark, sf_dir):
    slotted = examples.with_output_slots(_chronological(spark, sf_dir), 2, put_target=True)
    return examples.supervision_pairs(slotted)


@check(f"""{_CHRONO}, z AS (SELECT user_id, history_lengths, historical_timestamps AS t,
  historical_ids AS a, historical_ratings AS r FROM ex)
SELECT user_id,
  array_to_string(flatten(list_transform(a, lambda x, i: [x, CAST(r[i] AS BIGINT)])), ',') AS tokens,
  array_to_string(flatten(list_transform(a, lambda x: [x <> 0, x <> 0])), ',') AS mask,
  array_to_string(flatten(list_transform(t, lambda x: [x, x])), ',') AS timestamps,
  history_lengths * 2 AS lengths FROM z""")
def interleaved_tokens(spark, sf_dir):
    return _flat(examples.interleaved(_chronological(spark, sf_dir)))


@check(f"""{_CHRONO}
SELECT user_id,
  array_to_string(list_concat([1000000 + user_id], list_slice(historical_ids, 1, 19)), ',') AS historical_ids,
  array_to_string(list_concat([-1.0::DOUBLE], list_slice(historical_ratings, 1, 19)), ',') AS historical_ratings,
  array_to_string(list_concat([0], list_slice(historical_timestamps, 1, 19)), ',') AS historical_timestamps,
  history_lengths + 1 AS history_lengths FROM ex""")
def user_token(spark, sf_dir):
    tokened = examples.with_user_token(_chronological(spark, sf_dir), F.col("user_id") + 1000000)
    return _flat(tokened.select("user_id", "historical_ids", "historical_ratings",
                                "historical_timestamps", "history_lengths"))


@check(f"""{_CHRONO}, kept AS (
  SELECT user_id, list_filter(list_slice(historical_ids, 1, history_lengths),
         lambda x, i: historical_ratings[i] >= 3) AS l FROM ex)
SELECT user_id, array_to_string(list_concat(l, list_transform(range(20 - len(l)), lambda x: 0)), ',')
       AS ids, CAST(len(l) AS INTEGER) AS length FROM kept""")
def masked_positions(spark, sf_dir):
    """Only the positions rated 3 or better, padded again."""
    rows = _chronological(spark, sf_dir)
    mask = F.transform("historical_ratings", lambda r: r >= 3)
    kept = arrays.keep_where(F.col("historical_ids"), mask, F.col("history_lengths"))
    out = rows.select("user_id", kept.alias("l"))
    return out.select("user_id", arrays.format_sequence(
        arrays.pad_right(F.col("l"), 20, F.lit(0).cast("long"))).alias("ids"),
        F.size("l").alias("length"))


@check(f"""{_CHRONO}
SELECT user_id, historical_ids[history_lengths] AS last_id,
  array_to_string(list_transform([0, 2, 5], lambda i: historical_ids[i + 1]), ',') AS gathered,
  array_to_string(list_transform(historical_ids, lambda x, i: CASE WHEN i = 3 THEN -1 ELSE x END), ',')
    AS scattered
FROM ex WHERE history_lengths > 0""")
def gather_scatter(spark, sf_dir):
    rows = _chronological(spark, sf_dir).filter(F.col("history_lengths") > 0)
    ids = F.col("historical_ids")
    positions = F.array(F.lit(0), F.lit(2), F.lit(5))
    return rows.select(
        "user_id", arrays.value_at_last(ids, F.col("history_lengths")).alias("last_id"),
        arrays.format_sequence(arrays.gather(ids, positions)).alias("gathered"),
        arrays.format_sequence(arrays.put_at(ids, F.lit(2), F.lit(-1).cast("long")))
        .alias("scattered"))
