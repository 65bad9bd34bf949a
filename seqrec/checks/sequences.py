"""Queries over per-user sequences."""

from pyspark.sql import functions as F

from seqrec.checks.registry import AGED, INTERACTIONS, ORDER, check
from seqrec.operators import sequences
from seqrec.plans import views

_TEXT_COLUMNS = {"item_id": "sequence_item_ids", "rating": "sequence_ratings",
                 "ts": "sequence_timestamps", "ser_label": "sequence_ser_label"}
_EVENT = list(_TEXT_COLUMNS)


def _placed(spark, sf_dir):
    return sequences.positions(views.interactions(spark, sf_dir))


@check(f"WITH {AGED} SELECT user_id, pos, item_id, rating, ts FROM aged")
def sequence_positions(spark, sf_dir):
    return _placed(spark, sf_dir).select("user_id", F.col("pos").cast("int").alias("pos"),
                                         "item_id", "rating", "ts")


def _agg(column: str) -> str:
    return f"string_agg(CAST({column} AS VARCHAR), ',' ORDER BY pos)"


_SEQUENCE_SQL = ", ".join(f"{_agg(c)} AS {n}" for c, n in _TEXT_COLUMNS.items())


@check(f"""WITH {AGED}
SELECT user_id, CAST(pos // 1000 AS BIGINT) AS chunk, {_SEQUENCE_SQL}
FROM aged GROUP BY user_id, pos // 1000""")
def sequence_strings(spark, sf_dir):
    chunks = sequences.chunked(_placed(spark, sf_dir), columns=_EVENT)
    return sequences.as_strings(chunks, _TEXT_COLUMNS)


@check(f"""WITH {AGED}
SELECT user_id, CAST(pos // 16 AS BIGINT) AS chunk, {_SEQUENCE_SQL}
FROM aged GROUP BY user_id, pos // 16""")
def sequence_chunks(spark, sf_dir):
    """Long sequences continue in further rows."""
    chunks = sequences.chunked(_placed(spark, sf_dir), columns=_EVENT, chunk_size=16)
    return sequences.as_strings(chunks, _TEXT_COLUMNS)


@check(f"WITH {AGED} SELECT user_id, pos, item_id, rating, ts FROM aged")
def sequence_parse(spark, sf_dir):
    """Text form written and read back."""
    chunks = sequences.chunked(_placed(spark, sf_dir))
    names = {k: v for k, v in _TEXT_COLUMNS.items() if k != "ser_label"}
    parsed = sequences.from_strings(
        sequences.as_strings(chunks, names),
        {"sequence_item_ids": ("item_id", "long"), "sequence_ratings": ("rating", "double"),
         "sequence_timestamps": ("ts", "long")})
    events = parsed.select("user_id", "chunk", F.posexplode("seq").alias("at", "e"))
    return events.select("user_id", (F.col("chunk") * 1000 + F.col("at")).cast("int").alias("pos"),
                         "e.item_id", "e.rating", "e.ts")


@check(f"""WITH {INTERACTIONS}, n AS (SELECT user_id, count(*) AS c FROM inter GROUP BY user_id)
SELECT min(c) AS min_length, max(c) AS max_length, round(avg(c), 6) AS mean_length,
       median(c) AS median_length, count(*) AS users FROM n""")
def sequence_statistics(spark, sf_dir):
    stats = sequences.length_statistics(views.interactions(spark, sf_dir))
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@check(f"""WITH {AGED} SELECT user_id, item_id, rating, ts FROM aged WHERE n_events >= 40""")
def sequences_min_length(spark, sf_dir):
    kept = sequences.min_length(views.interactions(spark, sf_dir), 40)
    return kept.select("user_id", "item_id", "rating", "ts")


@check("""
SELECT conv_id AS user_id, CAST(0 AS BIGINT) AS chunk,
       string_agg(role, ',' ORDER BY turn, length(text), md5(text)) AS roles,
       string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn, length(text), md5(text)) AS sizes
FROM conversations GROUP BY conv_id""")
def conversation_sequences(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("user_id"), "turn", "role", F.length("text").alias("size"),
        F.md5("text").alias("digest"))
    placed = sequences.positions(turns, order=["turn", "size", "digest"])
    chunks = sequences.chunked(placed, columns=["role", "size"])
    return sequences.as_strings(chunks, {"role": "roles", "size": "sizes"})


@check(f"""WITH {AGED} SELECT user_id, age, item_id FROM aged WHERE age <= 5""")
def recent_events(spark, sf_dir):
    return sequences.recent(views.interactions(spark, sf_dir), 5).select("user_id", "age", "item_id")


@check(f"""WITH {INTERACTIONS}, n AS (SELECT user_id, count(*) AS length FROM inter GROUP BY user_id)
SELECT user_id, length, CAST(sum(length) OVER (ORDER BY user_id) AS BIGINT) AS end_offset,
       CAST(sum(length) OVER (ORDER BY user_id) - length AS BIGINT) AS start_offset FROM n""")
def jagged_offsets(spark, sf_dir):
    lengths = views.interactions(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("length"))
    return sequences.offsets(lengths, key="user_id")


_NEXT = f"""WITH {INTERACTIONS}, n AS (
  SELECT user_id, item_id, row_number() OVER w - 1 AS pos, lead(item_id) OVER w AS next_item_id,
         lead(rating) OVER w AS next_rating
  FROM inter WINDOW w AS (PARTITION BY user_id ORDER BY {ORDER}))
SELECT user_id, CAST(pos AS INTEGER) AS pos, item_id, next_item_id, next_rating
FROM n WHERE next_item_id IS NOT NULL"""


@check(_NEXT)
def next_item_pairs(spark, sf_dir):
    pairs = sequences.next_item_pairs(views.interactions(spark, sf_dir))
    return pairs.withColumn("pos", F.col("pos").cast("int"))


@check(f"""WITH {AGED}
SELECT user_id, pos, item_id AS value FROM aged WHERE pos < 30""")
def dense_to_jagged(spark, sf_dir):
    """Padded first 30 items to one row per valid element."""
    first = _placed(spark, sf_dir).select("user_id", "pos", F.col("item_id").alias("value"))
    padded = sequences.to_padded(first, "user_id", 30, F.lit(0).cast("long"))
    lengths = first.groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(30)).alias("n"))
    joined = padded.join(lengths, "user_id").withColumn("n", F.col("n").cast("int"))
    return sequences.to_long(joined, "user_id", "values", "n")


@check(f"""WITH {AGED}, s AS (
  SELECT user_id, list(item_id ORDER BY pos) AS l FROM aged WHERE pos < 30 GROUP BY user_id)
SELECT user_id, array_to_string(list_concat(l, list_transform(range(30 - len(l)), lambda x: 0)), ',')
       AS padded FROM s""")
def jagged_to_padded(spark, sf_dir):
    first = _placed(spark, sf_dir).select("user_id", "pos", F.col("item_id").alias("value"))
    padded = sequences.to_padded(first, "user_id", 30, F.lit(0).cast("long"))
    return padded.select("user_id", F.array_join(F.col("values").cast("array<string>"), ",")
                         .alias("padded"))


@check("""
SELECT c_custkey, c_mktsegment, CAST(copy AS INTEGER) AS copy
FROM customer CROSS JOIN (SELECT unnest(range(3)) AS copy)""")
def repeated_rows(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sequences.repeat_rows(customers, 3)


@check("""SELECT o_custkey AS c_custkey, o_orderkey, c_mktsegment
FROM orders JOIN customer ON c_custkey = o_custkey""")
def selected_rows(spark, sf_dir):
    """Rows picked by a list of keys with repeats."""
    customers = views.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    wanted = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"),
                                                         "o_orderkey")
    return sequences.select_rows(customers, wanted, "c_custkey")
