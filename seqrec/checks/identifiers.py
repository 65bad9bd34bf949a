"""Queries over id lookups."""

from pyspark.sql import functions as F

from seqrec.checks.registry import INTERACTIONS, ORDER, REGISTRY, check
from seqrec.operators import ids
from seqrec.plans import views
from seqrec.session import cut_lineage
from seqrec.sources.catalogue import catalogue_ids as catalogue_from_lines


@check("""
WITH lines AS (
  SELECT p_partkey * 2 AS ord, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey // 2 AS VARCHAR)
                                    ELSE CAST(p_partkey AS VARCHAR) END AS item_id
  FROM part WHERE p_size % 9 <> 0)
SELECT item_id, min(ord) AS ord FROM lines GROUP BY item_id""")
def catalogue_ids(spark, sf_dir):
    """Lines with quotes, byte order marks, blanks, repeats and empty fields."""
    key = F.col("p_partkey")
    shown = F.when(key % 3 == 0, F.floor(key / 2)).otherwise(key).cast("string")
    styled = F.when(key % 4 == 0, F.concat(F.lit('"'), shown, F.lit('"'))) \
        .when(key % 4 == 1, F.concat(F.lit("\ufeff"), shown)) \
        .when(key % 4 == 2, F.concat(F.lit("  "), shown, F.lit(" "))).otherwise(shown)
    first = F.when(F.col("p_size") % 9 == 0, F.lit(' "" ')).otherwise(styled)
    lines = views.table(spark, sf_dir, "part").select(
        (key * 2).alias("ord"), F.concat(first, F.lit(","), F.col("p_name")).alias("value"))
    return catalogue_from_lines(lines)


def _lookup_sql(column: str, where: str = "TRUE") -> str:
    return f"""
  SELECT {column} AS k, row_number() OVER (ORDER BY {ORDER}) - 1 AS normalized_id
  FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY {ORDER}) AS seen
        FROM inter WHERE {where})
  WHERE seen = 1"""


@check(f"""WITH {INTERACTIONS}, lk AS ({_lookup_sql('item_id')})
SELECT normalized_id, CAST(k AS VARCHAR) AS original_id FROM lk""")
def lookup_items(spark, sf_dir):
    keys = ids.raw_keys(views.interactions(spark, sf_dir), "item_id", ["ord"])
    return ids.assign_ids(keys).select("normalized_id", "original_id")


def _mixed_names(spark, sf_dir):
    """Customer names whose case differs from line to line."""
    name = F.when(F.col("ord.l_linenumber") % 2 == 0, F.upper("user_id")).otherwise(F.col("user_id"))
    return views.named_interactions(spark, sf_dir).withColumn("user_id", name)


_MIXED = f"""WITH {INTERACTIONS}, named AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, inter.*
  FROM inter JOIN customer ON c_custkey = user_id), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY {ORDER}) AS seen FROM named)"""


@check(_MIXED + f"""
SELECT row_number() OVER (ORDER BY {ORDER}) - 1 AS normalized_id, name AS original_id,
       lower(name) AS key
FROM firsts WHERE seen = 1""")
def lookup_users_folded(spark, sf_dir):
    keys = ids.raw_keys(_mixed_names(spark, sf_dir), "user_id", ["ord"], fold=True)
    return ids.assign_ids(keys)


@check(f"""WITH {INTERACTIONS},
old AS ({_lookup_sql('item_id', "l_returnflag = 'R' AND l_linestatus = 'O'")}),
rest AS ({_lookup_sql('item_id', "item_id NOT IN (SELECT k FROM old)")})
SELECT normalized_id, CAST(k AS VARCHAR) AS original_id FROM old
UNION ALL
SELECT normalized_id + (SELECT count(*) FROM old), CAST(k AS VARCHAR) FROM rest""")
def lookup_incremental(spark, sf_dir):
    """A lookup of the returned open lines, continued with all lines."""
    rows = views.interactions(spark, sf_dir)
    returned = views.table(spark, sf_dir, "lineitem").filter(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    first = rows.withColumns({k: F.col(f"ord.{k}") for k in keys}) \
                .join(returned.select(*keys), keys, "left_semi")
    old = ids.assign_ids(ids.raw_keys(first, "item_id", ["ord"]))
    return ids.assign_ids(ids.raw_keys(rows, "item_id", ["ord"]), old) \
              .select("normalized_id", "original_id")


@check(f"""WITH {INTERACTIONS},
cat AS (SELECT CAST(p_partkey AS VARCHAR) AS k, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS id
        FROM part WHERE p_size % 2 = 0),
rest AS ({_lookup_sql('item_id', "CAST(item_id AS VARCHAR) NOT IN (SELECT k FROM cat)")})
SELECT id AS normalized_id, k AS original_id FROM cat
UNION ALL
SELECT normalized_id + (SELECT count(*) FROM cat), CAST(k AS VARCHAR) FROM rest""")
def lookup_seeded(spark, sf_dir):
    """Catalogue items first, whether rated or not, then the rated ones."""
    parts = views.table(spark, sf_dir, "part").filter(F.col("p_size") % 2 == 0)
    seed = ids.assign_ids(ids.raw_keys(parts.withColumn("ord", -F.col("p_partkey")),
                                       "p_partkey", ["ord"]))
    keys = ids.raw_keys(views.interactions(spark, sf_dir), "item_id", ["ord"])
    return ids.assign_ids(keys, seed).select("normalized_id", "original_id")


@check(_MIXED + f""", users AS (
  SELECT lower(name) AS k, row_number() OVER (ORDER BY {ORDER}) - 1 AS id FROM firsts WHERE seen = 1),
items AS ({_lookup_sql('item_id')})
SELECT users.id AS user_id, items.normalized_id AS item_id, rating, ts
FROM named JOIN users ON users.k = lower(name) JOIN items ON items.k = item_id""")
def encode_ratings(spark, sf_dir):
    return _encoded(spark, sf_dir)


@check(REGISTRY["encode_ratings"].sql)
def encode_ratings_balanced(spark, sf_dir):
    """The same with every name of more than five rows treated as hot."""
    return _encoded(spark, sf_dir, hot_rows=5)


def _encoded(spark, sf_dir, **options):
    """The rows are joined from their tables once; what several steps read is written, as in the preparation."""
    rows = cut_lineage(_mixed_names(spark, sf_dir).select("user_id", "item_id", "rating", "ts", "ord"))
    user_keys = cut_lineage(ids.raw_keys(rows, "user_id", ["ord"], fold=True))
    item_keys = cut_lineage(ids.raw_keys(rows, "item_id", ["ord"]))
    users, items = (cut_lineage(ids.assign_ids(keys)) for keys in (user_keys, item_keys))
    rows = rows.drop("ord")
    encoded = cut_lineage(ids.encode(rows, "user_id", users, fold=True, counts=user_keys, **options))
    return ids.encode(encoded, "item_id", items, counts=item_keys, **options)


@check(f"""WITH {INTERACTIONS}
SELECT count(DISTINCT item_id) AS num_items, count(DISTINCT item_id) - 1 AS max_id FROM inter""")
def item_statistics(spark, sf_dir):
    keys = ids.raw_keys(views.interactions(spark, sf_dir), "item_id", ["ord"])
    return ids.item_statistics(ids.assign_ids(keys))


@check(f"""WITH {INTERACTIONS}
SELECT row_number() OVER (ORDER BY item_id) AS item_id FROM (SELECT DISTINCT item_id FROM inter)""")
def item_universe(spark, sf_dir):
    keys = ids.raw_keys(views.interactions(spark, sf_dir), "item_id", ["ord"])
    return ids.item_universe(ids.assign_ids(keys))
