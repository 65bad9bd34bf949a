"""Queries over the cleaning operators."""

from pyspark.sql import functions as F

from seqrec.checks.registry import INTERACTIONS, REGISTRY, check
from seqrec.functions import text
from seqrec.operators import clean
from seqrec.plans import views


def _text_ratings(spark, sf_dir):
    """Interactions with their numbers as text, some of it no number, or none that fits."""
    line = F.col("ord.l_linenumber")
    return views.interactions(spark, sf_dir).select(
        "user_id", "item_id",
        F.when(line % 7 == 0, "x").when(line % 5 == 0, "").when(line % 6 == 0, "NaN").when(line % 4 == 0, "4.5d")
        .otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(F.col("ts") % 11 == 0, "soon").when(F.col("ts") % 13 == 0, "1e30")
        .when(F.col("ts") % 17 == 0, "9007199254740993").otherwise(F.col("ts").cast("string")).alias("ts"))


_TEXT = f"""WITH {INTERACTIONS}, txt AS (
  SELECT user_id, item_id,
         CASE WHEN l_linenumber % 7 = 0 THEN 'x' WHEN l_linenumber % 5 = 0 THEN ''
              WHEN l_linenumber % 6 = 0 THEN 'NaN' WHEN l_linenumber % 4 = 0 THEN '4.5d'
              ELSE CAST(rating AS VARCHAR) END AS rating,
         CASE WHEN ts % 11 = 0 THEN 'soon' WHEN ts % 13 = 0 THEN '1e30'
              WHEN ts % 17 = 0 THEN '9007199254740993' ELSE CAST(ts AS VARCHAR) END AS ts
  FROM inter),
num AS (SELECT *, CASE WHEN NOT isnan(TRY_CAST(rating AS DOUBLE)) THEN TRY_CAST(rating AS DOUBLE) END AS r,
  TRY_CAST(ts AS BIGINT) AS t FROM txt)"""


@check(_TEXT + """
SELECT user_id, item_id, r AS rating, t AS ts FROM num WHERE r IS NOT NULL AND t IS NOT NULL""")
def ratings_lenient(spark, sf_dir):
    return clean.lenient_numbers(_text_ratings(spark, sf_dir), {"rating": "double", "ts": "long"})


@check(_TEXT + """
SELECT count(*) FILTER (r IS NULL) AS invalid_rating, count(*) FILTER (t IS NULL) AS invalid_ts FROM num""")
def ratings_invalid_counts(spark, sf_dir):
    return clean.invalid_numbers(_text_ratings(spark, sf_dir), {"rating": "double", "ts": "long"})


@check(f"WITH {INTERACTIONS} SELECT user_id, item_id, rating, ts FROM inter")
def ratings_strict(spark, sf_dir):
    rows = views.interactions(spark, sf_dir).withColumns(
        {"rating": F.col("rating").cast("string"), "ts": F.col("ts").cast("string")})
    typed = clean.strict_numbers(rows, {"rating": "double", "ts": "long"})
    return clean.project(typed, ["user_id", "item_id", "rating", "ts"])


@check(f"""WITH {INTERACTIONS}
SELECT user_id, item_id, rating, ts FROM
  (SELECT user_id, item_id, nullif(rating, 3) AS rating,
          CASE WHEN l_suppkey % 4 <> 0 THEN ts END AS ts FROM inter)
WHERE rating IS NOT NULL AND ts IS NOT NULL""")
def ratings_complete(spark, sf_dir):
    gaps = views.interactions(spark, sf_dir).select(
        "user_id", "item_id", F.nullif("rating", F.lit(3.0)).alias("rating"),
        F.when(F.col("ord.l_suppkey") % 4 != 0, F.col("ts")).alias("ts"))
    return clean.drop_incomplete(gaps)


@check("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_returnflag = 'R' OR (l_linestatus = 'O' AND l_returnflag = 'N')
            THEN 1 ELSE 0 END AS ser_label
FROM lineitem""")
def ser_label_any(spark, sf_dir):
    flags = ["s_ser_find", "m_ser_find"]
    return clean.any_flag_label(views.flagged_lines(spark, sf_dir), flags).drop(*flags)


@check(f"""WITH {INTERACTIONS},
i AS (SELECT item_id FROM inter GROUP BY item_id HAVING count(*) >= 30),
u AS (SELECT user_id FROM inter GROUP BY user_id HAVING count(*) >= 30)
SELECT user_id, item_id, rating, ts FROM inter
WHERE item_id IN (SELECT item_id FROM i) AND user_id IN (SELECT user_id FROM u)""")
def min_presence(spark, sf_dir):
    kept = clean.min_presence(views.interactions(spark, sf_dir), 30)
    return kept.select("user_id", "item_id", "rating", "ts")


@check(REGISTRY["min_presence"].sql)
def min_presence_balanced(spark, sf_dir):
    """The same with the joins of a table in which every frequent key is a hot one."""
    kept = clean.min_presence(views.interactions(spark, sf_dir), 30, hot_rows=20)
    return kept.select("user_id", "item_id", "rating", "ts")


@check(f"""WITH {INTERACTIONS},
named AS (SELECT c_name AS user_id, CAST(item_id AS VARCHAR) AS item_id, rating, ts,
                 l_returnflag, l_linestatus
          FROM inter JOIN customer ON c_custkey = user_id),
held AS (SELECT DISTINCT lower(upper(user_id)) AS u, lower(item_id) AS i FROM named
         WHERE l_returnflag = 'R' AND l_linestatus = 'O')
SELECT user_id, item_id, rating, ts FROM named
WHERE NOT EXISTS (SELECT 1 FROM held WHERE u = lower(user_id) AND i = lower(item_id))""")
def leak_removal(spark, sf_dir):
    kept = clean.remove_leaks(views.named_interactions(spark, sf_dir),
                              views.holdout_pairs(spark, sf_dir))
    return kept.select("user_id", "item_id", "rating", "ts")


@check(REGISTRY["leak_removal"].sql)
def leak_removal_balanced(spark, sf_dir):
    kept = clean.remove_leaks(views.named_interactions(spark, sf_dir), views.holdout_pairs(spark, sf_dir), hot_rows=20)
    return kept.select("user_id", "item_id", "rating", "ts")


@check(f"""WITH {INTERACTIONS}
SELECT 'rating' AS column_name, 'double' AS type, CAST(min(rating) AS VARCHAR) AS min_value,
       CAST(max(rating) AS VARCHAR) AS max_value FROM inter
UNION ALL
SELECT 'ts', 'bigint', CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR) FROM inter""")
def column_status(spark, sf_dir):
    return clean.column_status(views.interactions(spark, sf_dir), ["rating", "ts"])


_SPACE = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
          r"\x{202F}\x{205F}\x{3000}]+")


@check(f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars
FROM (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') AS t FROM documents)
WHERE t <> ''""")
def text_normalized(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    kept = docs.filter(~text.is_blank(F.col("text")))
    clean_text = text.normalize_space(F.col("text"))
    return kept.select("doc_id", F.md5(clean_text).alias("digest"),
                       F.length(clean_text).alias("n_chars"))


@check("SELECT doc_id, md5(replace(lower(text), 'ß', 'ss')) AS digest FROM documents")
def text_casefold(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.casefold(F.col("text"))).alias("digest"))
