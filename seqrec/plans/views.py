"""The recommender tables seen through the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_FIELDS = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(df: DataFrame) -> DataFrame:
    """A table that fewer tasks than there are cores would read, spread over all of them.

    The test files hold one row group each, which a single task would read and
    hand on; a table that Spark reads in many parts is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions() if len(df.inputFiles()) < cores else cores
    return df.repartition(cores) if parts < cores else df


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per line item: user = customer, item = part, rating 1..5.

    ``ord`` stands for the row order of a rating file; no two rows share it.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return _rated(spark, sf_dir, orders)


def _rated(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """The line items of ``orders`` (``o_orderkey, user_id``) as ratings."""
    lines = dealt_out(table(spark, sf_dir, "lineitem")).withColumn(
        "ts", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        "user_id",
        F.col("l_partkey").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.col("ts"),
        (F.col("l_returnflag") == "R").cast("int").alias("ser_label"),
        F.struct(*ORDER_FIELDS).alias("ord"),
    )


def flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with text flags in mixed case, derived from their status columns."""
    lines = table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(flag == "R", "TRUE").when(flag == "A", "False").alias("s_ser_find"),
        F.when((status == "O") & (flag == "N"), "true").otherwise("").alias("m_ser_find"),
    )


def holdout_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned and open lines as (user name in upper case, item) pairs."""
    lines = table(spark, sf_dir, "lineitem").filter(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # only the named orders meet the lines: names travel once per order
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    named = lines.join(owned, lines.l_orderkey == owned.o_orderkey)
    return named.select(F.upper("c_name").alias("user_id"),
                        F.col("l_partkey").cast("string").alias("item_id"))


def named_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with the customer name as the raw user id.

    The names meet the orders first, which are fewer than the line items.
    """
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("user_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    named = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "user_id")
    return _rated(spark, sf_dir, named).withColumn("item_id", F.col("item_id").cast("string"))


def item_vectors(spark: SparkSession, sf_dir: str, *, wide: bool = True) -> DataFrame:
    """A vector for every part: that of ``p_partkey`` modulo the number of vectors, ``wide`` in doubles, else as the file has it."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return parts.withColumn("vec_id", F.pmod(F.col("item_id"), size)).join(vectors, "vec_id") \
                .select("item_id", F.col("embedding").cast("array<double>").alias("embedding") if wide else "embedding")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products with a title, one category branch and a description."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.array(F.array("p_type", "p_brand"), F.array(F.lit(""), F.col("p_brand")),
                F.array(F.lit(""))).alias("categories"),
        F.when(F.col("p_size") % 2 == 0,
               F.concat(F.lit("  size \t "), F.col("p_size").cast("string"), F.lit("  units ")))
        .alias("description"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as films; some have no text at all."""
    empty = F.col("p_size") % 10 == 0

    def unless_empty(value):
        return F.when(~empty, value)

    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("movieId"),
        unless_empty(F.concat(F.lit(" "), F.col("p_name"), F.lit("  "))).alias("title"),
        unless_empty((F.col("p_size") + 1950).cast("string")).alias("releaseDate"),
        unless_empty(F.col("p_brand")).alias("directedBy"),
        F.lit(None).cast("string").alias("starring"),
        unless_empty(F.lower("p_type")).alias("genres"))
