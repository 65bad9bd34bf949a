"""Queries over readers and writers: whole test tables written in a file form and read back."""

import uuid

from pyspark.sql import functions as F

from seqrec.checks.registry import INTERACTIONS, VECTORS, check, vector_text, vector_units
from seqrec.operators import ids, sequences
from seqrec.plans import prepare, views
from seqrec.session import ensure_checkpoint_dir
from seqrec.sinks import ledger, tables
from seqrec.sources import embeddings, ratings, registry
from seqrec.sources.catalogue import read_catalogue_ids


def scratch(spark) -> str:
    """A new folder next to the intermediate tables, shared by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _written_csv(df, header: bool) -> str:
    path = scratch(df.sparkSession)
    df.write.option("header", header).csv(path)
    return path


def _public_names(spark, sf_dir):
    return views.interactions(spark, sf_dir).select(
        F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating",
        F.col("ts").alias("unix_timestamp"), F.col("ser_label").alias("note"))


@check(f"""WITH {INTERACTIONS} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
  CAST(rating AS VARCHAR) AS rating, CAST(ts AS VARCHAR) AS ts, CAST(ser_label AS VARCHAR) AS note FROM inter""")
def file_headered_ratings(spark, sf_dir):
    path = _written_csv(_public_names(spark, sf_dir), True)
    return ratings.read_ratings(spark, path, extra=["note"], ordered=False)


@check(f"""WITH {INTERACTIONS} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
  rating, CAST(ts AS DOUBLE) AS ts FROM inter""")
def file_headerless_ratings(spark, sf_dir):
    path = _written_csv(_public_names(spark, sf_dir).drop("note"), False)
    return ratings.read_headerless_ratings(spark, path, ordered=False)


@check(f"WITH {INTERACTIONS} SELECT CAST(user_id AS VARCHAR) AS user_id FROM inter")
def file_pruned_columns(spark, sf_dir):
    path = _written_csv(_public_names(spark, sf_dir), True)
    return ratings.read_columns(spark, path, ["user_id"], {"user_id": "userId"})


@check("""SELECT item_id, CAST(row_number() OVER (ORDER BY p) - 1 AS BIGINT) AS nth
FROM (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_partkey AS p FROM part)""")
def file_row_order(spark, sf_dir):
    """Ids by the order of the rows in files of lines, as a catalogue lists them: file by file, line by line."""
    path = scratch(spark)
    parts = views.table(spark, sf_dir, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    parts.select(F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('",'), F.col("p_name"))).write.text(path)
    lookup = ids.assign_ids(ids.raw_keys(read_catalogue_ids(spark, path), "item_id", ["ord"]))
    return lookup.select(F.col("original_id").alias("item_id"), F.col("normalized_id").alias("nth"))


@check("""SELECT CAST(p_partkey AS VARCHAR) AS item_id, concat_ws(' [SEP] ', 'asin: ' || p_partkey,
  'title: ' || p_name, 'categories: ' || p_type || ' > ' || p_brand) AS text FROM part""")
def file_literal_records(spark, sf_dir):
    """Parts as lines of Python literals; every other line is malformed and left out."""
    path = scratch(spark)
    parts = views.table(spark, sf_dir, "part")
    line = F.format_string("{'asin': '%d', 'title': \"%s\", 'categories': [['%s', '%s']], 'description': None, 'x': True}",
                           "p_partkey", "p_name", "p_type", "p_brand")
    parts.select(F.explode(F.array(line, F.concat(F.lit("{"), line)))).write.text(path)
    return registry.read_items(spark, "products", path)


@check("""
SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_size % 10 = 0 THEN 'movieId: ' || p_partkey
  ELSE concat_ws(' [SEP] ', 'title: ' || p_name, 'releaseDate: ' || (p_size + 1950),
                 'directedBy: ' || p_brand, 'genres: ' || lower(p_type)) END AS text FROM part""")
def file_movie_records(spark, sf_dir):
    path = scratch(spark)
    views.movies(spark, sf_dir).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return registry.read_items(spark, "movies", path)


@check(f"""WITH {VECTORS} SELECT CAST(item_id AS VARCHAR) AS item_id, {vector_text('v')} AS vector FROM ivec""")
def file_embedding_parts(spark, sf_dir):
    """Vectors in files of a few rows, read by a pattern, with their length checked."""
    path = scratch(spark)
    tables.write_embeddings(views.item_vectors(spark, sf_dir), path, rows_per_file=500)
    found = embeddings.read_embeddings(spark, embeddings.resolve_sources(path_glob=f"{path}/*.parquet"), dim=64)
    return found.select("item_id", vector_units(F.col("embedding").cast("array<double>")).alias("vector"))


CHUNK, WAVE, WAVES = 150, 2, 3


@check(f"""WITH n AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_size % 2 = 0 AS early FROM part),
placed AS (SELECT *, (row_number() OVER (PARTITION BY early ORDER BY item_id) - 1) // {CHUNK} AS nth FROM n)
SELECT item_id, CASE WHEN early AND nth < {WAVE * WAVES} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS pass FROM placed""")
def file_resumed_embeddings(spark, sf_dir):
    """Half of the items planned and the run interrupted, then all: finished chunks are not embedded again.

    The interruption leaves a chunk that is half written; its rows must not be seen.
    """
    path = scratch(spark)
    texts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_id"), "p_size")

    def embed(number):
        return lambda rows: rows.select("item_id", F.array(F.lit(float(number))).alias("embedding"))

    chunks = ledger.ChunkLedger(spark, path, CHUNK)
    chunks.run(texts.filter(F.col("p_size") % 2 == 0), embed(1), chunks_per_wave=WAVE, most_waves=WAVES)
    torn = texts.filter(F.col("p_size") % 4 == 0).select("item_id", F.array(F.lit(9.0)).alias("embedding"), F.lit(WAVE * WAVES).alias("chunk"))
    torn.write.partitionBy("chunk").parquet(f"{path}/chunks/data-torn")
    chunks.run(texts, embed(2), chunks_per_wave=WAVE * 8)
    return chunks.read().select("item_id", F.col("embedding")[0].alias("pass"))


@check(f"""WITH {INTERACTIONS}, f AS (
  SELECT item_id, min((ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS seen,
         bool_or(ser_label = 1) AS early FROM inter GROUP BY item_id),
e AS (SELECT item_id, min((ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS seen
      FROM inter WHERE ser_label = 1 GROUP BY item_id)
SELECT CAST(item_id AS VARCHAR) AS original_id, row_number() OVER (ORDER BY seen) - 1 AS normalized_id FROM e
UNION ALL
SELECT CAST(item_id AS VARCHAR), row_number() OVER (ORDER BY seen) - 1 + (SELECT count(*) FROM e) FROM f WHERE NOT early""")
def file_lookup_versions(spark, sf_dir):
    """A lookup of the returned items, then a second version with all; the latest is read.

    A third version that was never finished lies beside them.
    """
    root, rows = scratch(spark), views.interactions(spark, sf_dir)
    first = ids.assign_ids(ids.raw_keys(rows.filter(F.col("ser_label") == 1), "item_id", ["ord"]))
    tables.write_lookup(first, root, 1)
    tables.write_lookup(ids.assign_ids(ids.raw_keys(rows, "item_id", ["ord"]), tables.read_lookup(spark, root)), root, 2)
    first.withColumn("normalized_id", F.col("normalized_id") + 1).write.parquet(f"{root}/data-torn")
    return tables.read_lookup(spark, root).select("original_id", "normalized_id")


@check(f"""WITH {INTERACTIONS}, s AS (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts, l_orderkey,
    l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS item_ids FROM inter GROUP BY user_id)
SELECT CAST(row_number() OVER (ORDER BY user_id) - 1 AS VARCHAR) AS index, CAST(user_id AS VARCHAR) AS user_id, item_ids FROM s""")
def file_sequences(spark, sf_dir):
    """The text form of the sequences with its running index."""
    path = scratch(spark)
    chunks = sequences.chunked(sequences.positions(views.interactions(spark, sf_dir)), columns=["item_id"])
    tables.write_sequence_text(chunks, path, {"item_id": "item_ids"})
    return ratings.read_sequences(spark, path).select("index", "user_id", "item_ids")


@check(f"""WITH {INTERACTIONS}, named AS (SELECT inter.*, 'U' || user_id AS u, 'I' || item_id AS i FROM inter),
ou AS (SELECT u, row_number() OVER (ORDER BY seen) - 1 AS id FROM (SELECT u,
  min((ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS seen FROM named GROUP BY u)),
oi AS (SELECT i, row_number() OVER (ORDER BY seen) - 1 AS id FROM (SELECT i,
  min((ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS seen FROM named GROUP BY i))
SELECT CAST(lower(u) AS VARCHAR) AS user_key, CAST(lower(i) AS VARCHAR) AS item_key, rating, ts
FROM named JOIN ou USING (u) JOIN oi USING (i)""")
def file_job_outputs(spark, sf_dir):
    """All four outputs of a preparation, written and put together again."""
    root, rows = scratch(spark), views.interactions(spark, sf_dir)
    named = rows.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
                        F.concat(F.lit("I"), F.col("item_id").cast("string")).alias("item_id"), "rating", "ts", "ord")
    prepare.prepare_ratings(named, minimum=1, min_length=1).write(root)
    users, items = (tables.read_lookup(spark, f"{root}/{t}").select(F.col("normalized_id").alias(f"{t}_id"),
                                                                   F.col("key").alias(f"{t}_key")) for t in ("users", "items"))
    done = spark.read.parquet(f"{root}/ratings")
    done = done.join(users, done.user_id == users.users_id).join(items, done.item_id == items.items_id)
    return done.select(F.col("users_key").alias("user_key"), F.col("items_key").alias("item_key"), "rating", "ts")


@check("SELECT count(*) AS items, count(*) AS equal_codes FROM embeddings")
def file_quantizer_tables(spark, sf_dir):
    """A quantizer written as tables and read back gives every item the same codes."""
    from seqrec.operators import quantizer

    path = scratch(spark)
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"),
                                                             F.col("embedding").cast("array<double>").alias("embedding"))
    model = quantizer.fit(vectors, num_layers=2, codebook_size=4, max_iterations=1, seed=2)
    tables.write_quantizer(model, model.quantize(vectors), path)
    again = tables.read_quantizer(spark, path).quantize(vectors).withColumnRenamed("codes", "again")
    both = spark.read.parquet(f"{path}/assignments").join(again, "item_id")
    return both.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("codes") == F.col("again")).alias("equal_codes"))
