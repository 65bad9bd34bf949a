"""Queries over item text, quantization and semantic ids."""

import numpy as np
from pyspark.sql import functions as F

from seqrec.checks.registry import INTERACTIONS, VECTORS, check, hash_number, vector_text, vector_units
from seqrec.functions import arrays
from seqrec.operators import ids, item_text, quantizer, semantic_ids
from seqrec.plans import views
from seqrec.streaming import frequency

CODES = 16
LAYERS = 3

_BRANCHES = "p_type || ' > ' || p_brand || '; ' || p_brand"


@check(f"""
SELECT CAST(p_partkey AS VARCHAR) AS item_id, concat_ws(' [SEP] ', 'asin: ' || p_partkey,
  'title: ' || p_name, 'categories: ' || {_BRANCHES},
  CASE WHEN p_size % 2 = 0 THEN 'description: size ' || p_size || ' units' END) AS text FROM part""")
def item_text_product(spark, sf_dir):
    return item_text.product_text(views.products(spark, sf_dir))


@check("""
SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_size % 10 = 0 THEN 'movieId: ' || p_partkey
  ELSE concat_ws(' [SEP] ', 'title: ' || p_name, 'releaseDate: ' || (p_size + 1950),
                 'directedBy: ' || p_brand, 'genres: ' || lower(p_type)) END AS text FROM part""")
def item_text_movie(spark, sf_dir):
    return item_text.movie_text(views.movies(spark, sf_dir))


@check(f"SELECT CAST(p_partkey AS VARCHAR) AS item_id, {_BRANCHES} AS categories FROM part")
def category_paths(spark, sf_dir):
    products = views.products(spark, sf_dir)
    return products.select("item_id", item_text.category_text(F.col("categories"))
                           .alias("categories"))


_SPACE = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
          r"\x{202F}\x{205F}\x{3000}]+")


@check(f"""WITH t AS (
  SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'), ' '), ' ')) AS term
  FROM documents),
c AS (SELECT doc_id, {hash_number('term')} % 32 AS b, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
z AS (SELECT doc_id, map_from_entries(list((b, n))) AS m, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, {vector_text('list_transform(range(32), lambda i: coalesce(m[i], 0.0) / norm)', 5)} AS embedding
FROM z""")
def text_vectors_hashed(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    built = item_text.embed_hashed(docs, 32, key="doc_id")
    return built.select("doc_id", vector_units(F.col("embedding"), 5).alias("embedding"))


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


def tfidf_sql(key: str, source: str, dim: int) -> str:
    """Tables ending in ``z``: (key, w), w the bucket counts times the idf of their bucket."""
    return f"""t AS (
  SELECT {key}, unnest(string_split(trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'), ' '), ' ')) AS term FROM {source}),
c AS (SELECT {key}, {hash_number('term')} % {dim} AS b, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
idf AS (SELECT b, ln(((SELECT count(DISTINCT {key}) FROM c) + 1) / (count(*) + 1)) AS f FROM c GROUP BY b),
z0 AS (SELECT {key}, map_from_entries(list((b, n * f))) AS m FROM c JOIN idf USING (b) GROUP BY {key}),
z AS (SELECT {key}, list_transform(range({dim}), lambda i: coalesce(m[i], 0.0::DOUBLE)) AS w FROM z0)"""


@check(f"""WITH {tfidf_sql('doc_id', 'documents', 64)}
SELECT doc_id, {vector_text(unit_sql('w'), 5)} AS embedding FROM z""")
def text_vectors_tfidf(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    built = item_text.embed_hashed(docs, 64, key="doc_id", idf=True)
    return built.select("doc_id", vector_units(F.col("embedding"), 5).alias("embedding"))


# Fixed codebooks: the first CODES vectors, the next CODES, ... (K x D numbers).
def codebooks(spark, sf_dir) -> list:
    rows = views.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < CODES * LAYERS) \
                .select("vec_id", "embedding").orderBy("vec_id").collect()
    matrix = np.asarray([r["embedding"] for r in rows], dtype=np.float64)
    return [matrix[i * CODES:(i + 1) * CODES] for i in range(LAYERS)]


def _layer_sql(layer: int) -> str:
    source = f"r{layer}"
    return f"""b{layer} AS (SELECT vec_id - {layer * CODES} AS code, CAST(embedding AS DOUBLE[]) AS c
  FROM embeddings WHERE vec_id >= {layer * CODES} AND vec_id < {(layer + 1) * CODES}),
a{layer} AS (SELECT vec_id, codes, v, code, c FROM {source} CROSS JOIN b{layer}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY
    list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i]))), code) = 1),
d{layer} AS (SELECT vec_id, list_append(codes, code) AS codes, list_transform(v, lambda x, i: x - c[i]) AS w FROM a{layer}),
r{layer + 1} AS (SELECT vec_id, codes, {unit_sql('w')} AS v FROM d{layer})"""


CODED = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
r0 AS (SELECT vec_id, CAST([] AS BIGINT[]) AS codes, {unit_sql('w')} AS v FROM e),
{', '.join(_layer_sql(i) for i in range(LAYERS))},
coded AS (SELECT vec_id, codes, array_to_string(codes, ',') AS code_text FROM r{LAYERS})"""


def coded(spark, sf_dir):
    table = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return quantizer.quantize(table, codebooks(spark, sf_dir), item="vec_id")


def _code_text():
    return arrays.format_sequence(F.col("codes"))


@check(f"{CODED} SELECT vec_id, code_text AS codes FROM coded")
def quantize_fixed(spark, sf_dir):
    return coded(spark, sf_dir).select("vec_id", _code_text().alias("codes"))


@check(f"""{CODED}, short AS (SELECT vec_id, array_to_string(codes[1:1], ',') AS codes FROM coded)
SELECT vec_id, codes, CAST(row_number() OVER (PARTITION BY codes ORDER BY vec_id) - 1 AS INTEGER)
       AS dedup_slot FROM short""")
def dedup_slots(spark, sf_dir):
    """First layer only, so that many items share their codes."""
    short = coded(spark, sf_dir).withColumn("codes", semantic_ids.first_layers(F.col("codes"), 1))
    slots = semantic_ids.dedup_slots(short, ["vec_id"], cardinality=None)
    return slots.select("vec_id", _code_text().alias("codes"),
                        F.col("dedup_slot").cast("int").alias("dedup_slot"))


@check(f"""{CODED}, g AS (SELECT codes[1:2] AS k, count(*) AS n FROM coded GROUP BY codes[1:2])
SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS distinct_codes,
       CAST(sum(n - 1) AS BIGINT) AS collisions, max(n) AS largest_group FROM g""")
def collision_statistics(spark, sf_dir):
    short = coded(spark, sf_dir).withColumn("codes", semantic_ids.first_layers(F.col("codes"), 2))
    return semantic_ids.collision_statistics(short)


@check(f"""{CODED}
SELECT vec_id, codes[1] * {CODES * CODES} + codes[2] * {CODES} + codes[3] AS ngram,
  (codes[1] * {CODES * CODES} + codes[2] * {CODES} + codes[3]) % 1009 AS ngram_mod,
  concat_ws(',', codes[1], codes[1] * {CODES} + codes[2],
            (codes[1] * {CODES * CODES} + codes[2] * {CODES} + codes[3]) % 1009) AS prefixes,
  concat_ws(',', codes[1] + {2 * CODES}, codes[2] + {CODES}, codes[3]) AS layer_ids
FROM coded""")
def code_encodings(spark, sf_dir):
    codes = F.col("codes")
    return coded(spark, sf_dir).select(
        "vec_id", semantic_ids.ngram_id(codes, CODES).alias("ngram"),
        semantic_ids.ngram_id(codes, CODES, 1009).alias("ngram_mod"),
        arrays.format_sequence(semantic_ids.prefix_ids(codes, CODES, 1009)).alias("prefixes"),
        arrays.format_sequence(semantic_ids.layer_ids(codes, CODES)).alias("layer_ids"))


@check(f"""WITH {INTERACTIONS}, u AS (
  SELECT 'a' || vec_id AS item_id, 0 AS source, vec_id AS ord FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT 'a' || (vec_id % 50), 1, vec_id FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT 'b' || vec_id, 2, vec_id FROM embeddings WHERE label = 1)
SELECT item_id, CAST(source AS INTEGER) AS source, ord FROM u
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY source, ord) = 1""")
def combined_sources(spark, sf_dir):
    """Three sources with prefixes; the first occurrence of an id wins."""
    table = views.table(spark, sf_dir, "embeddings").withColumn("ord", F.col("vec_id"))
    key, rest = F.col("vec_id"), ["ord", "embedding"]
    united = semantic_ids.combine_sources([
        (table.filter(key % 2 == 0).select(key.alias("item_id"), *rest), "a"),
        (table.filter(key % 3 == 0).select((key % 50).alias("item_id"), *rest), "a"),
        (table.filter(F.col("label") == 1).select(key.alias("item_id"), *rest), "b")])
    return united.select("item_id", "source", "ord")


_LOOKUP = f"""lk AS (SELECT item_id AS vec_id, row_number() OVER (ORDER BY f) AS item_number FROM (
  SELECT item_id, min((ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS f
  FROM inter WHERE ser_label = 1 GROUP BY item_id)), half AS (SELECT count(*) // 2 AS n FROM part)"""
_STATUS = f"""{CODED}, {INTERACTIONS}, {_LOOKUP}, st AS (
  SELECT vec_id, code_text, codes, item_number,
    CASE WHEN item_number IS NULL THEN 'missing' WHEN item_number > (SELECT n FROM half) THEN 'out_of_range' ELSE 'ok' END AS status
  FROM coded LEFT JOIN lk USING (vec_id))"""


def _coded_lookup(spark, sf_dir, respelled=False):
    """Codes joined to the ids of returned items, half as many as there are parts.

    ``respelled`` adds every item in another spelling, with its codes reversed.
    """
    rated = views.interactions(spark, sf_dir).filter(F.col("ser_label") == 1)
    size = views.table(spark, sf_dir, "part").agg(F.floor(F.count(F.lit(1)) / 2).alias("n")).scalar()
    named = rated.withColumn("item_id", F.concat(F.lit("Item"), F.col("item_id").cast("string")))
    lookup = ids.assign_ids(ids.raw_keys(named, "item_id", ["ord"], fold=True))
    items = coded(spark, sf_dir).withColumn(
        "item_id", F.concat(F.lit("ITEM"), F.col("vec_id").cast("string")))
    if respelled:
        items = items.unionByName(items.withColumns({"item_id": F.lower("item_id"), "codes": F.reverse("codes")}))
    return semantic_ids.join_lookup(items, lookup, size)


@check(f"{_STATUS} SELECT vec_id, code_text AS codes, item_number, status FROM st")
def code_lookup(spark, sf_dir):
    return _coded_lookup(spark, sf_dir).select("vec_id", _code_text().alias("codes"),
                                               "item_number", "status")


@check(f"""{_STATUS}
SELECT p_partkey + 1 AS item_id, coalesce(array_to_string(list_reverse(codes), ','), '0,0,0') AS codes,
  codes IS NOT NULL AS has_sid
FROM part LEFT JOIN st ON st.status = 'ok' AND item_number = p_partkey + 1""")
def code_mask(spark, sf_dir):
    """The codes of every item number, with a mask for those without; of two spellings the last counts."""
    universe = views.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("item_id"))
    known = _coded_lookup(spark, sf_dir, respelled=True).filter(F.col("status") == "ok")
    return semantic_ids.with_mask(universe, known, LAYERS).withColumn("codes", _code_text())


def _table_vector(key: str) -> str:
    return f"list_transform(range(8), lambda d: CAST((({key}) * 7 + d * 3) % 11 - 5 AS DOUBLE) / 4)"


_SID_SQL = f"""{CODED}, x AS (SELECT vec_id, [codes[1] + {2 * CODES}, codes[2] + {CODES}, codes[3]] AS k FROM coded),
y AS (SELECT vec_id, k, {_table_vector('k[1]')} AS a, {_table_vector('k[2]')} AS b,
        CASE WHEN k[3] = 0 THEN list_transform(range(8), lambda d: 0.0::DOUBLE) ELSE {_table_vector('k[3]')} END AS c,
        {_table_vector('vec_id')} AS own FROM x),
sv AS (SELECT vec_id, own, list_transform(a, lambda p, i: (p + b[i] + c[i]) / sqrt(3)) AS s FROM y)"""


def _sid_vectors(spark, sf_dir):
    def generated(key):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: ((key * 7 + d * 3) % 11 - 5) / 4.0)

    vec = F.col("vec_id")
    table = views.table(spark, sf_dir, "embeddings").filter(vec <= CODES * LAYERS).select(
        vec.alias("emb_id"), generated(vec).alias("vector"))
    items = coded(spark, sf_dir).withColumn("individual_vector", generated(vec))
    found = semantic_ids.sid_vectors(items, semantic_ids.layer_ids(F.col("codes"), CODES), table,
                                     CODES * LAYERS, 8, LAYERS)
    return found.withColumn("has_sid", vec % 4 != 0)


@check(f"{_SID_SQL} SELECT vec_id, {vector_text('s', 5)} AS sid_vector FROM sv")
def sid_vectors(spark, sf_dir):
    return _sid_vectors(spark, sf_dir).select(
        "vec_id", vector_units(F.col("sid_vector"), 5).alias("sid_vector"))


@check(f"""{_SID_SQL} SELECT vec_id,
  {vector_text('CASE WHEN vec_id % 4 <> 0 THEN list_transform(s, lambda q, i: q + own[i]) ELSE own END', 5)} AS summed,
  {vector_text('list_transform(s, lambda q, i: CASE WHEN vec_id % 4 <> 0 THEN 0.3 * q + 0.7 * own[i] ELSE 0 END)', 5)}
    AS weighted FROM sv""")
def sid_vectors_combined(spark, sf_dir):
    rows = semantic_ids.combine_with_individual(_sid_vectors(spark, sf_dir), name="summed")
    both = semantic_ids.combine_with_individual(rows, method="scalarweight", weight=0.3,
                                                missing="zeros_if_missing", name="weighted")
    return both.select("vec_id", vector_units(F.col("summed"), 5).alias("summed"),
                       vector_units(F.col("weighted"), 5).alias("weighted"))


def _nearest_sql(name: str, points: str, centroids: str) -> str:
    """Each of ``points`` (item_id, v) with the code and the place of its nearest centroid."""
    return f"""{name} AS (SELECT item_id, v, code, c FROM {points} CROSS JOIN {centroids}
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY
    list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i]))), code) = 1)"""


def _mean_sql(name: str, assigned: str) -> str:
    return f"""{name} AS (SELECT code, list(m ORDER BY d) AS c FROM (
  SELECT code, d, avg(x) AS m FROM (SELECT code, unnest(v) AS x, unnest(range(len(v))) AS d FROM {assigned}) GROUP BY code, d)
  GROUP BY code)"""


def _first_sql(name: str, points: str, seed: int, layer: int, size: int) -> str:
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY md5('{seed}|{layer}|' || item_id), item_id) - 1 AS code, v AS c
  FROM {points} QUALIFY code < {size})"""


def fitted_sql(seed: int, sizes: list[int]) -> str:
    """Layers fitted by two updates each, from the table q0 (item_id, v, codes)."""
    parts = []
    for i, size in enumerate(sizes):
        parts += [_first_sql(f"f{i}", f"q{i}", seed, i, size), _nearest_sql(f"g{i}", f"q{i}", f"f{i}"), _mean_sql(f"h{i}", f"g{i}"),
                  _nearest_sql(f"j{i}", f"q{i}", f"h{i}"), _mean_sql(f"k{i}", f"j{i}"), _nearest_sql(f"l{i}", f"q{i}", f"k{i}"),
                  f"""w{i} AS (SELECT item_id, list_append(codes, code) AS codes, list_transform(q{i}.v, lambda x, n: x - c[n]) AS w
  FROM l{i} JOIN q{i} USING (item_id)), q{i + 1} AS (SELECT item_id, codes, {unit_sql('w')} AS v FROM w{i})"""]
    return ", ".join(parts)


_VECTOR_POINTS = f"""WITH {VECTORS}, raw AS (SELECT item_id, v AS w FROM ivec),
q0 AS (SELECT item_id, CAST([] AS BIGINT[]) AS codes, {unit_sql('w')} AS v FROM raw)"""


@check(f"""{_VECTOR_POINTS}, {fitted_sql(11, [12, 8])}
SELECT item_id, array_to_string(codes, ',') AS codes FROM q2""")
def quantizer_fit(spark, sf_dir):
    """Codes of the item vectors from a quantizer fitted to them, two updates per layer."""
    table = views.item_vectors(spark, sf_dir)
    model = quantizer.fit(table, num_layers=2, codebook_size=[12, 8], max_iterations=1, seed=11)
    return model.quantize(table).select("item_id", _code_text().alias("codes"))


@check()
def quantizer_fit_large(spark, sf_dir):
    """The same with sixteen codes a layer and three updates, more than the SQL can follow."""
    table = views.item_vectors(spark, sf_dir)
    model = quantizer.fit(table, num_layers=2, codebook_size=16, max_iterations=3, seed=11)
    return model.quantize(table).select("item_id", _code_text().alias("codes"))


@check(f"""{_VECTOR_POINTS}, dealt AS (
  SELECT *, {hash_number("'3|0|batch|' || item_id", 15)} % 2 AS batch FROM q0),
{_first_sql('f', 'q0', 3, 0, 8)}, b0 AS (SELECT * FROM dealt WHERE batch = 0), b1 AS (SELECT * FROM dealt WHERE batch = 1),
{_nearest_sql('g0', 'b0', 'f')}, {_mean_sql('m0', 'g0')},
c1 AS (SELECT f.code, coalesce(m0.c, f.c) AS c FROM f LEFT JOIN m0 USING (code)),
{_nearest_sql('g1', 'b1', 'c1')}, given AS (SELECT * FROM g0 UNION ALL SELECT * FROM g1), {_mean_sql('m1', 'given')},
c2 AS (SELECT f.code, coalesce(m1.c, f.c) AS c FROM f LEFT JOIN m1 USING (code)), {_nearest_sql('done', 'q0', 'c2')}
SELECT item_id, CAST(code AS VARCHAR) AS codes FROM done""")
def quantizer_fit_mini_batch(spark, sf_dir):
    """The same from running means over two batches."""
    table = views.item_vectors(spark, sf_dir)
    model = quantizer.fit(table, num_layers=1, codebook_size=8, max_iterations=1, seed=3, mini_batches=2)
    return model.quantize(table).select("item_id", _code_text().alias("codes"))


@check("""WITH p AS (
  SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 4 END
         + 10 * (user_id % 20) AS item_id, event_id + 1 AS pos FROM events),
h AS (SELECT (max(event_id) + 1) // 2 AS mid FROM events),
a AS (SELECT item_id, max(pos) AS last_pos, 0.9 * 1.0 + 0.1 * (max(pos) / count(*)) AS gap
      FROM p, h WHERE pos <= mid GROUP BY item_id),
a2 AS (SELECT item_id, last_pos, least(gap, 1000.0) AS gap FROM a),
b AS (SELECT item_id, max(pos) AS last, count(*) AS n FROM p, h WHERE pos > mid GROUP BY item_id)
SELECT item_id, last AS last_pos, round(least(0.9 * coalesce(gap, 1.0)
       + 0.1 * ((last - coalesce(last_pos, 0)) / n), 1000.0), 9) AS gap
FROM b LEFT JOIN a2 USING (item_id)""")
def item_frequency(spark, sf_dir):
    """Two batches of the event stream through the frequency estimate."""
    kind = F.col("event_type")
    events = views.table(spark, sf_dir, "events")
    number = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "error", 3).otherwise(4)
    rows = events.select((number + 10 * (F.col("user_id") % 20)).cast("long").alias("item_id"),
                         (F.col("event_id") + 1).alias("pos"))
    middle = events.agg(F.floor((F.max("event_id") + 1) / 2).alias("mid")).scalar()
    first = frequency.update(rows.filter(F.col("pos") <= middle), None, alpha=0.1, cap=1000.0)
    second = frequency.update(rows.filter(F.col("pos") > middle), first, alpha=0.1, cap=1000.0)
    return second.withColumn("gap", F.round("gap", 9))

