"""Queries over top-k retrieval and re-ranking."""

from functools import cached_property

from pyspark.sql import functions as F

from seqrec.checks.examples import _example_sql
from seqrec.checks.registry import AGED, VECTORS, check, vector_text, vector_units
from seqrec.functions import arrays
from seqrec.operators import examples, metrics, rerank, retrieval
from seqrec.plans import evaluate, views
from seqrec.session import cut_lineage

K = 20
LENGTH = 50
ALPHA = 0.5
HIDDEN = 4
BLOCK_BYTES = 200_000


def expert_layers() -> list:
    """A small fixed network on two 64-dimensional vectors."""
    first = [[((h * 7 + d * 3) % 11 - 5) / 10.0 for d in range(128)] for h in range(HIDDEN)]
    bias = [(h - 1) / 10.0 for h in range(HIDDEN)]
    return [(first, bias), ([[1.0, -0.5, 0.75, 0.25]], [0.1])]


def _sql_list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


_LAYERS = expert_layers()
_LOGIT_SQL = " + ".join(
    [repr(_LAYERS[1][1][0])] +
    [f"({w!r}) * greatest(0.0, list_inner_product(z, {_sql_list(_LAYERS[0][0][h])}) + ({_LAYERS[0][1][h]!r}))"
     for h, w in enumerate(_LAYERS[1][0][0])])

# ids are shifted by one, as in the examples
QUERIES = f"""WITH {AGED}, {VECTORS},
{_example_sql(LENGTH, 0, newest_first=False, pad=False)},
cand AS (SELECT item_id + 1 AS item_id,
         list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-6)) AS v FROM ivec),
query AS (SELECT user_id, c.v AS q, historical_ids AS history
          FROM ex JOIN cand c ON c.item_id = historical_ids[history_lengths] WHERE history_lengths > 0)"""
TOP = QUERIES + f""", scored AS (
  SELECT user_id, item_id, list_inner_product(q, v) AS score, history FROM query CROSS JOIN cand),
top AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)
                             AS INTEGER) AS rank, item_id, score
        FROM scored WHERE NOT list_contains(history, item_id) QUALIFY rank <= {K})"""


class Setting:
    """The tables of a retrieval run; those that are read repeatedly are written once."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def candidates(self):
        table = views.item_vectors(self.spark, self.sf_dir).withColumn("item_id", F.col("item_id") + 1)
        return cut_lineage(retrieval.candidates(table.select("item_id"), table))

    @cached_property
    def examples(self):
        return cut_lineage(examples.build(views.interactions(self.spark, self.sf_dir),
                                          max_length=LENGTH, chronological=True, pad=False))

    @cached_property
    def queries(self):
        return cut_lineage(evaluate.query_vectors(self.examples, self.candidates))

    @cached_property
    def ranked(self):
        return retrieval.top_k(self.queries, self.candidates, K, exclude="history")

    @cached_property
    def logits(self):
        users, items, layers = rerank.narrowed(self.queries, self.candidates, expert_layers())
        pairs = retrieval.attach_pair_vectors(self.ranked, users, items)
        return rerank.expert_logits(pairs, layers).drop("user_vector", "item_vector")

    @cached_property
    def rating_logits(self):
        return rerank.rating_logits(self.queries, rating_vectors())


@check(f"""{QUERIES}, scored AS (
  SELECT user_id, item_id, list_inner_product(q, v) AS score FROM query CROSS JOIN cand)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER)
       AS rank, item_id, round(score, 6) AS score FROM scored QUALIFY rank <= {K}""")
def topk_inner_product(spark, sf_dir):
    run = Setting(spark, sf_dir)
    best = retrieval.top_k(run.queries, run.candidates, K)
    return best.withColumn("score", F.round("score", 6))


@check(f"{TOP} SELECT user_id, rank, item_id, round(score, 6) AS score FROM top")
def topk_excluding_history(spark, sf_dir):
    return Setting(spark, sf_dir).ranked.withColumn("score", F.round("score", 6))


@check(f"{TOP} SELECT user_id, rank, item_id, round(score, 6) AS score FROM top")
def topk_best_first(spark, sf_dir):
    """The same lists with the items in several blocks, met in the order of their bounds."""
    run = Setting(spark, sf_dir)
    best = retrieval.top_k(run.queries, run.candidates, K, exclude="history", block_bytes=BLOCK_BYTES)
    return best.withColumn("score", F.round("score", 6))


@check(f"""{QUERIES}
SELECT user_id, (SELECT count(*) FROM cand) - len(list_distinct(history)) AS n_candidates FROM query""")
def valid_candidates(spark, sf_dir):
    run = Setting(spark, sf_dir)
    return retrieval.valid_candidates(run.queries, run.candidates, "history")


@check(f"""{TOP} SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS top_k_ids,
  string_agg(CAST(CAST(round(score * 1e5) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS top_k_scores
FROM top GROUP BY user_id""")
def prediction_lists(spark, sf_dir):
    lists = retrieval.prediction_lists(Setting(spark, sf_dir).ranked)
    return lists.select("user_id", arrays.format_sequence(F.col("top_k_ids")).alias("top_k_ids"),
                        vector_units("top_k_scores", 5).alias("top_k_scores"))


@check(f"""{TOP}, lists AS (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank)
                            AS top_k_ids FROM top GROUP BY user_id)
SELECT user_id, history_lengths, target_ids, top_k_ids FROM ex LEFT JOIN lists USING (user_id)""")
def predictions_with_sequences(spark, sf_dir):
    """Prediction lists next to the examples; users without a history have none."""
    run = Setting(spark, sf_dir)
    joined = evaluate.predict(run.examples, run.candidates, K,
                              run.examples.select("user_id", "history_lengths", "target_ids"))
    return joined.select("user_id", "history_lengths", "target_ids",
                         arrays.format_sequence(F.col("top_k_ids")).alias("top_k_ids"))


@check(f"""WITH {AGED}, {VECTORS}
SELECT user_id, {vector_text('v')} AS query FROM aged JOIN ivec USING (item_id) WHERE age = 1""")
def query_vectors_last_item(spark, sf_dir):
    found = retrieval.last_item_queries(views.interactions(spark, sf_dir),
                                        views.item_vectors(spark, sf_dir))
    return found.select("user_id", vector_units("embedding").alias("query"))


LOGITS = TOP + f""", pairs AS (
  SELECT top.*, list_concat(q, v) AS z FROM top JOIN query USING (user_id) JOIN cand USING (item_id)),
logits AS (SELECT user_id, rank, item_id, score, {_LOGIT_SQL} AS ser_logit FROM pairs)"""


@check(f"{LOGITS} SELECT user_id, item_id, round(ser_logit, 6) AS ser_logit FROM logits")
def expert_logits(spark, sf_dir):
    return Setting(spark, sf_dir).logits.select("user_id", "item_id",
                                        F.round("ser_logit", 6).alias("ser_logit"))


RERANKED = LOGITS + f""", combined AS (
  SELECT user_id, rank AS old_rank, item_id, score, ser_logit,
         score + {ALPHA} / (1 + exp(-ser_logit)) * ln(1 + exp(ser_logit)) AS combined_score FROM logits),
reranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(combined_score, 9) DESC, old_rank)
                 AS INTEGER) AS rank FROM combined)"""


@check(f"""{RERANKED} SELECT user_id, rank, item_id, round(score, 5) AS score,
  round(combined_score, 5) AS combined_score FROM reranked""")
def serendipity_rerank(spark, sf_dir):
    best = rerank.rerank(Setting(spark, sf_dir).logits, ALPHA)
    return best.select("user_id", "rank", "item_id", F.round("score", 5).alias("score"),
                       F.round("combined_score", 5).alias("combined_score"))


@check(f"""{RERANKED} SELECT round(avg(score), 6) AS mean_score,
  round(avg(combined_score), 6) AS mean_combined_score FROM reranked""")
def mean_scores(spark, sf_dir):
    means = metrics.mean_scores(rerank.rerank(Setting(spark, sf_dir).logits, ALPHA))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


def rating_vectors() -> list:
    return [[((r * 5 + d) % 7 - 3) / 4.0 for d in range(64)] for r in range(5)]


_RATING_SQL = ", ".join(
    f"list_inner_product(u, {_sql_list(r)}) / sqrt(list_inner_product({_sql_list(r)}, {_sql_list(r)}))"
    for r in rating_vectors())
RATING_LOGITS = f"""{QUERIES}, unit AS (
  SELECT user_id, list_transform(q, lambda x: x / greatest(sqrt(list_inner_product(q, q)), 1e-6)) AS u
  FROM query),
rl AS (SELECT user_id, [{_RATING_SQL}] AS logits FROM unit)"""


@check(f"{RATING_LOGITS} SELECT user_id, {vector_text('logits', 5)} AS logits FROM rl")
def rating_logits(spark, sf_dir):
    rows = Setting(spark, sf_dir).rating_logits
    return rows.select("user_id", vector_units("logits", 5).alias("logits"))
