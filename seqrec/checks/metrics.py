"""Queries over evaluation metrics."""

from pyspark.sql import functions as F

from seqrec.checks.registry import check
from seqrec.checks.retrieval import (
    ALPHA,
    K,
    RATING_LOGITS,
    RERANKED,
    TOP,
    Setting,
    expert_layers,
)
from seqrec.functions import scores
from seqrec.operators import metrics
from seqrec.plans import evaluate

CUTOFFS = [1, 5, 10, 20]


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def _metric_sql(suffix: str = "", where: str = "TRUE") -> str:
    def mean(value: str) -> str:
        return f"round(coalesce(avg({value}) FILTER ({where}), 0.0), 6)"

    parts = [f"{mean(f'CASE WHEN rank <= {c} THEN 1 / log2(rank + 1) ELSE 0 END')} AS ndcg{suffix}_at_{c}"
             for c in CUTOFFS]
    parts += [f"{mean(f'CASE WHEN rank <= {c} THEN 1.0::DOUBLE ELSE 0 END')} AS hr{suffix}_at_{c}"
              for c in CUTOFFS]
    return ", ".join(parts)


def _ranks_sql(table: str) -> str:
    return f"""ranks AS (SELECT ex.user_id, target_ids, target_ser_label,
  coalesce(t.rank, {K + 1}) AS rank
  FROM ex LEFT JOIN {table} t ON t.user_id = ex.user_id AND t.item_id = target_ids)"""


def _ranks(spark, sf_dir):
    run = Setting(spark, sf_dir)
    targets = run.examples.select("user_id", "target_ids", "target_ser_label")
    return metrics.target_ranks(targets, run.ranked, K)


@check(f"{TOP}, {_ranks_sql('top')} SELECT user_id, target_ids, target_ser_label, rank FROM ranks")
def target_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


@check(f"{TOP}, {_ranks_sql('top')} SELECT {_metric_sql()}, round(avg(1 / rank), 6) AS mrr FROM ranks")
def metrics_retrieval(spark, sf_dir):
    return _rounded(metrics.retrieval(_ranks(spark, sf_dir), CUTOFFS, K))


@check(f"""{TOP}, {_ranks_sql('top')}
SELECT {_metric_sql('_ser', 'target_ser_label = 1')} FROM ranks""")
def metrics_serendipity(spark, sf_dir):
    return _rounded(metrics.serendipity(_ranks(spark, sf_dir), CUTOFFS, K))


@check(f"""{RERANKED}, {_ranks_sql('reranked')}
SELECT {_metric_sql()}, round(avg(1 / rank), 6) AS mrr FROM ranks""")
def evaluation_reranked(spark, sf_dir):
    """The whole evaluation: examples, retrieval, re-ranking, metrics."""
    run = Setting(spark, sf_dir)
    result = evaluate.evaluate(run.examples, run.candidates, K, CUTOFFS, layers=expert_layers(),
                               alpha=ALPHA)
    return _rounded(result.relevance)


_CLASSES = f"""{RATING_LOGITS}, m AS (SELECT user_id, list_max(logits) AS top FROM rl),
probs AS (
  SELECT user_id, CAST(c AS INTEGER) AS class, CAST(target_ratings AS INTEGER) - 1 AS y,
    round(CASE WHEN list_min(logits) >= 0 AND top <= 1 THEN logits[c + 1]
      ELSE exp(logits[c + 1] - top) /
           list_sum(list_transform(logits, lambda x: exp(x - top))) END, 9) AS score
  FROM rl JOIN m USING (user_id) JOIN ex USING (user_id), (SELECT unnest(range(5)) AS c))"""


def _rating_rows(spark, sf_dir):
    run = Setting(spark, sf_dir)
    targets = run.examples.select("user_id", (F.col("target_ratings").cast("int") - 1).alias("y"))
    return run.rating_logits.join(targets, "user_id")


_PER_CLASS = f"""{_CLASSES}, pts AS (
  SELECT class, score, count(*) FILTER (y = class) AS pos, count(*) FILTER (y <> class) AS neg
  FROM probs GROUP BY class, score),
curve AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM pts
          WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
quality AS (
  SELECT class, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
    CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) END AS auroc,
    CASE WHEN sum(pos) > 0 THEN sum(pos * cp / (cp + cn)) / sum(pos) END AS ap
  FROM curve GROUP BY class)"""


@check(f"""{_PER_CLASS} SELECT class, n_pos, n_neg, round(auroc, 6) AS auroc, round(ap, 6) AS ap
FROM quality""")
def metrics_per_class(spark, sf_dir):
    return _rounded(metrics.ranking_quality(_rating_rows(spark, sf_dir),
                                            metrics.probabilities(F.col("logits"), 9), F.col("y")))


@check(f"{_PER_CLASS} SELECT round(avg(auroc), 6) AS auroc, round(avg(ap), 6) AS ap FROM quality")
def metrics_multiclass(spark, sf_dir):
    per_class = metrics.ranking_quality(_rating_rows(spark, sf_dir),
                                        metrics.probabilities(F.col("logits"), 9), F.col("y"))
    return _rounded(metrics.macro_quality(per_class))


_ARGMAX = f"""{_CLASSES}, best AS (
  SELECT user_id, y, class AS predicted FROM probs
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, class) = 1)"""


@check(f"""{_ARGMAX} SELECT round(avg(CASE WHEN predicted = y THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision,
  round(avg(CASE WHEN predicted = y THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM best""")
def precision_recall_micro(spark, sf_dir):
    return _rounded(metrics.precision_recall(_rating_rows(spark, sf_dir),
                                             metrics.probabilities(F.col("logits"), 9), F.col("y")))


@check(f"""{_ARGMAX}, classes AS (SELECT predicted AS class FROM best UNION SELECT y FROM best),
pc AS (SELECT class,
   coalesce((SELECT avg(CASE WHEN y = class THEN 1.0::DOUBLE ELSE 0 END) FROM best WHERE predicted = class), 0.0) AS p,
   coalesce((SELECT avg(CASE WHEN predicted = class THEN 1.0::DOUBLE ELSE 0 END) FROM best WHERE y = class), 0.0) AS r
  FROM classes)
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM pc""")
def precision_recall_macro(spark, sf_dir):
    return _rounded(metrics.precision_recall(_rating_rows(spark, sf_dir),
                                             metrics.probabilities(F.col("logits"), 9), F.col("y"),
                                             average="macro"))


@check(f"""{RERANKED}, s AS (
  SELECT 1 / (1 + exp(-ser_logit)) AS p, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS y,
         CASE WHEN item_id % 5 <> 0 THEN 1 ELSE 0 END AS m FROM reranked)
SELECT round(sum(y * m) / greatest(sum(m), 1), 6) AS positive_rate,
       round(sum(p * m) / greatest(sum(m), 1), 6) AS mean_probability,
       round(sum(CASE WHEN (p >= 0.5) = (y = 1) THEN m ELSE 0 END) / greatest(sum(m), 1), 6) AS accuracy
FROM s""")
def label_statistics(spark, sf_dir):
    rows = Setting(spark, sf_dir).logits
    return _rounded(metrics.label_statistics(
        rows, scores.sigmoid(F.col("ser_logit")), (F.col("item_id") % 3 == 0).cast("int"),
        F.col("item_id") % 5 != 0))
