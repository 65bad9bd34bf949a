"""Examples to retrieved lists, metrics and predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.operators import metrics, rerank, retrieval, skew
from seqrec.session import cut_lineage
from seqrec.sinks.tables import predictions_with_sequences


@dataclass
class Evaluation:
    ranked: DataFrame
    ranks: DataFrame
    relevance: DataFrame
    serendipity: DataFrame


def query_vectors(examples: DataFrame, table: DataFrame, *, user: str = "user_id",
                  hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(user, embedding, history) from chronological, unpadded examples.

    The query is the vector of the last item of the history; users with an
    empty history have none and are left out.
    """
    last = examples.filter(F.col("history_lengths") > 0).select(
        user, F.element_at("historical_ids", -1).alias("item_id"),
        F.col("historical_ids").alias("history"))
    found = skew.spread_join(last, table.select("item_id", "embedding"), ["item_id"],
                             hot_rows=hot_rows)
    return found.select(user, "embedding", "history")


def retrieve(queries: DataFrame, candidates: DataFrame, k: int, *, exclude_history: bool = True,
             layers: Sequence[rerank.Layer] | None = None, alpha: float = 0.0,
             user: str = "user_id", **options) -> DataFrame:
    """Top-k lists, re-ranked by the serendipity network when one is given."""
    ranked = retrieval.top_k(queries, candidates, k, user=user,
                             exclude="history" if exclude_history else None, **options)
    if layers is None:
        return ranked
    queries, candidates, layers = rerank.narrowed(queries, candidates, layers)
    pairs = retrieval.attach_pair_vectors(ranked, queries, candidates, user=user)
    scored = rerank.expert_logits(pairs, layers).drop("user_vector", "item_vector")
    return rerank.rerank(scored, alpha, user=user)


Store = Callable[[DataFrame], DataFrame]


def evaluate(examples: DataFrame, candidates: DataFrame, k: int, cutoffs: Sequence[int], *,
             ser_cutoffs: Sequence[int] | None = None, queries: DataFrame | None = None,
             user: str = "user_id", store: Store = cut_lineage, **options) -> Evaluation:
    """Ranking metrics of the targets of ``examples``; a user without a list is a miss.

    Queries, lists and ranks are read by several steps and written once (``store``).
    """
    if queries is None:
        queries = store(query_vectors(examples, candidates, user=user))
    ranked = store(retrieve(queries, candidates, k, user=user, **options))
    targets = examples.select(user, "target_ids", "target_ser_label")
    ranks = store(metrics.target_ranks(targets, ranked, k, user=user))
    return Evaluation(ranked, ranks, metrics.retrieval(ranks, cutoffs, k),
                      metrics.serendipity(ranks, ser_cutoffs or cutoffs, k))


def predict(examples: DataFrame, candidates: DataFrame, k: int, test_sequences: DataFrame, *,
            user: str = "user_id", store: Store = cut_lineage, **options) -> DataFrame:
    """Prediction lists next to the test sequences."""
    queries = store(query_vectors(examples, candidates, user=user))
    ranked = retrieve(queries, candidates, k, user=user, **options)
    return predictions_with_sequences(retrieval.prediction_lists(ranked, user=user),
                                      test_sequences, user=user)
