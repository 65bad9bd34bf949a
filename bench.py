"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from seqrec.checks import retrieval as checks  # noqa: E402
from seqrec.operators import ids, metrics, quantizer, retrieval, semantic_ids, sequences  # noqa: E402
from seqrec.plans import evaluate, prepare, views  # noqa: E402
from seqrec.session import RECOMMENDED_CONF, cut_lineage, ship_package  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CUTOFFS = [10, 50, 100, 200]


def run(df) -> None:
    """Compute every column of every row without keeping the result."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    builder = (SparkSession.builder.master(f"local[{CPUS}]").appName("seqrec-bench")
               .config("spark.sql.shuffle.partitions", CPUS)
               .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
               .config("spark.ui.enabled", "false"))
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()  # start-up
    seconds: dict[str, float] = {}

    def timed(name, step):
        started = time.perf_counter()
        result = step()
        seconds[name] = round(time.perf_counter() - started, 3)
        return result

    ratings = views.named_interactions(spark, SF_DIR)
    holdout = views.holdout_pairs(spark, SF_DIR)
    prepared = timed("prepare_product_ratings", lambda: prepare.prepare_product_ratings(
        ratings, holdout, minimum=5, min_length=3))
    timed("write_sequences", lambda: run(prepared.sequences()))
    timed("length_statistics", lambda: prepared.statistics().collect())
    timed("examples_train", lambda: run(prepared.split(max_length=200)["train"]))

    rows = views.interactions(spark, SF_DIR)
    timed("lookup_items", lambda: run(ids.assign_ids(ids.raw_keys(rows, "item_id", ["ord"]))))
    timed("next_item_pairs", lambda: run(sequences.next_item_pairs(rows)))

    setting = checks.Setting(spark, SF_DIR)
    timed("examples_and_queries", lambda: setting.queries)
    result = {}

    def top200():
        best = retrieval.top_k(setting.queries, setting.candidates, 200, exclude="history")
        result["ranked"] = cut_lineage(best)

    timed("topk_200_excluding_history", top200)

    def scored():
        targets = setting.examples.select("user_id", "target_ids", "target_ser_label")
        ranks = cut_lineage(metrics.target_ranks(targets, result["ranked"], 200))
        metrics.retrieval(ranks, CUTOFFS, 200).collect()
        metrics.serendipity(ranks, [5, *CUTOFFS], 200).collect()

    timed("metrics", scored)
    timed("evaluate_reranked", lambda: evaluate.evaluate(
        setting.examples, setting.candidates, 200, CUTOFFS, layers=checks.expert_layers(),
        alpha=0.5).relevance.collect())

    vectors = setting.candidates
    model = timed("quantizer_fit", lambda: quantizer.fit(
        vectors, num_layers=3, codebook_size=256, max_iterations=5, seed=1))
    timed("quantize_and_slots", lambda: run(semantic_ids.dedup_slots(
        model.quantize(vectors), ["item_id"], cardinality=None)))

    print(json.dumps({"metric": "total_wall_time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
