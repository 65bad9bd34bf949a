"""Pairs carry the sums of the first layer, not the vectors."""

from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrec.checks import retrieval as checks
from seqrec.operators import rerank, retrieval


def _tables(spark):
    rng = np.random.default_rng(3)
    users = [(u, rng.normal(size=6).tolist()) for u in range(5)] + [(9, None)]
    items = [(i, rng.normal(size=6).tolist()) for i in range(7)] + [(10, None)]
    items.append((11, items[2][1]))
    ranked = [(u, r, i, 0.5) for u in range(5) for r, i in enumerate([u, 2, 11], 1)]
    return (spark.createDataFrame(ranked, "user_id long, rank int, item_id long, score double"),
            spark.createDataFrame(users, "user_id long, embedding array<double>"),
            spark.createDataFrame(items, "item_id long, embedding array<double>"))


@pytest.mark.parametrize("hidden", [2, 6])
def test_same_logits(spark, hidden):
    rng = np.random.default_rng(5)
    layers = [(rng.normal(size=(hidden, 12)).tolist(), rng.normal(size=hidden).tolist()), (rng.normal(size=(1, hidden)).tolist(), [0.3])]
    ranked, users, items = _tables(spark)

    def logits(users, items, layers):
        pairs = retrieval.attach_pair_vectors(ranked, users, items)
        return {(r["user_id"], r["rank"]): (r["item_id"], r["ser_logit"]) for r in rerank.expert_logits(pairs, layers).collect()}

    whole, split = logits(users, items, layers), logits(*rerank.narrowed(users, items, layers))
    assert len(whole) == 15 and whole.keys() == split.keys()
    for key, (item, logit) in whole.items():
        assert split[key][0] == item and split[key][1] == pytest.approx(logit, abs=1e-12)
    # equal vectors keep equal logits: the former rank decides
    assert all(split[u, 2][1] == split[u, 3][1] for u in range(5))
    narrow = rerank.narrowed(users, items, layers)
    widths = {r[0] for t in narrow[:2] for r in t.filter("embedding is not null").select(F.size("embedding")).collect()}
    assert widths == ({2} if hidden == 2 else {6})
    assert narrow[0].filter("embedding is null").count() == 1


def test_queries_attach_sums(spark, sf_dir):
    """The vectors that the pairs of the registered queries travel with."""
    with mock.patch.object(retrieval, "attach_pair_vectors", side_effect=retrieval.attach_pair_vectors) as call:
        run = checks.Setting(spark, sf_dir)
        assert run.logits.count()
    users, items = call.call_args.args[1:3]
    assert users.select(F.max(F.size("embedding"))).first()[0] == checks.HIDDEN
    assert items.select(F.max(F.size("embedding"))).first()[0] == checks.HIDDEN


def test_a_table_read_in_many_parts_stays(spark, tmp_path):
    from seqrec.plans import views

    spark.range(0, 200_000, 1, 1).write.option("parquet.block.size", 65536).parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        many = spark.read.parquet(f"{tmp_path}/t")
        assert len(many.inputFiles()) == 1 and "Repartition" not in views.dealt_out(many)._jdf.queryExecution().logical().toString()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        few = spark.read.parquet(f"{tmp_path}/t").limit(100_000)
        assert views.dealt_out(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
