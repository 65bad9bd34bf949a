"""The corpus pipeline: every stage against a plain version of its decision, on its own input."""

import duckdb
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from seqrec.llm import decontaminate, langid, mixing, queries, shards
from seqrec.session import cut_lineage

from .test_minhash import plain_rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = cut_lineage(stage(spark, docs, sf_dir))
        assert docs.columns[:len(columns)] == columns
        if name != "shards":
            assert docs.columns == columns
    inputs["end"] = docs
    kept = {name: {r["doc_id"] for r in df.collect()} for name, df in inputs.items()}

    model = langid.fit(inputs["language_id"]).classifier()
    scored = {r["doc_id"]: model.predict(r["text"]) for r in inputs["language_id"].collect()}
    assert kept["simhash"] == {i for i, (lang, score) in scored.items() if lang != "und" and score >= corpus_pipeline.MIN_SCORE}

    rows, _ = plain_rows([(r["doc_id"], r["text"]) for r in inputs["simhash"].collect()], n=5, empty_alike=True)
    assert kept["decontaminate"] == {component for _, _, component in rows}
    assert len(kept["decontaminate"]) < len(rows)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = inputs["decontaminate"].collect()
    hits = decontaminate.matches(decontaminate.build_index(items), pa.array([r["text"] for r in texts]))
    assert kept["mixture"] == {r["doc_id"] for r, hit in zip(texts, hits) if not hit}

    connection = duckdb.connect()
    documents = inputs["mixture"].toPandas()  # noqa: F841
    sql = f"WITH {queries.mix_sql(corpus_pipeline.FRACTION, 1)} SELECT doc_id FROM mixed WHERE copies > 0"
    assert kept["shards"] == {r[0] for r in connection.execute(sql).fetchall()}

    documents = inputs["shards"].toPandas()  # noqa: F841
    sql = queries.SQL["op10_shards"]
    want = {(r[0], r[4], r[5]) for r in connection.execute(sql).fetchall()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in docs.collect()} == want
    assert len(kept["end"]) == len(kept["shards"])

    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(docs)


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    assert docs.columns[:len(odd_docs.columns)] == odd_docs.columns
    kept = sorted((r["doc_id"] or 0) for r in docs.collect())
    # null, empty and wordless texts have no language; 6 is a copy of 1, which is there twice
    assert set(kept) <= {0, 1, 5, 8} and len(kept) >= 2
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    assert docs.count() == 0


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and mixing.SEED != shards.SEED
