"""Published tables and the chunk ledger: torn writes, two writers, interrupted runs."""

import pytest
from pyspark.sql import functions as F

from seqrec.sinks import ledger, published, tables


def lookup(spark, *keys):
    return spark.createDataFrame([(i, k.upper(), k) for i, k in enumerate(keys)], "normalized_id long, original_id string, key string")


def test_what_is_not_published_is_not_there(spark, tmp_path):
    root = f"file://{tmp_path}/users"
    with pytest.raises(FileNotFoundError):
        tables.read_lookup(spark, root)
    assert tables.write_lookup(lookup(spark, "a"), root) == 0
    # another writer is in the midst of its files
    lookup(spark, "x", "y", "z").write.parquet(f"{root}/data-unfinished")
    assert [r["key"] for r in tables.read_lookup(spark, root).collect()] == ["a"]
    assert tables.write_lookup(lookup(spark, "a", "b"), root) == 1
    assert {r["key"] for r in tables.read_lookup(spark, root).collect()} == {"a", "b"}
    assert [r["key"] for r in tables.read_lookup(spark, root, 0).collect()] == ["a"]
    found = published.manifests(spark, root)
    assert {n: m.rows for n, m in found.items()} == {0: 1, 1: 2}
    with pytest.raises(FileNotFoundError):
        tables.read_lookup(spark, root, 7)


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/users"
    broken = lookup(spark, "a").withColumn("key", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.write_lookup(broken, root)
    assert published.manifests(spark, root) == {}


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    """The second writer finishes its files after the first has published the same number."""
    root = f"file://{tmp_path}/items"
    real, late = published.manifests, []

    def before_the_other(spark_, root_):
        found = real(spark_, root_)
        if not late:
            late.append(True)
            monkeypatch.setattr(published, "manifests", real)
            tables.write_lookup(lookup(spark, "theirs"), root, 3)
        return found

    monkeypatch.setattr(published, "manifests", before_the_other)
    with pytest.raises(published.NumberTaken):
        tables.write_lookup(lookup(spark, "mine"), root, 3)
    assert [r["key"] for r in tables.read_lookup(spark, root, 3).collect()] == ["theirs"]
    # without a number the later writer takes the next one
    assert tables.write_lookup(lookup(spark, "mine"), root) == 4
    with pytest.raises(published.NumberTaken):
        tables.write_lookup(lookup(spark, "again"), root, 4)


def embedder(number, calls):
    def embed(rows):
        calls.append(sorted(r["item_id"] for r in rows.select("item_id").collect()))
        kept = rows.filter("text <> ''")
        return kept.select("item_id", F.array(F.lit(float(number))).alias("embedding"))

    return embed


def test_interrupted_run_resumes(spark, tmp_path):
    root, calls = f"file://{tmp_path}/vectors", []
    texts = spark.createDataFrame([(f"i{i:02d}", "" if i == 5 else "t") for i in range(10)], "item_id string, text string")
    chunks = ledger.ChunkLedger(spark, root, 3)
    with pytest.raises(FileNotFoundError):
        chunks.read()
    state = chunks.run(texts, embedder(1, calls), chunks_per_wave=1, most_waves=2)
    assert (state.planned_chunks, state.finished_chunks, state.finished_rows, state.complete) == (4, 2, 5, False)
    assert calls == [["i00", "i01", "i02"], ["i03", "i04", "i05"]]

    def lost(rows):
        return rows.select("item_id", F.raise_error(F.lit("lost")).cast("array<double>").alias("embedding"))

    with pytest.raises(Exception, match="lost"):
        chunks.run(texts, lost)
    assert chunks.state() == state
    spark.createDataFrame([("i06", [9.0], 2)], "item_id string, embedding array<double>, chunk int") \
         .write.partitionBy("chunk").parquet(f"{root}/chunks/data-torn")
    more = texts.unionByName(spark.createDataFrame([("i00", "t"), ("a", "t"), (None, "t")], "item_id string, text string")).dropDuplicates(["item_id"])
    calls.clear()
    state = chunks.run(more, embedder(2, calls), chunks_per_wave=2)
    assert state.complete and (state.planned_chunks, state.finished_chunks, state.finished_rows) == (5, 5, 10)
    assert sorted(sum(calls, [])) == ["a", "i06", "i07", "i08", "i09"]
    rows = {r["item_id"]: r["embedding"][0] for r in chunks.read().collect()}
    assert rows == {f"i{i:02d}": 1.0 if i < 5 else 2.0 for i in range(10) if i != 5} | {"a": 2.0}
    assert chunks.read().count() == len(rows)
    calls.clear()
    assert chunks.run(more, embedder(3, calls)) == state and calls == []


def test_repeated_items_and_nothing(spark, tmp_path):
    texts = spark.createDataFrame([("a", "t"), ("a", "t")], "item_id string, text string")
    chunks = ledger.ChunkLedger(spark, f"file://{tmp_path}/twice", 2)
    with pytest.raises(ValueError, match="more than once"):
        chunks.run(texts, embedder(1, []))
    empty = ledger.ChunkLedger(spark, f"file://{tmp_path}/none", 2)
    assert empty.run(texts.limit(0), embedder(1, [])) == ledger.State(0, 0, 0, 0, False)
    with pytest.raises(ValueError):
        ledger.ChunkLedger(spark, "x", 0)


def test_many_waves_read_each_manifest_once(spark, tmp_path, monkeypatch):
    """Many small waves: no manifest is read twice, the texts are dealt once, and the waves are read back together."""
    real, opened = published._text, []
    monkeypatch.setattr(published, "_text", lambda spark_, path: opened.append(path) or real(spark_, path))
    texts = spark.createDataFrame([(f"i{i:03d}", "t") for i in range(40)], "item_id string, text string")
    calls, chunks = [], ledger.ChunkLedger(spark, f"file://{tmp_path}/many", 2)
    state = chunks.run(texts, embedder(1, calls), chunks_per_wave=1)
    assert state.complete and state.finished_chunks == 20 and calls == [[f"i{i:03d}", f"i{i + 1:03d}"] for i in range(0, 40, 2)]
    assert len(opened) == len(set(opened)) == 22  # the plan, the waves and the last entry
    entries = published.manifests(spark, f"file://{tmp_path}/many/chunks")
    assert [list(entries[n].notes["chunks"]) for n in range(20)] == [[str(n)] for n in range(20)]
    found = chunks.read()
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Relation") == 1
    assert sorted(r["item_id"] for r in found.collect()) == [f"i{i:03d}" for i in range(40)]
