"""Readers, writers, whole jobs and streams on small files."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrec.operators import examples, item_text, quantizer, sequences
from seqrec.plans import evaluate, prepare, semantic
from seqrec.sinks import ledger, tables
from seqrec.sources import catalogue, embeddings, ratings, registry
from seqrec.streaming import frequency, lookups

FLAGS = ratings.FLAG_COLUMNS


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


# sources

def test_ratings_with_header(spark, tmp_path):
    path = write(tmp_path / "r.csv", ["userId,movieId,rating,unix_timestamp,note",
                                      "1,10,4.5,100,x", "2,11,3,90,y"])
    df = ratings.read_ratings(spark, path, extra=["note"])
    assert df.columns == ["user_id", "item_id", "rating", "ts", "note", "ord"]
    assert [r["user_id"] for r in df.orderBy("ord").collect()] == ["1", "2"]
    with pytest.raises(ValueError, match="missing"):
        ratings.read_ratings(spark, path, extra=["absent"])


def test_order_follows_files_and_rows(spark, tmp_path):
    for name, start in (("b", 100), ("a", 0)):
        write(tmp_path / "many" / f"{name}.csv", [f"u{start + i},i,1.0,5" for i in range(50)])
    df = ratings.read_headerless_ratings(spark, str(tmp_path / "many")).repartition(4)
    got = [r["user_id"] for r in df.orderBy("ord").collect()]
    assert got == [f"u{i}" for i in [*range(50), *range(100, 150)]]


def test_column_fallback(spark, tmp_path):
    path = write(tmp_path / "t.csv", ["userId,other", "5,x"])
    df = ratings.read_columns(spark, path, ["user_id"], {"user_id": "userId"})
    assert df.columns == ["user_id"] and df.first()["user_id"] == "5"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan.split("ReadSchema")[1]


def test_catalogue_lines(spark, tmp_path):
    path = write(tmp_path / "m.csv", ["﻿movieId,title", '"7",A, with comma', " 8 ,B", "", "7,again",
                                      ",none", "movieId,kept"])
    got = catalogue.read_catalogue_ids(spark, path).orderBy("ord").collect()
    assert [r["item_id"] for r in got] == ["7", "8", "movieId"]


def test_product_records(spark, tmp_path):
    lines = ["{'asin': 'A1', 'title': \"It's\", 'categories': [['Books', 'Art']], 'extra': None, 'b': True}",
             "{'asin': u'B2', 'categories': 'Flat  text', 'description': ' two  words '}",
             "{'asin': 'C3', 'categories': ['x', 'y']}", "{broken", "", "{'title': 'no id'}", "[1, 2]"]
    path = write(tmp_path / "meta.txt", lines)
    got = {r["item_id"]: r["text"] for r in registry.read_items(spark, "products", path).collect()}
    assert got == {"A1": "asin: A1 [SEP] title: It's [SEP] categories: Books > Art",
                   "B2": "asin: B2 [SEP] categories: Flat text [SEP] description: two words",
                   "C3": "asin: C3 [SEP] categories: x; y"}
    bad = catalogue.malformed_lines(catalogue.parse_products(spark.read.text(path))).first()
    assert (bad["malformed"], bad["lines"]) == (2, 6)


def test_movie_records(spark, tmp_path):
    path = tmp_path / "movies.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["movieId", "title", "releaseDate", "directedBy", "starring", "genres"])
        out.writerow(["1", 'Quote "x", and\nline', "1999", "D", "", "a|b"])
        out.writerow(["2", "", "", "", "", " "])
    got = {r["item_id"]: r["text"] for r in registry.read_items(spark, "movies", str(path)).collect()}
    assert got == {"1": 'title: Quote "x", and line [SEP] releaseDate: 1999 [SEP] directedBy: D [SEP] genres: a|b',
                   "2": "movieId: 2"}
    with pytest.raises(ValueError):
        registry.read_items(spark, "other", str(path))


def test_embedding_files(spark, tmp_path):
    table = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(25)],
                                  "item_id string, embedding array<float>").coalesce(1)
    path = str(tmp_path / "emb")
    tables.write_embeddings(table, path, rows_per_file=10)
    assert len(list((tmp_path / "emb").glob("*.parquet"))) == 3
    source = embeddings.resolve_sources(path_glob=path + "/*.parquet")
    assert embeddings.read_embeddings(spark, source, dim=2).count() == 25
    with pytest.raises(Exception, match="expected 3"):
        embeddings.read_embeddings(spark, [path], dim=3).collect()
    assert embeddings.read_embeddings(spark, source).count() == 25
    ragged = str(tmp_path / "ragged")
    tables.write_embeddings(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], table.schema), ragged)
    with pytest.raises(Exception, match="expected 2 entries, found 1"):
        embeddings.read_embeddings(spark, [ragged]).collect()
    for bad in ({}, {"path": "a", "paths": ["b"]}):
        with pytest.raises(ValueError):
            embeddings.resolve_sources(**bad)


# sinks

def test_resume_embeds_only_what_is_missing(spark, tmp_path):
    path, calls = str(tmp_path / "emb"), []

    def embed(texts):
        calls.append(sorted(r["item_id"] for r in texts.collect()))
        return texts.select("item_id", F.array(F.lit(1.0)).alias("embedding"))

    def texts(ids_):
        return spark.createDataFrame([(i, "t") for i in ids_], "item_id string, text string")

    tables.append_missing_embeddings(texts("ab"), embed, path)
    tables.append_missing_embeddings(texts("abc"), embed, path)
    assert calls == [["a", "b"], ["c"]]
    assert sorted(r["item_id"] for r in ledger.ChunkLedger(spark, path).read().collect()) == ["a", "b", "c"]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_once(spark.range(3), path)
    tables.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    tables.write_once(spark.range(9), path, overwrite=True)
    assert spark.read.parquet(path).count() == 9


def test_sequence_text_files(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, 5, 2.0), (1, 2, 3, 1.0), (1, 1, 4, 3.0)],
                               "user_id long, ts long, item_id long, rating double")
    chunks = sequences.chunked(sequences.positions(df, order=["ts"]))
    tables.write_sequence_text(chunks, str(tmp_path / "s"), {"item_id": "sequence_item_ids"})
    back = ratings.read_sequences(spark, str(tmp_path / "s")).orderBy("index").collect()
    assert [tuple(r) for r in back] == [("0", "1", "0", "4,3"), ("1", "2", "0", "5")]


def test_encoded_ratings_are_sorted(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 7).alias("user_id"), (199 - F.col("id")).alias("ts"),
                                 F.col("id").alias("ord")).repartition(6)
    tables.write_encoded_ratings(df, str(tmp_path / "r"))
    for file in sorted((tmp_path / "r").glob("*.parquet")):
        rows = [tuple(r) for r in spark.read.parquet(str(file)).collect()]
        assert rows == sorted(rows)


def test_quantizer_files(spark, tmp_path):
    table = spark.createDataFrame([(str(i), [float(i % 3), float(i % 5)]) for i in range(30)],
                                  "item_id string, embedding array<double>")
    model = quantizer.fit(table, num_layers=2, codebook_size=3, seed=1, normalize=False)
    tables.write_quantizer(model, model.quantize(table), str(tmp_path / "q"))
    back = tables.read_quantizer(spark, str(tmp_path / "q"))
    assert back.normalize is False
    assert all(np.array_equal(a, b) for a, b in zip(model.codebooks, back.codebooks))


# jobs

HEADER = "userId,movieId,rating,timestamp"


def test_prepare_labelled_answers(spark, tmp_path):
    rows = [("u1", "m1", "4", "10", "true"), ("u1", "m2", "5", "20", "FALSE"), ("u2", "m1", "3", "5", "x"),
            ("u1", "m9", "2", "10", "TRUE")]
    path = write(tmp_path / "a.csv", [HEADER + "," + ",".join(FLAGS)] +
                 [",".join(r[:4]) + "," + r[4] + ",false" * (len(FLAGS) - 1) for r in rows])
    cat = write(tmp_path / "m.csv", ["movieId,title", "m5,x", "m1,y"])
    users = write(tmp_path / "t.csv", ["userId,x", "u7,1", "u2,1", "u7,2"])
    done = prepare.prepare_labelled_answers(
        ratings.read_ratings(spark, path, extra=FLAGS),
        catalogue=catalogue.read_catalogue_ids(spark, cat),
        training_users=ratings.read_columns(spark, users, ["user_id"], {"user_id": "userId"}, ordered=True),
        min_length=2)

    def pairs(lookup):
        return {r["original_id"]: r["normalized_id"] for r in lookup.collect()}

    assert pairs(done.user_lookup) == {"u7": 0, "u2": 1, "u1": 2}
    assert pairs(done.item_lookup) == {"m5": 0, "m1": 1, "m2": 2, "m9": 3}
    seq = done.sequences().collect()
    assert len(seq) == 1 and seq[0]["user_id"] == 2
    assert [(e["item_id"], e["rating"], e["ser_label"]) for e in seq[0]["seq"]] == [(1, 4.0, 1), (3, 2.0, 1), (2, 5.0, 0)]
    stats = done.statistics().first()
    assert (stats["min_length"], stats["users"]) == (3, 1)
    assert done.item_statistics().first()["num_items"] == 4
    split = done.split(max_length=5, chronological=True)
    train, test = split["train"].first(), split["test"].first()
    assert (train["target_ids"], train["historical_ids"][:2]) == (4, [2, 0])
    assert (test["target_ids"], test["historical_ids"][:3]) == (3, [2, 4, 0])
    assert test["target_ser_label"] == 0 and train["target_ser_label"] == 1


def test_prepare_generic_ratings(spark, tmp_path):
    path = write(tmp_path / "r.csv", [HEADER, "b,2,1,7", "a,2,1,8", "a,1,1,9", "b,1,2,3", "c,3,1,1"])
    done = prepare.prepare_ratings(ratings.read_ratings(spark, path), minimum=2)
    assert [r["original_id"] for r in done.user_lookup.orderBy("normalized_id").collect()] == ["b", "a"]
    assert done.ratings.count() == 4
    bad = write(tmp_path / "bad.csv", [HEADER, "b,2,one,7"])
    with pytest.raises(Exception, match="not numeric"):
        prepare.prepare_ratings(ratings.read_ratings(spark, bad))


def test_product_then_holdout_share_lookups(spark, tmp_path):
    lines = [f"U{i % 3},I{i % 4},{i % 5 + 1}.0,{100 + i}" for i in range(24)] + ["U0,I9,,5"]
    base = ratings.read_headerless_ratings(spark, write(tmp_path / "p.csv", lines))
    held = write(tmp_path / "h.csv", ["user_id,item_id,rating,timestamp,label", "u1,i1,5,900,1",
                                      "u1,I7,4,901,0", "NEW,i2,bad,902,1", "u8,i2,3,903,1"])
    pairs = ratings.read_columns(spark, held, ["user_id", "item_id"])
    first = prepare.prepare_product_ratings(base, pairs, minimum=2)
    assert first.ratings.count() == 24 - len([i for i in range(24) if i % 3 == 1 and i % 4 == 1])
    labelled = ratings.read_columns(spark, held, ["user_id", "item_id", "rating", "timestamp", "label"],
                                    ordered=True).withColumnsRenamed({"timestamp": "ts", "label": "ser_label"})
    second = prepare.prepare_holdout(labelled, users=first.user_lookup, items=first.item_lookup)
    old = {r["key"]: r["normalized_id"] for r in first.item_lookup.collect()}
    new = {r["key"]: r["normalized_id"] for r in second.item_lookup.collect()}
    assert new == {**old, "i7": len(old)}
    assert second.ratings.count() == 3
    root = str(tmp_path / "lookup")
    tables.write_lookup(first.item_lookup, root, 1)
    tables.write_lookup(second.item_lookup, root, 2)
    assert tables.read_lookup(spark, root, 2).count() == len(new)


def test_semantic_pipeline(spark):
    words = ["red", "blue", "green", "ring", "lamp", "chair"]
    texts = spark.createDataFrame(
        [(f"p{i}", f"{words[i % 6]} {words[(i // 6) % 6]}") for i in range(60)], "item_id string, text string")
    done = semantic.run(texts, lambda t: item_text.embed_tfidf(t, 32), num_layers=2, codebook_size=4, seed=3)
    rows = done.codes.collect()
    assert len(rows) == 60
    assert len({(tuple(r["codes"]), r["dedup_slot"]) for r in rows}) == 60


def test_evaluation_and_predictions(spark):
    rng = np.random.default_rng(0)
    table = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(1, 21)],
                                  "item_id long, embedding array<double>")
    rows = [(u, int(rng.integers(0, 20)), 1.0, t, t, t % 2) for u in range(12) for t in range(u + 1)]
    events = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long, ord long, ser_label int")
    ex = examples.build(events, chronological=True, pad=False)
    result = evaluate.evaluate(ex, table, 5, [1, 5], alpha=1.0,
                               layers=[([[0.1] * 8], [0.0])])
    assert result.ranks.count() == 12
    assert result.ranks.filter("user_id = 0").first()["rank"] == 6
    both = {**result.relevance.first().asDict(), **result.serendipity.first().asDict()}
    assert all(0 <= v <= 1 for v in both.values())
    lists = evaluate.predict(ex, table, 5, ex.select("user_id"))
    got = {r["user_id"]: r["top_k_ids"] for r in lists.collect()}
    assert got[0] is None and all(len(v) == 5 for u, v in got.items() if u)


# streams

def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_streamed_ids_equal_the_batch_result(spark, tmp_path):
    folder, root, mark = tmp_path / "in", str(tmp_path / "lookup"), str(tmp_path / "mark")
    schema = "k string, ord long"
    values = ["a", "b", "A", "c", "b", "D", "d", "e", "a", "f"]
    lines = [f'{{"k": "{v}", "ord": {i}}}' for i, v in enumerate(values)]
    write(folder / "1.json", lines[:4])
    query = lookups.start(stream_of(spark, folder, schema), "k", ["ord"], root=root, checkpoint=mark, fold=True)
    query.awaitTermination(120)
    write(folder / "2.json", lines[4:])  # a restart continues with the next file
    query = lookups.start(stream_of(spark, folder, schema), "k", ["ord"], root=root, checkpoint=mark, fold=True)
    query.awaitTermination(120)
    got = {r["key"]: r["normalized_id"] for r in lookups.read_lookup(spark, root).collect()}
    assert got == {k: i for i, k in enumerate("abcdef")}
    # a replay of a batch writes the same rows again
    batch = spark.createDataFrame([(v, i) for i, v in enumerate(values)][4:], schema)
    lookups.assign_batch(batch, 1, root, "k", ["ord"], fold=True)
    again = {r["key"]: r["normalized_id"] for r in lookups.read_lookup(spark, root).collect()}
    assert again == got


def test_streamed_frequencies(spark, tmp_path):
    folder, root, mark = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "mark")
    items = [1, 2, 1, 1, 3, 2, 1, 3]
    lines = [f'{{"item_id": {v}, "pos": {i + 1}}}' for i, v in enumerate(items)]
    write(folder / "1.json", lines[:4])
    write(folder / "2.json", lines[4:])
    query = frequency.start(stream_of(spark, folder, "item_id long, pos long"), root=root, checkpoint=mark,
                            alpha=0.5, cap=3.0, initial_gap=1.0)
    query.awaitTermination(120)
    state = {}
    for start, batch in ((0, items[:4]), (4, items[4:])):
        for item in set(batch):
            last = start + max(i for i, v in enumerate(batch) if v == item) + 1
            before, gap = state.get(item, (0, 1.0))
            state[item] = last, min(3.0, 0.5 * gap + 0.5 * (last - before) / batch.count(item))
    got = {r["item_id"]: (r["last_pos"], r["gap"]) for r in frequency.read_state(spark, root).collect()}
    assert got == state
    p = {r["item_id"]: r["probability"] for r in
         frequency.probability(frequency.read_state(spark, root)).collect()}
    assert p[1] == pytest.approx(1 / state[1][1])
