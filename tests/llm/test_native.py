"""Mixing, line dedup, archives and shards: against SQL and plain loops, on odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from compare import differences, duck
from seqrec.llm import lines, mixing, queries, shards, warc

rng = random.Random(17)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) == []


# mixing

def plain_fill(given, children):
    """Water filling with fractions: children as (name, weight, cap)."""
    out, left, open_ = {}, given, [c for c in children if c[1] > 0 and c[2] > 0]
    while open_:
        total = sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] * total <= c[1] * left]
        if not full:
            break
        out |= {n: c for n, _, c in full}
        left -= sum(c for _, _, c in full)
        open_ = [c for c in open_ if c not in full]
    total = sum(w for _, w, _ in open_)
    return out | {n: left * w / total for n, w, _ in open_} | {n: 0 for n, w, c in children if not w or not c}


def test_budgets_equal_plain_water_filling(spark):
    sizes = [(f"={a}", f"={b}", rng.choice([0, 3, 10, 500, 40000])) for a in "xyz" for b in "klmno"]
    weights = {"=x": 5, "=y": 2, "=z": 0, "=k": 1, "=l": 7, "=m": 3, "=n": 2, "=o": 1}
    df = spark.createDataFrame(sizes, "level_0 string, level_1 string, tokens long")
    for fraction, epochs in (((1, 3), 1), ((2, 1), 2), ((9, 1), 1)):
        plan = mixing.leaf_plan(df, ["level_0", "level_1"], [queries.weight(0, weights), queries.weight(1, weights)],
                                fraction=fraction, max_epochs=epochs).collect()
        got = {(r["level_0"], r["level_1"]): r["budget"] for r in plan}
        cap = {(a, b): t * epochs * (weights[a] > 0) for a, b, t in sizes}
        target = min(sum(t for *_, t in sizes) * fraction[0] // fraction[1], sum(cap.values()))
        tops = plain_fill(target, [(a, weights[a], sum(c for (x, _), c in cap.items() if x == a)) for a in ("=x", "=y", "=z")])
        assert sum(got.values()) == target
        for a, given in tops.items():
            below = plain_fill(given, [(b, weights[b], cap[a, b]) for x, b in cap if x == a])
            assert all(abs(got[a, b] - want) <= 2 for b, want in below.items())
        assert all(r["budget"] == r["epochs"] * r["tokens"] + r["rest"] for r in plan if r["tokens"])


def plain_prefix(rows, epochs, rest, seed=mixing.SEED):
    taken, spent = set(), 0
    for _, i, tokens in sorted((hashlib.md5(f"{seed}:{epochs}:{i}".encode()).hexdigest(), i, t) for i, t in rows):
        spent += tokens
        if spent > rest:
            break
        taken.add(i)
    return taken


@pytest.mark.parametrize(("fraction", "epochs"), [((1, 3), 1), ((7, 3), 3), ((3, 1), 2)])
@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_prefix_of_seeded_epochs(spark, fraction, epochs, hot_rows):
    rows = [(i, " ".join(["w"] * rng.randrange(9)), "one") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = mixing.mix(docs, [F.col("lang")], [F.lit(1)], fraction=fraction, max_epochs=epochs, hot_rows=hot_rows)
    got = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    sizes = [(i, len(t.split())) for i, t, _ in rows]
    total = sum(t for _, t in sizes)
    whole, rest = divmod(min(total * fraction[0] // fraction[1], total * epochs), total)
    extra = plain_prefix(sizes, whole, rest) if rest else set()
    assert got == {i: n for i, _ in sizes if (n := whole + (i in extra))}


def test_mixing_odd_rows(odd_docs, no_docs):
    levels, weights = [F.col("lang"), F.col("source")], [F.lit(1), F.lit(2)]
    everything = mixing.mix(odd_docs, levels, weights, fraction=(1, 1))
    assert everything.columns == [*odd_docs.columns, "copies_"]
    got = sorted((r["doc_id"] or 0, r["copies_"]) for r in everything.collect())
    # texts without tokens come with their leaf: (null, src1) and (de, null) have no tokens at all
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (5, 1), (6, 1), (7, 1), (8, 1)]
    some = mixing.mix(odd_docs, levels, weights, fraction=(1, 2)).groupBy("doc_id").agg(F.count_distinct("copies_")).collect()
    assert all(r[1] == 1 for r in some)  # rows that share an id are taken together
    assert mixing.mix(odd_docs, levels, [F.lit(0), F.lit(1)], fraction=(1, 2)).count() == 0
    assert mixing.mix(no_docs, levels, weights).count() == 0


# lines

def plain_lines(docs, min_length, min_docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))

    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    shared = {k: max(h) for k, h in holders.items() if len(k) >= min_length and len(h) >= min_docs}
    return {i: [line for line in (t or "").split("\n") if shared.get(key(line), i) == i] for i, t in docs}


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_line_dedup_equals_a_loop(spark, hot_rows):
    pool = ["Shared line of the footer", "shared LINE of the footer ", "ÄRGER im Haus überall", "ärger im Haus überall", "x", "",
            "\tonce more with feeling\r", "once more WITH feeling"]
    docs = [(i, None if i == 7 else "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()}"
                                              for _ in range(rng.randrange(6)))) for i in range(120)]
    kept = lines.drop_shared_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_length=10, min_docs=4,
                                   hot_rows=hot_rows)
    want = plain_lines(docs, 10, 4)
    total = {i: len((t or "").split("\n")) for i, t in docs}
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in kept.collect()}
    assert got == {i: ("\n".join(w), total[i], total[i] - len(w)) for i, w in want.items()}


def test_lines_odd_rows(odd_docs, no_docs):
    kept = lines.drop_shared_lines(odd_docs, min_length=10, min_docs=2)
    assert kept.columns == [*odd_docs.columns, "n_lines_", "n_dropped"] and kept.count() == odd_docs.count()
    dropped = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in kept.collect()}
    # documents 1 (twice) and 6 share their only line; the largest id keeps it
    assert dropped[1] == ("", 1) and dropped[6][1] == 0 and dropped[2] == ("", 0) and dropped[None][1] == 0
    assert dropped[5][0].startswith("wort0 und wort1") and len(dropped[5][0]) > 500_000
    assert lines.drop_shared_lines(no_docs).count() == 0


# archives

def test_archives_round_trip(spark, tmp_path):
    bodies = ["", None, "x" * 99, "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n" * 60, "\r\r\n\n" * 50,
              "same payload, long enough to be stored only once: " * 3, "y" * 2_000_000, "ends with\r", "\n"]
    rows = [(i, f"http://host/{i}?a=b\r\nX: y", bodies[i % len(bodies)]) for i in range(45)] + [(None, None, bodies[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, hot_rows=2)
    parsed = warc.read_records(spark, path)
    assert parsed.count() == 3 * len(rows)
    found = warc.resolved(warc.captures(parsed)).collect()
    assert len(found) == len(rows)
    seen = {}
    for i, _, body in sorted(rows[:-1]):
        seen.setdefault(body or "", i)
    for r in found:
        capture, fields = r["capture"], r["metadata"]["fields"]
        page = int(fields["pageid"]) if "pageid" in fields else None
        body = dict((i, b or "") for i, _, b in rows)[page].encode()
        first = seen[body.decode()]
        if capture["type"] == "response":
            assert capture["payload"] == body and capture["payload_bytes"] == len(body)
            assert len(body) < 100 or page == first
        else:
            assert len(body) >= 100 and int(r["original"]["metadata"]["fields"]["pageid"]) == first != page
            assert capture["refers_to"] == r["original"]["capture_id"] and r["original"]["payload_bytes"] == len(body)
        assert (r["original"] is None) == (capture["type"] == "response")
        assert capture["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert r["request"]["record_id"] and set(fields) <= {"pageid"}
        assert "\r" not in (capture["target_uri"] or "")


def test_archives_odd_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(empty, str(tmp_path / "none"))
    assert warc.captures(warc.read_records(spark, str(tmp_path / "none"))).count() == 0
    body = "z" * 200
    twice = spark.createDataFrame([(1, "u", body), (1, "u", body), (None, "v", body), (None, "w", "short")],
                                  "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as payload")
    warc.write_archives(twice, str(tmp_path / "twice"))
    got = warc.captures(warc.read_records(spark, str(tmp_path / "twice"))).collect()
    # rows equal in id, url and payload are one capture; the row without an id revisits it
    assert sorted(r["capture"]["type"] for r in got) == ["response", "response", "revisit"]


def test_damaged_archives_fail():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nabcd"

    def feed(data):
        parser = warc._Parser(True)
        rows = [r for line in data.split(b"\r\n")[:-1] if (r := parser.feed(line)) is not None]
        return rows, parser.at_rest()

    assert len(feed((record + b"\r\n\r\n") * 2)[0]) == 2
    assert feed(record[:-2] + b"\r\n")[1] is False
    for bad in (b"hello\r\n", record + b"efgh\r\n\r\n", record + b"\r\nWARC\r\n"):
        with pytest.raises(ValueError, match="damaged"):
            feed(bad)


# shards

def test_shards_follow_the_mixture(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(5000)]
    placed = shards.interleave(spark.createDataFrame(rows, "doc_id long, source string"), shards=13).collect()
    per = {}
    for r in placed:
        per.setdefault(r["shard"], []).append(r)
    sizes = [len(x) for x in per.values()]
    assert len(per) == 13 and max(sizes) - min(sizes) <= 1
    share = {s: sum(r[1] == s for r in rows) / 13 for s in {r[1] for r in rows}}
    for members in per.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        for s, want in share.items():
            # each source is within half a row of its part at every place of the stream; so is a cut, per source
            assert abs(sum(r["source"] == s for r in members) - want) <= 1 + len(share)


def test_shards_odd_rows(odd_docs, no_docs):
    placed = shards.sharded_texts(odd_docs, shards=4)
    assert placed.columns == [*odd_docs.columns, "shard_", "slot_"]
    rows = placed.collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] or 0) for r in odd_docs.collect())
    assert sorted((r["shard_"], r["slot_"]) for r in rows) == sorted(
        (r["shard_"], r["slot_"]) for r in shards.interleave(odd_docs, shards=4).collect())
    assert len({(r["shard_"], r["slot_"]) for r in rows}) == len(rows)
    assert {r["doc_id"]: len(r["text"] or "") for r in rows}[5] > 500_000
    assert shards.sharded_texts(no_docs).count() == shards.interleave(no_docs).count() == 0
    few = shards.interleave(odd_docs.filter("doc_id in (2, 3)"), shards=40).collect()
    assert sorted(r["slot_"] for r in few) == [0, 0]
