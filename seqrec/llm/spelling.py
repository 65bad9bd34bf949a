"""Spelling variants one edit apart, found by pivotal bigrams.

All bigrams have one global order, rare ones first. The gram prefix of a word
is its three rarest bigrams (and those that tie with the third); among them a
dynamic program chooses the two disjoint ones that are rarest together, the
pivots. One edit leaves at least one of two disjoint pivots whole. So of two
words one edit apart, the one whose prefix ends earlier in the order has a
pivot that is in the other's prefix (Deng, Li and Feng, "A pivotal prefix based
filtering algorithm for string similarity search", 2014, for one edit).

Position limits make the index narrow. A pivot that survives has the edit on
its right, then all before it is equal and it stands as far from the start; or
on its left, then all behind it is equal and it stands as far from the end. The
edited side is halved once more: the edit is in one half, so the other half is
equal too. Pivots meet prefix bigrams of words of the right length under the
hash of all that must be equal; every pair is verified by its edit distance.

The words of the corpus are counted within tasks before they are shuffled. What
the driver collects is the order of the bigrams: at most the square of the
alphabet of 90 letters, whatever the corpus.

Defined cases: null and empty texts have no words; a null id counts as an empty
one where words are slipped; rows that repeat an id count each; of several near
words with the same count the smallest counts as the form; a word without near
words has none and is its own root; no words, no rows. Other columns play no
part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm.common import column
from seqrec.session import cut_lineage

MIN_CHARS, MIN_COUNT = 7, 2
FACTOR = 10
SLIP_EVERY = 31
GRAM, EDITS = 2, 1
BLOCK = 1 << 22
FLUSH = 200_000

_RUN = re.compile(r"[a-zÀ-ÿ]+")
# an ASCII byte that is no letter, or the first byte of a character that is none, in lower-cased UTF-8
_GAP = re.compile(rb"[\x00-\x60\x7b-\x7f\xc2\xc4-\xf4]")


def _blocks(data: bytes) -> Iterator[str]:
    """A text in blocks that cut no run of letters."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + BLOCK) if at + BLOCK < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].decode("utf-8", "replace")
        at = end


def slipped(run: str, prefix_crc: int, every: int) -> str:
    """A run of letters, without one of them where ``every`` divides its checksum."""
    drawn = zlib.crc32(run.encode(), prefix_crc)
    if drawn % every:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, slip_every: int | None = None) -> DataFrame:
    """``word, n``: maximal runs of Latin letters, A-Z lower-cased, of all texts.

    With ``slip_every`` some runs lose a letter first, by a checksum of the
    document's id and the run: misspellings that any other program can repeat.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            found = pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for block in _blocks(value.as_buffer().to_pybytes().lower()):
                    runs = Counter(r for r in _RUN.findall(block) if len(r) >= min_chars)
                    if slip_every is None:
                        total.update(runs)
                    else:
                        for run, n in runs.items():
                            word = slipped(run, prefix, slip_every)
                            if len(word) >= min_chars:
                                total[word] += n
                if len(total) >= FLUSH:
                    yield taken()
        if total:
            yield taken()

    plain = docs.filter(column(text).isNotNull()).select(column(doc_id).cast("string"), column(text).cast("string"))
    counted = plain.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def gram_order(words: DataFrame) -> dict[str, int]:
    """How many words hold each bigram, rarest first; bounded by the square of the alphabet."""
    at = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.filter(F.char_length("word") >= GRAM).select(
        F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_words")).orderBy("n_words", "gram")
    return {r["gram"]: r["n_words"] for r in counts.collect()}


def gram_prefix(word: str, rank: dict[str, int]) -> list[int]:
    """Places of the rarest bigrams, in order of place; all that tie with the last one are taken."""
    ranks = [rank[word[i:i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(ranks)[GRAM * EDITS]
    return [i for i, r in enumerate(ranks) if r <= last]


def pivots(places: list[int], weights: list[int], wanted: int = EDITS + 1) -> list[int]:
    """The ``wanted`` places, no two of them overlapping, with the least sum of weights.

    ``best[k]`` after place i is the lightest choice of k bigrams that end
    there or before; a bigram adds to the choices that end before it begins.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * wanted]
    for i, (place, weight) in enumerate(zip(places, weights)):
        free = i
        while free and places[free - 1] > place - GRAM:
            free -= 1
        row = list(best[-1])
        for k in range(1, wanted + 1):
            before = best[free][k - 1]
            if before is not None and (row[k] is None or before[0] + weight < row[k][0]):
                row[k] = (before[0] + weight, [*before[1], place])
        best.append(row)
    return best[-1][wanted][1]


def _with_grams(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """Add the places of the gram prefix and of the pivots."""
    rank = {gram: i for i, gram in enumerate(order)}

    @F.arrow_udf("struct<prefix:array<int>,pivots:array<int>>")
    def chosen(values: pa.Array) -> pa.Array:
        prefixes, picked = [], []
        for word in values.to_pylist():
            places = gram_prefix(word, rank)
            prefixes.append(places)
            picked.append(pivots(places, [order[word[i:i + GRAM]] for i in places]))
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(prefixes, kind), pa.array(picked, kind)], ["prefix", "pivots"])

    return words.withColumn("grams", chosen(F.col("word"))).select("*", "grams.prefix", "grams.pivots").drop("grams")


def _keys(word: str, place: str, length: str, own: str) -> Column:
    """Hashes of what must be equal around the bigram at ``place``, for the lengths of the word (``own``) and of the prefix word.

    a, b: the edit is behind the bigram, in the second or first half of the
    rest; c, d: before it, in the first or second half of what precedes it.
    """
    rest, head = f"({length} - {place} - {GRAM})", f"({length} - {own} + {place})"
    end = f"({own} - {place})"
    rest_half, head_half = f"({rest} div 2)", f"({head} div 2)"
    return F.expr(f"""filter(array(
        if({rest} >= 0, xxhash64('a', {length}, {place}, left({word}, int({place} + {GRAM} + {rest_half}))), null),
        if({rest} >= 2, xxhash64('b', {length}, {place}, left({word}, {place} + {GRAM}), right({word}, int({rest} - {rest_half}))), null),
        if({head} >= 2, xxhash64('c', {length}, {end}, right({word}, int({end} + {head} - {head_half}))), null),
        if({head} >= 0, xxhash64('d', {length}, {end}, right({word}, {end}), left({word}, int({head_half}))), null)
      ), x -> x is not null)""")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words exactly one inserted, deleted or replaced code point apart, once, a < b.

    ``words`` has ``word`` (three bigrams or more) and ``n``, and is read several times.
    """
    placed = cut_lineage(_with_grams(words.select("word", "n"), gram_order(words))
                         .withColumn("size", F.char_length("word")))
    asked = placed.select("word", "n", "size", F.explode("pivots").alias("place")).select(
        "word", "n", "size", "place", F.explode(F.expr("array(size - 1, size, size + 1)")).alias("length"))
    asked = asked.select("word", "n", F.explode(_keys("word", "place", "length", "size")).alias("key"))
    held = placed.select("word", "n", "size", F.explode("prefix").alias("place")).select(
        F.col("word").alias("other"), F.col("n").alias("n_other"), F.explode(_keys("word", "place", "size", "size")).alias("key"))
    met = asked.join(held, "key").filter((F.col("word") != F.col("other"))
                                         & (F.levenshtein("word", "other", EDITS) == EDITS))
    first = F.col("word") < F.col("other")
    one, two = F.struct("word", "n"), F.struct(F.col("other").alias("word"), F.col("n_other").alias("n"))
    pairs = met.select(F.when(first, one).otherwise(two).alias("a"), F.when(first, two).otherwise(one).alias("b")).distinct()
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that follow one another.

    Counts grow by ``FACTOR`` with each step, so chains are short, and every
    round doubles the steps taken.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut_lineage(now.join(then, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, *, factor: int = FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words`` (``word``, ``n``).

    The form of a word is its near word of largest count, if that is at least
    ``factor`` (above 1) times its own; the root is the last of its forms.
    """
    if factor <= 1:
        raise ValueError("the factor must be above 1")
    words = cut_lineage(words.select("word", "n"))
    pairs = cut_lineage(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")).alias("near"))
    both = both.unionByName(pairs.select(
        F.col("b").alias("word"), F.col("n_b").alias("n"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("word")).alias("near")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    enough = -F.col("best.less") >= F.col("n") * factor
    known = cut_lineage(best.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"),
                                    F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = _roots(known.filter(F.col("form").isNotNull()))
    return words.join(known, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
        F.coalesce("root", "word").alias("root"))
