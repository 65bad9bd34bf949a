"""Language identification by rank-order n-gram profiles (out-of-place distance).

Texts are lower-cased and cut into words of letters; each word is padded with
a blank at both ends and gives its n-grams of one to three characters. A
profile is the list of the most frequent n-grams in rank order. A document is
compared with every language: an n-gram that the language has at another rank
costs the difference of the ranks, one that it lacks costs the profile size.
The smallest sum wins.

Three code points of 21 bits fit a 64-bit number, so n-grams are counted as
exact numbers, without hashing. Counting a text goes in blocks that end between
words: memory is bounded by the block, the longest word and the distinct
n-grams, however long the text. Letters are the characters of the Unicode
categories L; digits and other numerals are none.

Defined cases: null texts and texts without a letter get the language ``und``
and score 0; equal counts rank the n-gram with the smaller number first; equal
distances go to the language that sorts first; without any learned profile
every text is ``und``. Rows are kept as they are, repeated ones included, and
other columns are not touched.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqrec.llm.common import column, fresh

UNDETERMINED = "und"
PROFILE_SIZE = 400
BLOCK = 1 << 20

def _numerals() -> str:
    """Word characters that are neither letters nor decimal digits, as ranges of a character class: ``½``, ``²``, ``①`` and the like."""
    points = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    first = [c for i, c in enumerate(points) if i == 0 or points[i - 1] != c - 1]
    last = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


_NO_LETTER = re.compile(rf"[\W\d_{_numerals()}]+")


def _ngrams(block: str) -> np.ndarray:
    """All n-grams of one block of text as numbers, sorted."""
    points = np.frombuffer(_NO_LETTER.sub(" ", f" {block} ").encode("utf-32-le", "replace"), np.uint32)
    points = points.astype(np.int64)
    letter = points != 32
    single = points[letter]
    # a pair needs one letter; a triple needs its middle letter, so no n-gram spans two words
    pair = (points[:-1] | (points[1:] << 21))[letter[:-1] | letter[1:]]
    triple = (points[:-2] | (points[1:-1] << 21) | (points[2:] << 42))[letter[1:-1]]
    grams = np.concatenate([single, pair, triple])
    grams.sort()
    return grams


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(grams):
        return grams, grams
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[at], np.diff(np.append(at, len(grams)))


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(values, return_inverse=True)
    return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64)


def _blocks(text: str) -> Iterator[str]:
    """A text in blocks that end where no letter is, so that no word is cut."""
    at = 0
    while at < len(text):
        gap = _NO_LETTER.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts."""
    total = _counted(_ngrams(""))
    for block in _blocks((text or "").lower()):
        more = _counted(_ngrams(block))
        total = _merged(*(np.concatenate(x) for x in zip(total, more))) if len(total[0]) else more
    return total


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in rank order, ties to the smaller number."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


@dataclass(frozen=True)
class Profiles:
    """For each language, its n-grams in rank order."""

    grams: dict[str, list[int]]
    size: int = PROFILE_SIZE

    def classifier(self) -> Classifier:
        return Classifier(self)


class Classifier:
    """All profiles as one table: a row per n-gram, a column per language."""

    def __init__(self, profiles: Profiles) -> None:
        self.size, self.languages = profiles.size, sorted(profiles.grams)
        known = sorted({g for grams in profiles.grams.values() for g in grams})
        self.known = np.array(known, np.int64)
        self.ranks = np.full((len(known) + 1, len(self.languages)), -1, np.int32)
        for at, language in enumerate(self.languages):
            grams = np.array(profiles.grams[language], np.int64)
            self.ranks[np.searchsorted(self.known, grams), at] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 for the profile itself, 0 for nothing in common."""
        own = ranked(*gram_counts(text), self.size)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at[self.known[at] != own] = len(self.known)
        theirs = self.ranks[at]
        distance = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.size * len(own)))


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language, added up over a batch before they leave the task."""
    for batch in batches:
        parts: dict[str, list] = {}
        for text, language in zip(batch.column(0), batch.column(1)):
            held = parts.setdefault(language.as_py(), [])
            held.append(gram_counts(text.as_py()))
            if len(held) >= 256:
                held[:] = [_merged(*(np.concatenate(x) for x in zip(*held)))]
        for language, held in parts.items():
            grams, counts = _merged(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                ["language", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", language: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of every language from all its texts; rows with a null language teach nothing.

    Counts cover every row. They are added per batch, then by (language,
    n-gram); the best ``size`` of each language are taken in two steps, so no
    task holds a whole language. Only ``size`` rows per language reach the driver.
    """
    labelled = docs.select(column(text).alias("text"), column(language).alias("language")).filter(
        F.col("language").isNotNull())
    counts = labelled.mapInArrow(_language_counts, "language string, gram long, n long").groupBy(
        "language", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    for keys in (["language", "part"], ["language"]):
        top = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        counts = (counts.withColumn("part", part).withColumn("rank", top)
                  .filter(F.col("rank") <= size).select("language", "gram", "n", "rank"))
    grams: dict[str, list[int]] = {}
    for row in sorted(counts.collect(), key=lambda r: (r["language"], r["rank"])):
        grams.setdefault(row["language"], []).append(row["gram"])
    return Profiles(grams, size)


def predict(profiles: Profiles, text: Column) -> Column:
    """A column of struct<lang: string, score: double> for a text column."""
    spec = profiles

    @F.arrow_udf("lang string, score double")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = spec.classifier()
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["lang", "score"])

    return identify.asNondeterministic()(text)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", *,
             lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """All columns of ``docs`` and the prediction; a clashing name gets an underscore more."""
    held, lang_as, score_as = fresh(docs, "_identified", lang_as, score_as)
    found = docs.withColumn(held, predict(profiles, column(text)))
    return found.withColumns({lang_as: column(held)["lang"], score_as: column(held)["score"]}).drop(held)


def learnable(docs: DataFrame, doc_id: str = "doc_id", folds: int = 3, held_out: int = 1) -> Column:
    """Whether a row may be learned from: the crc32 of its id does not fall into the held-out fold."""
    return F.coalesce(F.crc32(column(doc_id).cast("string")) % folds != held_out, F.lit(False))
