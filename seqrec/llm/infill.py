"""Fill-in-the-middle transformation by displacement scatter.

A batch of texts is one array of bytes. A scan marks the byte after which each
unit (white space and the word after it) ends; the two cuts of a text are two
of these places. Prefix, middle and suffix each move by one distance, so a
difference array with four entries a text, summed up, gives every byte its
place in the output, and one scatter writes all of them. The way back finds the
three marks of an output, builds the same kind of array over the restored
bytes, and gathers.

The cuts and the form of a document follow from its id and the seed alone, so a
task that runs again gives the same outputs. A slice of about one megabyte of
texts is worked on at a time; a longer text is a slice of its own.

Defined cases: null texts are empty; empty texts, and texts that hold a mark
themselves, stay plain; cuts may fall together or at the ends, so that parts
are empty; a null id draws as the empty text does; rows that repeat an id draw
alike; other columns are not touched. An output that does not hold exactly the
three marks of its form cannot be restored and fails the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm import words
from seqrec.llm.common import column, fresh

SEED = 42
RATE, SPM_RATE = 50, 80
# The marks, in the order in which each form has them.
MARKS = {"psm": b"<P><S><M>", "spm": b"<S><P><M>"}
WIDTH = 3

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"PSM")] = True


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks that lie within one text, and the numbers of these texts."""
    if len(data) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == ord("<")) & _LETTER[data[1:-1]] & (data[2:] == ord(">")))
    owner = np.searchsorted(offsets, at, side="right") - 1
    inside = at + WIDTH <= offsets[owner + 1]
    return at[inside], owner[inside]


def _unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units end, over all texts: behind a word that white space follows, and at the end of a text."""
    space = _SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return np.flatnonzero(ends) + 1


def _displacement(size: int, starts: list[np.ndarray], moves: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """For each of ``size`` bytes the distance of its part; part i of a text begins at ``starts[i]`` and moves by ``moves[i]``."""
    steps, before = np.zeros(size + 1, np.int64), 0
    for start, move in zip(starts, moves):
        np.add.at(steps, start, move - before)
        before = move
    np.subtract.at(steps, end, before)
    return np.cumsum(steps[:-1])


def scattered(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of a slice of texts: bytes, offsets, units, kind (0 plain, 1 psm, 2 spm), code points of prefix and middle."""
    start, end = offsets[:-1], offsets[1:]
    ends = _unit_ends(data, offsets)
    first = np.searchsorted(ends, offsets, side="right")
    units = np.diff(first)
    picks = np.sort(drawn[:, :2] % (units + 1)[:, None], axis=1)
    padded = np.append(ends, 0)
    cuts = [np.where(picks[:, i] == 0, start, padded[first[:-1] + picks[:, i] - 1]) for i in (0, 1)]
    _, marked = _marks(data, offsets)
    plain = (end == start) | (drawn[:, 2] % 100 >= rate)
    plain[marked] = True
    kind = np.where(plain, 0, np.where(drawn[:, 3] % 100 < spm_rate, 2, 1))

    size = end - start + np.where(plain, 0, 3 * WIDTH)
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    at = out_offsets[:-1]
    prefix, suffix = cuts[0] - start, end - cuts[1]
    psm, spm = kind == 1, kind == 2
    place = [np.where(spm, at + 2 * WIDTH + suffix, at + WIDTH * psm),
             np.where(plain, at + prefix, at + 3 * WIDTH + prefix + suffix),
             np.where(plain, at + (cuts[1] - start), np.where(spm, at + WIDTH, at + 2 * WIDTH + prefix))]
    parts = [start, cuts[0], cuts[1]]
    moved = _displacement(len(data), parts, [p - s for p, s in zip(place, parts)], end)
    out = np.empty(int(out_offsets[-1]), np.uint8)
    out[np.arange(len(data)) + moved] = data
    for code, form in ((1, "psm"), (2, "spm")):
        own, marks = kind == code, np.frombuffer(MARKS[form], np.uint8).reshape(3, WIDTH)
        middle = at + WIDTH + (prefix if code == 1 else suffix)
        for mark, where in zip(marks, (at, middle, at + 2 * WIDTH + prefix + suffix)):
            out[where[own][:, None] + np.arange(WIDTH)] = mark
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return (out, out_offsets, units, kind, points[cuts[0]] - points[start], points[cuts[1]] - points[cuts[0]])


def gathered(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind a slice of outputs, from these and their kinds alone."""
    start, end, changed = offsets[:-1], offsets[1:], kind > 0
    found, owner = _marks(data, offsets)
    found, owner = found[changed[owner]], owner[changed[owner]]
    rows = np.flatnonzero(changed)
    if not np.array_equal(owner, np.repeat(rows, 3)) or not np.array_equal(found[::3], start[rows]):
        raise ValueError("an output does not hold the three marks of its form")
    where = np.repeat(start[:, None], 3, axis=1)
    where[rows] = found.reshape(-1, 3)
    for code, form in ((1, "psm"), (2, "spm")):
        letters = data[where[kind == code] + 1]
        if not (letters == np.frombuffer(MARKS[form], np.uint8)[1::WIDTH]).all():
            raise ValueError("the marks of an output are not those of its form")
    size = end - start - np.where(changed, 3 * WIDTH, 0)
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    at = out_offsets[:-1]
    one, two = where[:, 1] - where[:, 0] - WIDTH, where[:, 2] - where[:, 1] - WIDTH
    spm = kind == 2
    prefix = np.where(spm, two, one)
    suffix = np.where(spm, one, two)
    # a plain text is all prefix
    prefix, suffix = np.where(changed, prefix, size), np.where(changed, suffix, 0)
    source = [np.where(changed, where[:, 0] + WIDTH, start) + np.where(spm, one + WIDTH, 0),
              where[:, 2] + WIDTH, np.where(spm, where[:, 0], where[:, 1]) + WIDTH]
    parts = [at, at + prefix, out_offsets[1:] - suffix]
    moved = _displacement(int(out_offsets[-1]), parts, [s - p for s, p in zip(source, parts)], out_offsets[1:])
    return data[np.arange(len(moved)) + moved], out_offsets


def _strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    made = [pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                             pa.py_buffer(data)).cast(pa.string()) for data, offsets in parts]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


_KINDS = pa.array(["plain", "psm", "spm"])
_STRUCT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def infilled(text: Column, drawn: list[Column], rate: int = RATE, spm_rate: int = SPM_RATE) -> Column:
    """The struct ``n, form, prefix_chars, middle_chars, output`` of a text column."""
    @F.arrow_udf(_STRUCT)
    def scatter(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        numbers = np.stack([h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)], axis=1).astype(np.int64)
        done = [scattered(data, offsets, numbers[at:at + len(offsets) - 1], rate, spm_rate)
                for at, data, offsets in words.slices(texts)]
        units, kinds, prefix, middle = (np.concatenate([d[i] for d in done] or [np.zeros(0, np.int64)]) for i in (2, 3, 4, 5))
        return pa.StructArray.from_arrays(
            [pa.array(units, pa.int64()), _KINDS.take(pa.array(kinds)), pa.array(prefix, pa.int64(), mask=kinds == 0),
             pa.array(middle, pa.int64(), mask=kinds == 0), _strings([(d[0], d[1]) for d in done])],
            ["n", "form", "prefix_chars", "middle_chars", "output"])

    return scatter.asNondeterministic()(text, *drawn)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of the given form."""
    @F.arrow_udf("string")
    def gather(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        kinds = pa.compute.index_in(forms.cast(pa.string()), _KINDS).to_numpy(zero_copy_only=False)
        if not np.isfinite(kinds.astype(float)).all():
            raise ValueError("an output has no known form")
        kinds = kinds.astype(np.int64)
        return _strings([gathered(data, offsets, kinds[at:at + len(offsets) - 1])
                         for at, data, offsets in words.slices(outputs)])

    return gather(output, form)


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE, added_as: str = "infill") -> DataFrame:
    """All columns, and the struct ``added_as`` (``n, form, prefix_chars, middle_chars, output``).

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of these with
    the suffix first. The struct replaces no column: where its name is taken,
    underscores follow it.
    """
    (name,) = fresh(docs, added_as)
    return docs.withColumn(name, infilled(column(text), draws(column(doc_id), seed), rate, spm_rate))
