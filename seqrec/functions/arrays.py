"""Row-local sequence functions on array columns.

Every function works on one bounded array (a truncated history), so none of
them moves data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_sequence(text: Column, element_type: str) -> Column:
    """Comma separated text to a typed array; blank text gives an empty array."""
    return F.when(F.trim(text) == "", F.array().cast(f"array<{element_type}>")).otherwise(
        F.transform(F.split(text, ","), lambda x: F.trim(x).cast(element_type))
    )


def format_sequence(values: Column) -> Column:
    """Typed array to comma separated text."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def drop_last(values: Column, n: int) -> Column:
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - n, F.lit(0)))


def take_last(values: Column, n: int) -> Column:
    start = F.greatest(F.size(values) - n, F.lit(0)) + 1
    return F.slice(values, start, F.lit(n))


def take_first(values: Column, n: int) -> Column:
    return F.slice(values, F.lit(1), F.lit(n))


def pad_right(values: Column, length: int, fill: Column) -> Column:
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(fill, missing))


def shift_ids(ids: Column, by: int) -> Column:
    return F.transform(ids, lambda x: x + by)


def append_slots(values: Column, slots: int, fill: Column) -> Column:
    """Add ``slots`` empty output positions at the end."""
    return F.concat(values, F.array_repeat(fill, slots))


def put_at(values: Column, position: Column, value: Column) -> Column:
    """Replace the element at the zero-based ``position``."""
    return F.transform(values, lambda x, i: F.when(i == position, value).otherwise(x))


def gather(values: Column, positions: Column) -> Column:
    """Elements at the zero-based ``positions``."""
    return F.transform(positions, lambda i: F.get(values, i.cast("int")))


def value_at_last(values: Column, length: Column) -> Column:
    """Element at the last valid position; null for an empty history."""
    return F.get(values, (length - 1).cast("int"))


def interleave(first: Column, second: Column) -> Column:
    """first[0], second[0], first[1], second[1], ..."""
    return F.flatten(F.transform(F.arrays_zip(first.alias("a"), second.alias("b")),
                                 lambda z: F.array(z["a"], z["b"])))


def duplicate_each(values: Column) -> Column:
    return F.flatten(F.transform(values, lambda x: F.array(x, x)))


def prepend_dropping_last(values: Column, token: Column) -> Column:
    """Put a token in front and drop the last element, so the width stays."""
    return F.concat(F.array(token), drop_last(values, 1))


def keep_where(values: Column, mask: Column, length: Column) -> Column:
    """Elements among the first ``length`` whose mask entry is true."""
    return F.filter(values, lambda x, i: (i < length) & F.get(mask, i))


def is_valid(ids: Column) -> Column:
    """Validity mask: id 0 is padding."""
    return F.transform(ids, lambda x: x != 0)
