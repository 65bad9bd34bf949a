"""Text functions that stay inside the JVM."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters that Python's str.split() and
# str.strip() know, as a Java character class.
UNICODE_SPACE = (
    r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A"
    r"\u2028\u2029\u202F\u205F\u3000]"
)


@lru_cache(maxsize=1)
def _folds_beyond_lower() -> dict[str, str]:
    """Lower-case characters whose full case folding is another string.

    Derived from the Unicode data of the running interpreter, about 200 of
    them (sharp s, final sigma, ligatures, Greek with iota subscript, ...).
    """
    characters = (chr(code) for code in range(128, sys.maxunicode + 1))
    return {
        c: c.casefold()
        for c in characters
        if c.lower() == c and c.casefold() != c
    }


def _character_class(characters: Iterable[str]) -> str:
    """Regular expression class of the characters, neighbours joined to ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Class of the special characters, and the SQL of the map that folds them."""
    folds = _folds_beyond_lower()
    return _character_class(folds), "map(" + ", ".join(f"'{a}', '{b}'" for a, b in folds.items()) + ")"


def casefold(text: Column) -> Column:
    """Full Unicode case folding: ``lower`` plus the folds that it leaves out.

    ASCII text only pays for ``lower`` and one scan. Other text is cut at the
    special characters, and each of those is looked up.
    """
    special, table = _fold_table()
    lowered = F.lower(text)
    pieces = F.split(lowered, f"(?<={special})|(?={special})")
    folded = F.array_join(
        F.transform(pieces, lambda c: F.coalesce(F.try_element_at(F.expr(table), c), c)), "")
    has_special = lowered.rlike(r"[^\x00-\x7F]") & lowered.rlike(special)
    return F.when(has_special, folded).otherwise(lowered)


def normalize_space(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim both ends."""
    return F.trim(F.regexp_replace(text, UNICODE_SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(normalize_space(text), F.lit("")) == ""
