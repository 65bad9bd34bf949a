"""Benchmark decontamination by CGK embedding, bit sampling and edit verification.

A random walk over a sequence of words (Chakraborty, Goldenberg and Koucky,
2016) repeats each word a random number of times, decided by a hash of the
step and the word. Two sequences that differ by few edits fall into step again
after each edit, so their walks agree in most places: edit distance becomes
Hamming distance. A repetition samples a few steps of the walk as the key of a
hash table; equal keys are candidates, which an exact edit distance confirms.

Windows have the size of the items up to ``MAX_WINDOW`` words: for each size on
a geometric grid, windows start at every few words of a document, and an item
is entered at every offset at which it fills a window, so one of its windows
lines up with one of the document's. A longer item has several such windows,
some of which hold no more than their share of its edits. A walk is only followed while the steps sampled so far are a known
beginning of a key, which changes nothing in the result and saves most of it.

A match is an item whose words turn into a run of the document's words by at
most ``max_edits`` (a part of the item's words) insertions, deletions and
substitutions. The number of repetitions follows from the recall wanted at
that distance: the success of single repetitions is measured on edited copies
of the items.

Items are read in blocks of ``ITEM_BYTES``; the hash tables of a block are
sent to all tasks, and documents are scanned once per block, so a larger
benchmark costs passes, not memory.

Defined cases: null and empty texts match nothing; items of fewer than
``MIN_WORDS`` words are too short to be evidence and match nothing; rows that
repeat an item id are items of their own under one id; of several matches of
an id in a document the one with the fewest edits, then the first, counts; null
ids are reported as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm import words
from seqrec.llm.common import column, fresh

MAX_EDITS = 0.2
RECALL = 0.95
MIN_WORDS = 8
SAMPLED = 4
MAX_WINDOW = 63
ITEM_BYTES = 16 << 20
SEED = 5
_PAD = np.uint64(0)


def window_sizes(longest: int) -> list[int]:
    """Window sizes: 6 words, then each half as long again, up to ``MAX_WINDOW``."""
    sizes = [6]
    while sizes[-1] <= longest and sizes[-1] < MAX_WINDOW:
        sizes.append(sizes[-1] * 3 // 2)
    return sizes


def stride(size: int) -> int:
    """Words between window starts: an item with a window of this size has at least so many offsets."""
    return max(1, size // 3)


def _size_of(n_words: int, sizes: list[int]) -> int:
    return max(s for s in sizes if s + stride(s) - 1 <= n_words)


def _length_class(n_words: int) -> int:
    """Items whose lengths differ by less than half share a class: longer ones have more windows, so they are told apart."""
    edge = MIN_WORDS
    while edge * 3 // 2 <= n_words:
        edge = edge * 3 // 2
    return edge


class Walk:
    """One repetition for one window size: the random bits and the sampled steps."""

    def __init__(self, size: int, repetition: int) -> None:
        draw = np.random.default_rng([SEED, size, repetition])
        self.size = size
        self.steps = np.sort(draw.choice(2 * size, SAMPLED, replace=False))
        self.odd = draw.integers(0, 1 << 63, size=2 * size // 32 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.uint64(draw.integers(1, 1 << 63, dtype=np.uint64))

    def keys(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray,
             known: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each sampled step, the windows still followed and their keys so far.

        ``hashes`` has padding at its end. With ``known``, tables of the known
        beginnings, other windows are dropped as soon as their key is unknown.
        """
        live, at, stop = np.arange(len(starts)), starts.astype(np.int64), np.minimum(starts + self.size, ends)
        key, step, out = np.full(len(starts), self.salt), 0, []
        for level, sample in enumerate(self.steps.tolist()):
            while step < sample:
                bits = (hashes[at] * self.odd[step // 32]) >> np.uint64(32 + step % 32)
                at += (bits & np.uint64(1)).view(np.int64)
                step += 1
            symbol = np.where(at < stop, hashes[at], _PAD)
            key = (key ^ symbol) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(28)
            if known is not None:
                table = known[level]
                keep = table[key >> np.uint64(64 - len(table).bit_length() + 1)]
                live, at, stop, key = live[keep], at[keep], stop[keep], key[keep]
            out.append((live, key))
        return out


def _padded(hashes: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([hashes, np.zeros(by + 1, np.uint64)])


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits that turn the item into a run of the text, and where that run ends.

    Bit-parallel columns (Myers, 1999) on whole numbers of any length.
    """
    n, places = len(item), {}
    for at, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << at
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for at, word in enumerate(text.tolist(), 1):
        same = places.get(word, 0)
        across = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | ~(across | up) & full, up & across
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = right_up << 1 & full, right_down << 1 & full
        vertical = same | down
        up, down = right_down | ~(vertical | right_up) & full, right_up & vertical
        if score < best:
            best, end = score, at
    return best, end


@dataclass(frozen=True)
class Index:
    """Hash tables of a block of items for all window sizes and repetitions."""

    ids: list
    items: list[np.ndarray]
    vocabularies: list[frozenset]
    limits: list[int]
    # (walk, known beginnings, sorted keys, item of each key, offset of each key)
    tables: list[tuple[Walk, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]

    @property
    def longest(self) -> int:
        return max((len(i) for i in self.items), default=0)


def _entries(members: list[int], items: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
    """All windows of a size of the items: hashes, window starts and ends, item and offset of each."""
    starts, ends, owner, offset, at = [], [], [], [], 0
    for m in members:
        n = len(items[m])
        offsets = np.arange(n - size + 1)
        starts.append(at + offsets)
        ends.append(np.full(len(offsets), at + n))
        owner.append(np.full(len(offsets), m))
        offset.append(offsets)
        at += n
    hashes = _padded(np.concatenate([items[m] for m in members]), 2 * size)
    return hashes, *(np.concatenate(c) for c in (starts, ends, owner, offset))


def _edited(item: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        at, kind = int(draw.integers(len(out))), int(draw.integers(3))
        new = [int(draw.integers(1, 1 << 63))]
        out[at:at + (kind != 0)] = new if kind != 2 else []
    return np.array(out, np.uint64)


def repetitions(items: list[np.ndarray], sizes: list[int], max_edits: float, recall: float) -> dict[tuple[int, int], int]:
    """For each window size and class of lengths, how many repetitions reach the recall at the largest distance.

    Measured on at most 64 items of the class, edited up to their limit: each
    one's share of repetitions that find a window of the edited copy, rounded
    down by two rounds more. Items differ, so the recall is the mean over the
    items, not that of a mean item.
    """
    out, kinds = {}, [(_size_of(len(i), sizes), _length_class(len(i))) for i in items]
    for size, length in sorted(set(kinds)):
        chosen = [i for i, kind in zip(items, kinds) if kind == (size, length)][:64]
        draw, rounds, missing = np.random.default_rng([SEED, size]), 16, []
        for item in chosen:
            text = _edited(item, int(max_edits * len(item)), draw)
            own, own_starts, own_ends, _, _ = _entries([0], [item], size)
            copy = _padded(text, 2 * size)
            shift = int(draw.integers(stride(size)))
            starts, hits = np.arange(shift, max(shift + 1, len(text) - size // 2), stride(size)), 0
            for repetition in range(rounds):
                walk = Walk(size, repetition)
                mine = walk.keys(own, own_starts, own_ends)[-1][1]
                theirs = walk.keys(copy, starts, np.full(len(starts), len(text)))[-1][1]
                hits += bool(np.isin(theirs, mine).any())
            missing.append(1 - (hits + 0.5) / (rounds + 2))
        missed = np.array(missing)
        out[size, length] = next(n for n in count(1) if (missed ** n).mean() <= 1 - recall)
    return out


def build_index(rows: list[tuple], max_edits: float = MAX_EDITS, recall: float = RECALL) -> Index:
    """Tables for items given as (id, text)."""
    ids, items = [], []
    for item_id, text in rows:
        hashes = words.of_text(text or "")
        if len(hashes) >= MIN_WORDS:
            ids.append(item_id)
            items.append(hashes)
    sizes = window_sizes(max((len(i) for i in items), default=0))
    tables = []
    needed = repetitions(items, sizes, max_edits, recall) if items else {}
    times = [needed[_size_of(len(i), sizes), _length_class(len(i))] for i in items]
    for size in sorted({size for size, _ in needed}):
        members: list[int] = []
        for repetition in range(max(n for (of, _), n in needed.items() if of == size)):
            left = [m for m, i in enumerate(items) if _size_of(len(i), sizes) == size and times[m] > repetition]
            if left != members:
                members = left
                hashes, starts, ends, owner, offset = _entries(members, items, size)
                bits = max(16, min(24, int(len(starts)).bit_length() + 4))
            walk = Walk(size, repetition)
            levels, known = walk.keys(hashes, starts, ends), []
            for _, keys in levels:
                table = np.zeros(1 << bits, bool)
                table[keys >> np.uint64(64 - bits)] = True
                known.append(table)
            keys = levels[-1][1]
            order = np.argsort(keys, kind="stable")
            tables.append((walk, known, keys[order], owner[order], offset[order]))
    return Index(ids, items, [frozenset(i.tolist()) for i in items], [int(max_edits * len(i)) for i in items], tables)


def _candidates(index: Index, found: words.Words) -> set[tuple[int, int, int]]:
    """(text, item, word at which the item would begin) of every equal key."""
    out: set[tuple[int, int, int]] = set()
    counts = np.diff(found.first)
    hashes = _padded(found.hashes, 4 * max(index.longest, 8))
    by_size: dict[int, tuple[np.ndarray, ...]] = {}
    for walk, known, keys, owner, offset in index.tables:
        if walk.size not in by_size:
            gap = stride(walk.size)
            per_text = -(-counts // gap)
            text = np.repeat(np.arange(len(counts)), per_text)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            starts = found.first[:-1][text] + nth * gap
            by_size[walk.size] = text, starts, found.first[1:][text]
        text, starts, ends = by_size[walk.size]
        live, key = walk.keys(hashes, starts, ends, known)[-1]
        low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
        for w, a, b in zip(live[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            for e in range(a, b):
                out.add((int(text[w]), int(owner[e]), int(starts[w] - offset[e])))
    return out


def matches(index: Index, texts: pa.Array) -> list[list[dict]]:
    """For each text, its matches: the best one per item id."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for begin, data, offsets in words.slices(texts):
        found = words.hashed(data, offsets)
        best: dict[tuple[int, object], tuple[int, int, int]] = {}
        for text, item, at in sorted(_candidates(index, found)):
            first, last = int(found.first[text]), int(found.first[text + 1])
            limit, n = index.limits[item], len(index.items[item])
            # the item may begin and end up to the limit earlier or later than its window says
            low, high = max(first, at - 2 * limit), min(last, at + n + 2 * limit)
            # every word of the item that is not there costs an edit
            if len(index.vocabularies[item].difference(found.hashes[low:high].tolist())) > limit:
                continue
            edits, end = edit_distance(index.items[item], found.hashes[low:high])
            if edits <= limit:
                place = (edits, low + end - first, n)
                key = text, index.ids[item]
                best[key] = min(best.get(key, place), place)
        for (text, item_id), (edits, end, n) in best.items():
            out[begin + text].append({"item_id": item_id, "edits": edits, "end_word": end, "n_words": n})
    return out


MATCH = "array<struct<item_id:long,edits:int,end_word:int,n_words:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end_word", pa.int32()),
                             ("n_words", pa.int32())]))


def match_column(docs: DataFrame, index: Index, text: Column) -> Column:
    """The matches of a text column with one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(MATCH)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(matches(shared.value, texts), _ARROW)

    return find.asNondeterministic()(text)


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes``, each small enough for the driver and every task."""
    plain = items.select(column(item_id).cast("long").alias("item_id"), column(text).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = plain.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield rows


def tagged(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
           item_text: str = "text", max_edits: float = MAX_EDITS, recall: float = RECALL,
           block_bytes: int = ITEM_BYTES, matches_as: str = "matches") -> DataFrame:
    """All columns of the documents and their matches, an array; a clashing name gets an underscore more."""
    (name,) = fresh(docs, matches_as)
    found = [match_column(docs, build_index(rows, max_edits, recall), column(text))
             for rows in item_blocks(items, item_id, item_text, block_bytes)]
    return docs.withColumn(name, found[0] if len(found) == 1 else F.concat(*found))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a match, with their own columns."""
    (name,) = fresh(docs, "_matches")
    return tagged(docs, items, matches_as=name, **options).filter(F.size(column(name)) == 0).drop(name)
