"""Exact top-k retrieval by inner product.

Items are grouped around centroids into blocks of bounded bytes. A block keeps
its centroid c, its radius r and its largest norm, so the score of a query q
with any of its items is at most ``min(q.c + |q| r, |q| norm)``. Retrieval goes
best first: each query meets the block with its highest bound; the k-th score
it finds there is its threshold, and of the other blocks it meets only those
whose bound reaches the threshold. Small blocks travel in bundles, so a query
travels once per bundle in which it meets a block, whatever the block size.
Items that fit into one block need no bounds and are met at once.

A cell is a run of small matrix products inside one task. They are made in
single precision, on scaled vectors, and only preselect: what reaches the k-th
exact score so far, less the largest rounding error, is scored again in doubles.
Excluded ids are masked before the selection, so nothing is over-fetched, and
only k rows per query leave a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seqrec.functions import vectors
from seqrec.operators import skew
from seqrec.session import cut_lineage, once

BLOCK_BYTES = 128 * 1024 * 1024
CELL_BYTES = 128 * 1024 * 1024
SMALLEST_SHARD = 512
SCORES_IN_MEMORY = 4_000_000
# scores of one product, small enough for a core's cache, and the items in it
TILE_SCORES = 524_288
TILE_ITEMS = 512
MOST_CENTROIDS = 1024
SAMPLE = 8192
ROUNDS = 4


def candidates(universe: DataFrame, table: DataFrame, *, eps: float = 1e-6,
               normalize: bool = True) -> DataFrame:
    """Candidate table: the ids of the universe with their (unit) vectors."""
    vector = F.col("embedding").cast(vectors.DOUBLES)
    if normalize:
        vector = vectors.l2_normalize(vector, eps)
    # one row per id on both sides
    return universe.join(table.select("item_id", vector.alias("embedding")), "item_id")


def last_item_queries(ratings: DataFrame, table: DataFrame, *, user: str = "user_id",
                      order: tuple[str, ...] = ("ts", "ord"),
                      hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Query vector of a user: the vector of the item at the last position."""
    last = ratings.groupBy(user).agg(F.max_by("item_id", F.struct(*order)).alias("item_id"))
    joined = skew.spread_join(last, table.select("item_id", "embedding"), ["item_id"],
                              hot_rows=hot_rows)
    return joined.select(user, F.col("embedding").cast(vectors.DOUBLES).alias("embedding"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return vectors.as_matrix(values)


def _narrowed(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows divided by ``size`` in single precision; rows without a finite size become zeros."""
    finite = np.isfinite(size)
    return np.where(finite[:, None], rows / np.where(finite & (size > 0), size, 1.0)[:, None], 0.0).astype(np.float32)


def _sizes(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt((rows ** 2).sum(axis=1))


def _exact(queries: np.ndarray, items: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores pair by pair in doubles, so equal vectors have equal scores in any blocking."""
    exact = np.empty(len(row))
    piece = max(1, SCORES_IN_MEMORY // max(1, items.shape[1]))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, len(row), piece):
            cut = slice(i, i + piece)
            exact[cut] = (queries[row[cut]] * items[at[cut]]).sum(axis=1)
    return exact


def _where(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few set entries of a mask, looked for eight at a time."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    row, at = np.nonzero(mask.reshape(-1, 8)[words])
    return words[row] * 8 + at


class _Best:
    """The k best pairs of some queries so far, and the bar that the next pairs have to reach."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, items: np.ndarray, k: int, unit: float,
                 least: np.ndarray | None) -> None:
        self.queries, self.ids, self.items, self.k = queries, ids, items, k
        size = _sizes(queries)
        # a scaled score in single precision errs by less than half of this
        self.slack = (items.shape[1] + 8) * 2.0 ** -22
        self.scale = np.where(size > 0, size, 1.0) * unit
        self.loose = ~np.isfinite(self.scale)
        self.narrow = _narrowed(queries, size)
        self.least = np.full(len(queries), -np.inf) if least is None else least.astype(np.float64)
        self.row, self.at, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.number = 0
        # products tell nothing where scores overflow, and little among equal vectors
        self.blunt = bool(self.loose.any())
        self._raise()

    def _raise(self) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            bar = self.least / self.scale - self.slack
        lowest = float(np.finfo(np.float32).min)
        self.bar = np.where(self.loose | ~(bar > lowest), lowest, bar).astype(np.float32)

    def add(self, row: np.ndarray, at: np.ndarray, near: np.ndarray) -> None:
        self.waiting.append((row, at, near))
        self.number += len(row)

    def sift(self) -> None:
        """Raise the bars by the products of what waits, and let go of what is below them.

        Once that leaves more than 2 k pairs for a query, what waits is scored.
        """
        if not self.number:
            return
        if not self.blunt:
            row, at, near = (np.concatenate(x) for x in zip(*self.waiting))
            order = np.lexsort((-near, row))
            row, at, near = row[order], at[order], near[order]
            last = np.arange(len(row)) - np.searchsorted(row, row, side="left") == self.k - 1
            # the k-th score is at least this
            self.least[row[last]] = np.maximum(self.least[row[last]], (near[last] - self.slack) * self.scale[row[last]])
            self._raise()
            keep = near >= self.bar[row]
            self.waiting = [(row[keep], at[keep], near[keep])]
            self.number = len(self.waiting[0][0])
            self.blunt = self.number > 2 * self.k * len(self.queries)
        if self.blunt:
            self.settle()

    def settle(self) -> None:
        """Score what waits and keep the k best pairs of each query."""
        if not self.number:
            return
        row, at, _ = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.number = [], 0
        score = _exact(self.queries, self.items, row, at)
        real = score > -np.inf
        row, at, score = (np.concatenate(x) for x in ((self.row, row[real]), (self.at, at[real]), (self.score, score[real])))
        order = np.lexsort((self.ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = place < self.k
        self.row, self.at, self.score = row[keep], at[keep], score[keep]
        last = place == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])
        self._raise()


def _best_in_blocks(queries: np.ndarray, excluded: list[np.ndarray] | None, ids: np.ndarray, items: np.ndarray,
                    k: int, least: np.ndarray | None = None, spans: list[tuple[int, int]] | None = None,
                    upper: Callable[[slice], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (query row, item id, score) of the k best items per query, of those that reach ``least``.

    ``spans`` are the ranges of the items that belong to one block, by default
    one; with ``upper``, a function of query rows, a query leaves out the
    blocks whose bound is below its k-th score so far. Products preselect in
    single precision, with a tolerance above its largest error; only the rows
    whose largest product reaches the bar are looked at. The kept pairs are
    scored again in doubles and ties are decided by the smaller id.
    """
    spans = [(0, len(ids))] if spans is None else spans
    size = _sizes(items)
    unit = float(size.max(initial=0.0)) or 1.0
    narrow = np.ascontiguousarray(_narrowed(items, np.full(len(items), unit)).T)
    by_id = np.argsort(ids, kind="stable")
    sorted_ids = ids[by_id]
    widest = max(1, min(TILE_ITEMS, max((b - a for a, b in spans), default=1)))
    step = max(256, TILE_SCORES // widest)
    room = np.empty(min(step, len(queries)) * widest, np.float32)
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        best = _Best(queries[part], ids, items, k, unit, None if least is None else least[part])
        everyone = np.arange(len(best.queries))
        gone_row = gone_at = np.empty(0, np.int64)
        if excluded is not None:
            lists = excluded[part]
            row = np.repeat(everyone, [len(x) for x in lists])
            values = np.concatenate(lists) if lists else np.empty(0, dtype=ids.dtype)
            place = np.minimum(np.searchsorted(sorted_ids, values), len(ids) - 1)
            hit = sorted_ids[place] == values
            gone_row, gone_at = row[hit], by_id[place[hit]]
            order = np.argsort(gone_at, kind="stable")
            gone_row, gone_at = gone_row[order], gone_at[order]
        bounds = None if upper is None else upper(part)
        visits = range(len(spans)) if bounds is None else np.argsort(-bounds.max(axis=0), kind="stable")
        seen, settled = 0, 0
        for span in visits:
            rows = everyone if bounds is None else np.flatnonzero((bounds[:, span] >= best.least) & (bounds[:, span] > -np.inf))
            if not len(rows):
                continue
            asking = best.narrow if len(rows) == len(everyone) else best.narrow[rows]
            position = np.full(len(everyone), -1)
            position[rows] = np.arange(len(rows))
            for a in range(*spans[span], TILE_ITEMS):
                b = min(a + TILE_ITEMS, spans[span][1])
                scores = np.matmul(asking, narrow[:, a:b], out=room[:len(rows) * (b - a)].reshape(len(rows), b - a))
                first, last = np.searchsorted(gone_at, (a, b))
                if last > first:
                    where = position[gone_row[first:last]]
                    scores[where[where >= 0], gone_at[first:last][where >= 0] - a] = -np.inf
                bar = best.bar[rows]
                if not settled and k < b - a:
                    near = np.partition(scores, b - a - k, axis=1)[:, b - a - k] - 2 * best.slack
                    bar = np.where(best.loose[rows], bar, np.maximum(bar, near)).astype(np.float32)
                high = np.flatnonzero(scores.max(axis=1) >= bar)
                if len(high):
                    scores = scores if len(high) == len(rows) else scores[high]
                    row, at = np.divmod(_where(scores >= bar[high, None]), b - a)
                    best.add(rows[high[row]], at + a, scores[row, at])
                seen += b - a
                # the bars rise whenever the seen items have doubled
                if seen >= 2 * settled or best.number > 4 * k * len(everyone):
                    best.sift()
                    settled = seen
        best.settle()
        yield best.row + start, ids[best.at], best.score


@dataclass(frozen=True)
class Bounds:
    """Each block's centroid, radius and largest norm (at most a few thousand rows)."""

    centroids: np.ndarray
    radius: np.ndarray
    norm: np.ndarray

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of each query in each block, a little more than rounding needs."""
        size = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        upper = np.minimum(queries @ self.centroids.T + size * self.radius, size * self.norm)
        return upper + 1e-9 * (1 + size * self.norm)

    def of(self, blocks: np.ndarray) -> Bounds:
        return Bounds(self.centroids[blocks], self.radius[blocks], self.norm[blocks])


    def pieces(self, queries: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The bounds of a bounded number of queries at a time."""
        step = max(1, SCORES_IN_MEMORY // len(self.norm))
        for start in range(0, len(queries), step):
            yield slice(start, start + step), self.upper(queries[start:start + step])


def _fit_centroids(items: DataFrame, wanted: int) -> np.ndarray:
    """Centroids of at most ``SAMPLE`` vectors in the order of a hash; they steer the work only."""
    some = items.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).select(F.col("embedding").cast(vectors.DOUBLES).alias("v"))
    points = vectors.as_matrix(some.toArrow().column(0).combine_chunks())
    chosen, nearest, at = [], np.full(len(points), np.inf), 0
    while len(chosen) < wanted and nearest[at] > 0:
        chosen.append(at)
        nearest = np.minimum(nearest, ((points - points[at]) ** 2).sum(axis=1))
        at = int(np.argmax(nearest))
    centroids = points[chosen]
    for _ in range(ROUNDS):
        own = _nearest(points, centroids)[0]
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point and the distance to it."""
    square = (points ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1) - 2 * (points @ centroids.T)
    own = square.argmin(axis=1)
    return own, np.sqrt(((points - centroids[own]) ** 2).sum(axis=1))


def blocked(items: DataFrame, blocks: int) -> tuple[DataFrame, Bounds]:
    """Items with their ``_block``, around centroids, in about ``blocks`` blocks of nearly equal size: a large group is cut by a hash of the id."""
    centroids = _fit_centroids(items, min(blocks, MOST_CENTROIDS))

    @F.arrow_udf("struct<near:int,away:double,norm:double>")
    def placed(column: pa.Array) -> pa.Array:
        points = vectors.as_matrix(column)
        if not len(points):
            return pa.array([], pa.struct([("near", pa.int32()), ("away", pa.float64()), ("norm", pa.float64())]))
        own, away = _nearest(points, centroids)
        return pa.StructArray.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(away), pa.array(np.sqrt((points ** 2).sum(axis=1)))], ["near", "away", "norm"])

    near = cut_lineage(items.select("item_id", "embedding", placed(F.col("embedding").cast(vectors.DOUBLES)).alias("p"))
                       .select("item_id", "embedding", "p.*"))
    counts = sorted(tuple(r) for r in near.groupBy("near").count().collect())  # one row per centroid
    limit, first, table = max(1, -(-sum(n for _, n in counts) // blocks)), 0, []
    for group, n in counts:
        table.append((group, first, -(-n // limit)))
        first += -(-n // limit)
    parts = F.broadcast(items.sparkSession.createDataFrame(table, "near int, first int, parts int"))
    own = F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")
    done = cut_lineage(near.join(parts, "near").select("item_id", "embedding", "near", "away", "norm", own.alias("_block")))
    seen = {r["_block"]: r for r in done.groupBy("_block").agg(
        F.min("near").alias("near"), F.max("away").alias("away"), F.max("norm").alias("norm")).collect()}
    # a block that no item fell into has nothing to find
    rows = [seen.get(i) for i in range(first)]
    bounds = Bounds(np.stack([centroids[r["near"]] if r else np.zeros(centroids.shape[1]) for r in rows]),
                    np.array([r["away"] if r else 0.0 for r in rows]), np.array([r["norm"] if r else -np.inf for r in rows]))
    return done.select("item_id", "embedding", "_block"), bounds


def _meet(asked: DataFrame, items: DataFrame, k: int, user: str, listed: str | None, cells: int, cell_bytes: int,
          parallelism: int, bounds: Bounds | None = None) -> DataFrame:
    """The k best of each query in each cell it asks: ``asked`` has the user, embedding, ``_cell``, perhaps ``_least`` and a list.

    ``items`` have their ``_cell`` and ``_block``. With ``bounds`` a query
    meets the blocks of the cell that may hold better items than it has, and
    not the one it has met (``_met``). The queries of a cell are dealt to as
    many shards as keep their bytes within ``cell_bytes``, and its items go to
    each of them.
    """
    width = F.size("embedding") + (F.greatest(F.coalesce(F.size(listed), F.lit(0)), F.lit(0)) if listed else F.lit(0))
    n = F.count(F.lit(1))
    loads = asked.groupBy("_cell").agg(F.ceil(F.sum(width) * 8 / cell_bytes).alias("fitting"), n.alias("n"))
    # few cells are dealt to more shards, but no more than keep the cores busy: each shard takes the items again
    spread = F.least(F.lit(min(parallelism, -(-5 * parallelism // cells))), F.ceil(F.col("n") / SMALLEST_SHARD))
    shards = F.broadcast(cut_lineage(loads.select("_cell", F.greatest(F.lit(1), "fitting", spread).cast("int").alias("_shards"))))
    left = asked.join(shards, "_cell").withColumn("_shard", F.pmod(F.xxhash64(user), F.col("_shards")).cast("int")).drop("_shards")
    right = items.join(shards, "_cell").select(
        "item_id", "embedding", "_block", F.col("_cell").alias("_of_cell"),
        F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_of_shard"))
    kinds = (asked.schema[user].dataType, items.schema["item_id"].dataType)
    schema = StructType([StructField(user, kinds[0]), StructField("item_id", kinds[1])]).add("score", "double")
    has_least = "_least" in asked.columns

    def cell(queries: pa.Table, block: pa.Table) -> pa.Table:
        names = [user, "item_id", "score"]
        if queries.num_rows == 0 or block.num_rows == 0:
            return pa.table([pa.array([], type=queries.schema.field(user).type) if queries.num_columns else pa.array([], pa.int64()),
                             pa.array([], type=block.schema.field("item_id").type) if block.num_columns else pa.array([], pa.int64()),
                             pa.array([], pa.float64())], names=names)
        if bounds is not None:
            # queries of one best block have much the same bounds
            queries = queries.sort_by("_met")
        ids, blocks = block["item_id"].to_numpy(), block["_block"].to_numpy()
        order = np.lexsort((ids, blocks))
        ids, blocks, matrix = ids[order], blocks[order], _matrix(block["embedding"])[order]
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        spans = list(zip(edges[:-1], edges[1:]))
        lists = None
        if listed:
            lists = [np.asarray(x if x is not None else [], dtype=ids.dtype) for x in queries[listed].to_pandas()]
        least = queries["_least"].to_numpy() if has_least else None
        asking, upper = _matrix(queries["embedding"]), None
        if bounds is not None:
            here = bounds.of(blocks[edges[:-1]])
            met = queries["_met"].to_numpy()[:, None] == blocks[edges[:-1]]

            def upper(part: slice) -> np.ndarray:
                return np.where(met[part], -np.inf, here.upper(asking[part]))

        parts = list(_best_in_blocks(asking, lists, ids, matrix, k, least, spans, upper))
        row = np.concatenate([p[0] for p in parts])
        return pa.table([queries[user].take(pa.array(row)).combine_chunks(), pa.array(np.concatenate([p[1] for p in parts])),
                         pa.array(np.concatenate([p[2] for p in parts]))], names=names)

    return left.groupBy("_cell", "_shard").cogroup(right.groupBy("_of_cell", "_of_shard")).applyInArrow(cell, schema)


def _best_first(queries: DataFrame, items: DataFrame, bounds: Bounds, k: int, user: str, exclude: str | None, bundle: int,
                cell_bytes: int, parallelism: int) -> DataFrame:
    """Lists of all queries: their best block first, then every block whose bound reaches the k-th score, by bundles of ``bundle`` blocks."""
    @F.arrow_udf("int")
    def best(column: pa.Array) -> pa.Array:
        queries = vectors.as_matrix(column)
        found = [upper.argmax(axis=1) for _, upper in bounds.pieces(queries)] if len(column) else []
        return pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32())

    @F.arrow_udf("array<int>")
    def others(column: pa.Array, first: pa.Array, least: pa.Array) -> pa.Array:
        """The bundles with a block to be met."""
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        queries = vectors.as_matrix(column)
        first, least = (x.to_numpy(zero_copy_only=False) for x in (first, least))
        found = []
        for part, upper in bounds.pieces(queries):
            wanted = (upper >= least[part][:, None]) & (bounds.norm > -np.inf)
            wanted[np.arange(len(wanted)), first[part]] = False
            found.append(np.logical_or.reduceat(wanted, np.arange(0, wanted.shape[1], bundle), axis=1))
        row, cell = np.nonzero(np.concatenate(found))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(queries) + 1)).astype(np.int32)), pa.array(cell.astype(np.int32)))

    wide = F.col("embedding").cast(vectors.DOUBLES)
    # a list belongs to a known user: one without an id leaves nothing out here
    lists = [F.when(F.col(user).isNotNull(), F.col(exclude)).alias(exclude)] if exclude else []
    asked = cut_lineage(queries.select(user, "embedding", *lists, best(wide).alias("_cell")))
    found = cut_lineage(_meet(asked, items.withColumn("_cell", F.col("_block")), k, user, exclude, len(bounds.norm), cell_bytes, parallelism))
    # at most k rows per user so far
    reached = found.groupBy(user).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).filter(F.col("_n") == k)
    armed = asked.withColumnRenamed("_cell", "_met").join(reached.select(user, "_least"), user, "left") \
                 .withColumn("_least", F.coalesce("_least", F.lit(float("-inf"))))
    # written with the list of its bundles, a query is there once
    more = cut_lineage(armed.withColumn("_cells", others(wide, F.col("_met"), F.col("_least"))))
    more = more.withColumn("_cell", F.explode("_cells")).drop("_cells")
    bundles = items.withColumn("_cell", F.floor(F.col("_block") / bundle).cast("int"))
    return found.unionByName(_meet(more, bundles, k, user, exclude, -(-len(bounds.norm) // bundle), cell_bytes, parallelism, bounds))


def top_k(queries: DataFrame, items: DataFrame, k: int, *, user: str = "user_id",
          exclude: str | None = None, block_bytes: int = BLOCK_BYTES, cell_bytes: int = CELL_BYTES,
          parallelism: int | None = None) -> DataFrame:
    """The k items with the largest inner product per query, as (user, rank, item_id, score).

    ``queries``: user, embedding, and optionally an array column ``exclude``
    of item ids that may not be returned to that user. ``items``: item_id,
    embedding; one row per id. Ties go to the smaller item id; fewer than k
    rows are returned when fewer candidates are left. Vectors move in the type
    they come in and are doubles inside a task. Blocks hold ``block_bytes``,
    and those smaller than ``cell_bytes`` are met in bundles of that size.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if parallelism is None:
        parallelism = queries.sparkSession.sparkContext.defaultParallelism
    # a user or item without a vector has no score
    queries, items = (once(t.filter(F.col("embedding").isNotNull())) for t in (queries, items))
    size = items.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        asked = queries.select(user, "embedding", *([exclude] if exclude else []), F.lit(0).alias("_cell"))
        best = _meet(asked, items.withColumns({"_cell": F.lit(0), "_block": F.lit(0)}), k, user, exclude, 1, cell_bytes, parallelism)
    else:
        best = _best_first(queries, *blocked(items, blocks), k, user, exclude, max(1, cell_bytes // block_bytes), cell_bytes, parallelism)
    ranked = skew.top_per_group(best, [user], [F.desc("score"), F.asc("item_id")], k)
    return ranked.select(user, "rank", "item_id", "score")


def valid_candidates(queries: DataFrame, items: DataFrame, exclude: str, *,
                     user: str = "user_id") -> DataFrame:
    """How many candidates are left per user once the excluded ids are removed.

    The excluded ids that exist are counted against the number of items; the
    per-user candidate sets themselves are never written out.
    """
    queries, items = once(queries), once(items)
    total = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    listed = queries.select(user, F.explode(F.array_distinct(exclude)).alias("item_id"))
    present = skew.spread_join(listed, items.select("item_id"), ["item_id"], "left_semi")
    hits = present.groupBy(user).agg(F.count(F.lit(1)).alias("_hits"))
    return queries.select(user).join(hits, user, "left").select(
        user, (total - F.coalesce(F.col("_hits"), F.lit(0))).alias("n_candidates"))


def prediction_lists(ranked: DataFrame, *, user: str = "user_id") -> DataFrame:
    """One row per user: ids and scores in rank order (at most k of them)."""
    packed = ranked.groupBy(user).agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("_p"))
    return packed.select(user, F.col("_p.item_id").alias("top_k_ids"),
                         F.col("_p.score").alias("top_k_scores"))


def attach_pair_vectors(ranked: DataFrame, queries: DataFrame, items: DataFrame, *,
                        user: str = "user_id", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """User and item vectors of the retrieved pairs."""
    users = queries.select(user, F.col("embedding").cast(vectors.DOUBLES).alias("user_vector"))
    table = items.select("item_id", F.col("embedding").cast(vectors.DOUBLES).alias("item_vector"))
    # at most k rows per user on the left, one on the right
    with_user = ranked.join(users, user)
    return skew.spread_join(with_user, table, ["item_id"], hot_rows=hot_rows)

