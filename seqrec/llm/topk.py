"""Exact top-k by inner product with a pivot table.

Distances to many pivots are known for every vector. For a query q and a
candidate x the triangle inequality gives ``d(q, x) >= |d(q, p) - d(x, p)|`` for
every pivot p; the largest of these bounds and the two norms bound the inner
product from above.

Vectors are grouped by their nearest pivot and their distance to it, and packed
into blocks of bounded size. Per block and pivot the smallest and the largest
distance are kept, so a block of queries and a block of candidates have a bound
before any vector moves. Each block of queries first meets the block of
candidates with the highest bound and a block at the nearest pivot of each of
its queries; the k-th best scores found there are the thresholds of its
queries, and of the other blocks only those that can reach one of them are met. Inside a cell the groups of candidates are taken in
the order of their bounds, candidates outside the windows that the thresholds
leave around the pivots are passed over, and the search stops when no bound is
left that reaches a threshold. What is never met cannot enter a list, so the
result is exact.

Pivots are fitted on a bounded sample (``SAMPLE`` rows in hash order, farthest
first); they steer the work only. What the driver sees are the pivots and the
counts of groups: at most ``PIVOTS * RINGS`` numbers, whatever the data.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part, and neither do rows without id; a vector shorter than another
counts as padded with zeros; of rows that repeat an id the smallest vector
counts; equal scores rank the smaller id first; a query with fewer candidates
gets them all. Scores are sums of whole numbers and exact at any size; one
beyond the range of a bigint fails the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqrec.llm.common import column
from seqrec.session import cut_lineage

PIVOTS = 128
SAMPLE = 4096
RINGS = 32
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
_EXACT = 1 << 53
_SINGLE = 1 << 24
_INT16 = 1 << 15


def usable(vector: Column) -> Column:
    """Whether all components are there and finite."""
    wide = vector.cast("array<double>")
    return F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: float) -> Column:
    """Whole-number components: floor(scale * x), x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))


def prepared(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """``id`` and whole-number ``v`` of the rows that take part, one per id."""
    rows = df.filter(column(vec_id).isNotNull() & usable(column(vector))).select(
        column(vec_id).cast("long").alias("id"), scaled(column(vector), scale).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width`` (or to the longest)."""
    offsets = lists.offsets.to_numpy()
    values, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    width = max(width, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return values[offsets[0]:offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    inside = np.arange(width) < lengths[:, None]
    out[inside] = values[offsets[0]:offsets[-1]]
    return out


def _padded(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))) if vectors.shape[1] < width else vectors


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Farthest-first pivots among at most ``sample`` vectors, taken in the order of a hash of their id."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    vectors = _matrix(some, 0)
    if not len(vectors):
        return np.zeros((0, 0))
    chosen, nearest = [], np.full(len(vectors), np.inf)
    at = int(np.argmax((vectors ** 2).sum(axis=1)))
    while len(chosen) < pivots and (nearest[at] > 0 or not chosen):
        chosen.append(at)
        nearest = np.minimum(nearest, ((vectors - vectors[at]) ** 2).sum(axis=1))
        at = int(np.argmax(nearest))
    return vectors[_chained(vectors[chosen], chosen)]


def _chained(points: np.ndarray, chosen: list[int]) -> list[int]:
    """Pivots in an order in which neighbours are near, so that blocks of consecutive groups are."""
    left, out = list(range(len(chosen))), [0]
    left.remove(0)
    while left:
        nearest = min(left, key=lambda i: float(((points[i] - points[out[-1]]) ** 2).sum()))
        left.remove(nearest)
        out.append(nearest)
    return [chosen[i] for i in out]


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot."""
    width = max(vectors.shape[1], pivots.shape[1])
    own, points = _padded(vectors, width), _padded(pivots, width)
    square = (own ** 2).sum(axis=1)[:, None] + (points ** 2).sum(axis=1) - 2 * (own @ points.T)
    return np.sqrt(np.maximum(square, 0))


def _slack(*sizes: np.ndarray) -> np.ndarray:
    """More than what rounding does to squared distances of vectors of these squared lengths."""
    return 1e-9 * (sum(sizes) + 1)


def grouped(rows: DataFrame, pivots: np.ndarray, ring: float) -> DataFrame:
    """Add ``near``, the nearest pivot, and ``ring``, the distance to it in steps of ``ring``."""
    @F.arrow_udf("struct<near:int,ring:int>")
    def placed(vectors: pa.Array) -> pa.Array:
        table = _to_pivots(_matrix(vectors, 0), pivots)
        near = table.argmin(axis=1) if table.size else np.zeros(len(vectors), np.int64)
        away = table[np.arange(len(table)), near] if table.size else np.zeros(len(vectors))
        rings = np.minimum(away / ring, RINGS - 1).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(near.astype(np.int32)), pa.array(rings)], ["near", "ring"])

    return rows.withColumn("at", placed(F.col("v"))).select("id", "v", "at.near", "at.ring")


def packed(rows: DataFrame, limit: int) -> DataFrame:
    """Add ``block``: consecutive groups together up to ``limit`` rows; larger groups in parts by a hash of the id."""
    counts = sorted(tuple(r) for r in rows.groupBy("near", "ring").count().collect())
    places, block, held = [], 0, 0
    for near, ring, n in counts:
        parts = -(-n // limit)
        if held and held + n > limit:
            block, held = block + 1, 0
        places.append((near, ring, block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(places, "near int, ring int, first_block int, parts int"))
    own = F.col("first_block") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return cut_lineage(rows.join(table, ["near", "ring"]).select("id", "v", "near", own.alias("block")))


def _of_blocks(rows: DataFrame, pivots: np.ndarray, *more: Column) -> DataFrame:
    """Per block: ``low`` and ``high``, the distances to each pivot, and ``norm``, the largest squared length."""
    @F.arrow_udf("struct<norm:double,d:array<double>>")
    def measured(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors, 0)
        table = _to_pivots(matrix, pivots)
        offsets = np.arange(len(table) + 1, dtype=np.int32) * len(pivots)
        return pa.StructArray.from_arrays(
            [pa.array((matrix ** 2).sum(axis=1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))], ["norm", "d"])

    wide = rows.select("block", measured(F.col("v")).alias("m")).select("block", "m.norm", F.posexplode("m.d").alias("p", "d"))
    per_pivot = wide.groupBy("block", "p").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("norm").alias("norm"))
    return per_pivot.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("spans"), F.max("norm").alias("norm"))


def cells(asked: DataFrame, items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``query_block, item_block, gap, norm, upper``: the least distance of each pair of blocks by the pivots, and what bounds their scores.

    One row per pair of blocks, not of vectors.
    """
    left = _of_blocks(asked, pivots).select(F.col("block").alias("query_block"), F.col("spans").alias("q"), F.col("norm").alias("qq"))
    right = cut_lineage(_of_blocks(items, pivots))
    blocks = right.agg(F.max("block")).first()[0]
    if blocks is None:
        return asked.sparkSession.createDataFrame([], "query_block int, item_block int, gap double, norm double, upper double")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))
    gap = F.coalesce(F.array_max(F.zip_with("q", "spans", lambda a, b: F.greatest(
        F.lit(0.0), b["low"] - a["high"], a["low"] - b["high"]))), F.lit(0.0))
    size = F.col("qq") + F.col("norm")
    upper = (size - gap * gap) / 2 + F.lit(1e-6) * (size + 1)
    return left.join(right, "block").select("query_block", F.col("block").alias("item_block"), gap.alias("gap"), "norm", upper.alias("upper"))


def reached(bounds: DataFrame, armed: DataFrame) -> DataFrame:
    """``query_block, item_block`` of the cells in which some query may still find a score of ``least``.

    A score of t or more means a squared distance of at most |q|^2 + |x|^2 - 2t,
    so the queries of a block count by their largest |q|^2 - 2t.
    """
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    reach = armed.groupBy(F.col("block").alias("query_block")).agg(F.max(size - 2 * F.col("least")).alias("reach"), F.max(size).alias("qq"))
    slack = F.lit(1e-6) * (F.col("norm") + F.col("qq") + 1)
    found = bounds.join(reach, "query_block").filter(F.col("gap") * F.col("gap") <= F.col("norm") + F.col("reach") + slack)
    return found.select("query_block", "item_block")


def _first_cells(asked: DataFrame, items: DataFrame, bounds: DataFrame) -> DataFrame:
    """``query_block, item_block``: the most promising cell of each block of queries, and one at the nearest pivot of each query."""
    best = bounds.groupBy("query_block").agg(F.min_by("item_block", F.struct(-F.col("upper"), "item_block")).alias("item_block"))
    near = items.groupBy("near").agg(F.min("block").alias("item_block"))
    own = asked.select("near", F.col("block").alias("query_block")).distinct().join(near, "near")
    return best.unionByName(own.select("query_block", "item_block")).distinct()


class _Lists:
    """The k best candidates of each query so far; ``least`` is what a score must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending, self.most = 0, 2 * n * k

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append((row, ids, score))
        self.pending += len(row)
        if self.pending > self.most:
            self.settle()

    def settle(self) -> None:
        row, ids, score = (np.concatenate(x) for x in zip((self.row, self.id, self.score), *self.waiting))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        full = place == self.k - 1
        self.least[row[full]] = np.maximum(self.least[row[full]], score[full])
        kept = place < self.k
        self.row, self.id, self.score = row[kept], ids[kept], score[kept]
        self.waiting, self.pending = [], 0


def _any_size(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The lists of a cell whose scores are beyond what floats hold exactly."""
    whole, out = [[int(v) for v in row] for row in x], ([], [], [])
    for own, vector in zip(q_ids.tolist(), q):
        ints = [int(v) for v in vector]
        found = sorted((-sum(a * b for a, b in zip(ints, other)), i) for i, other in zip(x_ids.tolist(), whole) if i != own)[:k]
        for score, i in found:
            for column_, value in zip(out, (own, i, -score)):
                column_.append(value)
    return out


def _cell(queries: pa.Table, candidates: pa.Table, pivots: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best candidates of this block, at least as good as the thresholds, for each query of this block."""
    candidates = candidates.sort_by([("near", "ascending"), ("id", "ascending")])
    q_lists, x_lists = (t.column("v").combine_chunks() for t in (queries, candidates))
    width = max(_matrix(x, 0).shape[1] for x in (q_lists, x_lists))
    q, x = (_matrix(lists, width).astype(float) for lists in (q_lists, x_lists))
    q_ids, x_ids, near = queries.column("id").to_numpy(), candidates.column("id").to_numpy(), candidates.column("near").to_numpy()
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, width)
    if largest >= _EXACT:
        return _any_size(q, q_ids, x, x_ids, k)
    qq, xx = (q ** 2).sum(axis=1), (x ** 2).sum(axis=1)
    dq, dx = _to_pivots(q, pivots), _to_pivots(x, pivots)
    kind = np.float32 if largest < _SINGLE else np.float64
    q, x = q.astype(kind), x.astype(kind)
    begins = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
    ends = np.append(begins[1:], len(near))
    norm = np.maximum.reduceat(xx, begins)
    upper = np.empty((len(q), len(begins)))
    for i, (low, high) in enumerate(zip(np.minimum.reduceat(dx, begins), np.maximum.reduceat(dx, begins))):
        gap = np.maximum(low - dq, dq - high).max(axis=1, initial=0)
        upper[:, i] = (qq + norm[i] - gap ** 2) / 2 + 1e3 * _slack(qq, norm[i])
    lists = _Lists(len(q), k, queries.column("least").to_numpy().astype(float))
    for i in np.argsort(-upper.max(axis=0), kind="stable").tolist():
        rows = np.flatnonzero(upper[:, i] >= lists.least)
        if not len(rows):
            continue
        own = np.arange(begins[i], ends[i])
        least = lists.least[rows]
        reach = np.sqrt(np.maximum(0, qq[rows] + norm[i] - 2 * least + 1e3 * _slack(qq[rows], norm[i])))[:, None]
        inside = (dx[own] >= (dq[rows] - reach).min(axis=0)) & (dx[own] <= (dq[rows] + reach).max(axis=0))
        own = own[inside.all(axis=1)]
        if not len(own):
            continue
        scores = q[rows] @ x[own].T
        _, same, at = np.intersect1d(q_ids[rows], x_ids[own], assume_unique=True, return_indices=True)
        scores[same, at] = -np.inf
        free = least == -np.inf
        if free.any() and len(own) > k:
            least[free] = np.partition(scores[free], len(own) - k, axis=1)[:, len(own) - k]
        row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        lists.add(rows[row], x_ids[own[at]], scores[row, at].astype(float))
    lists.settle()
    return q_ids[lists.row].tolist(), lists.id.tolist(), [int(s) for s in lists.score]


def _meet(chosen: DataFrame, asked: DataFrame, items: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Lists of the queries over the chosen cells; ``asked`` has ``least``, the threshold of each query."""
    def meet(own: pa.Table, theirs: pa.Table) -> pa.Table:
        found = _cell(own, theirs, pivots, k) if own.num_rows and theirs.num_rows else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    largest = F.max(F.array_max(F.transform("v", F.abs)))
    both = [df.agg(largest).first()[0] or 0 for df in (asked, items)]
    narrow = F.col("v").cast("array<smallint>" if max(both) < _INT16 else "array<double>").alias("v")
    left = asked.select("id", narrow, "least", F.col("block").alias("query_block")).join(chosen, "query_block")
    right = items.select("id", narrow, "near", F.col("block").alias("item_block")).join(
        chosen.select(F.col("query_block").alias("of_query"), "item_block"), "item_block").select(
        "id", "v", "near", F.col("of_query"), F.col("item_block").alias("of_item"))
    return left.groupBy("query_block", "item_block").cogroup(right.groupBy("of_query", "of_item")).applyInArrow(
        meet, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding",
          scale: float = 64.0, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query but itself."""
    items = cut_lineage(prepared(candidates, vec_id, vector, scale))
    asked = cut_lineage(prepared(queries, vec_id, vector, scale))
    points = fit_pivots(items, pivots)
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    ring = max(1e-9, 2 * (items.agg(F.max(size)).first()[0] or 0.0) ** 0.5 / RINGS)
    items, asked = packed(grouped(items, points, ring), candidate_block), packed(grouped(asked, points, ring), query_block)
    bounds = cut_lineage(cells(asked, items, points))
    first = cut_lineage(_first_cells(asked, items, bounds))
    nothing = asked.withColumn("least", F.lit(float("-inf")))
    found = cut_lineage(_meet(first, nothing, items, points, k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    known = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    armed = cut_lineage(asked.join(known, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    left = reached(bounds.join(first, ["query_block", "item_block"], "left_anti"), armed)
    more = _meet(cut_lineage(left), armed, items, points, k)
    return found.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
