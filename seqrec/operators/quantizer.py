"""Residual quantization: layers of k-means on what the layers before left over.

The vectors stay distributed. A pass over them is one map that returns, per
task, at most K partial sums, and one aggregation; only the K x D centroids
of a layer reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.functions import vectors
from seqrec.session import cut_lineage

EPS = 1e-12
ROWS_PER_CHUNK = 65_536
PAIRS_IN_MEMORY = 8_000_000


@dataclass
class ResidualQuantizer:
    """Codebooks (K x D each) and how they were fitted."""

    codebooks: list[np.ndarray]
    normalize: bool = True
    layers: list[dict] = field(default_factory=list)

    def quantize(self, table: DataFrame, *, item: str = "item_id") -> DataFrame:
        return quantize(table, self.codebooks, normalize=self.normalize, item=item)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """(layer, code, centroid): a model of K x D numbers per layer."""
        rows = [(layer, code, [float(x) for x in centroid])
                for layer, book in enumerate(self.codebooks) for code, centroid in enumerate(book)]
        return spark.createDataFrame(rows, "layer int, code int, centroid array<double>")

    @classmethod
    def from_table(cls, table: DataFrame, normalize: bool = True) -> ResidualQuantizer:
        books: dict[int, list] = {}
        for row in table.orderBy("layer", "code").collect():  # the model, not data
            books.setdefault(row["layer"], []).append(row["centroid"])
        return cls([np.asarray(books[i]) for i in sorted(books)], normalize)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), EPS)


def nearest(matrix: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid per row (lowest index on ties) and its distance.

    The norm expansion preselects; where several centroids are within rounding
    distance of the best, the plain differences decide.
    """
    distance = ((matrix ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1)[None, :]
                - 2.0 * (matrix @ centroids.T))
    np.maximum(distance, 0.0, out=distance)
    code = distance.argmin(axis=1)
    best = distance[np.arange(len(matrix)), code]
    close = distance <= best[:, None] + 1e-9
    several = np.flatnonzero(np.count_nonzero(close, axis=1) > 1)
    step = max(1, PAIRS_IN_MEMORY // (len(centroids) * max(1, matrix.shape[1])))
    for start in range(0, len(several), step):
        rows = several[start:start + step]
        at, option = np.nonzero(close[rows])
        exact = ((matrix[rows[at]] - centroids[option]) ** 2).sum(axis=1)
        order = np.lexsort((option, exact, at))
        first = order[np.searchsorted(at[order], np.arange(len(rows)))]
        code[rows] = option[first]
    return code, best


def sum_by_code(points: np.ndarray, code: np.ndarray, total: np.ndarray) -> None:
    """Add every point to the row of ``total`` that its code names."""
    if len(points):
        order = np.argsort(code, kind="stable")
        used, starts = np.unique(code[order], return_index=True)
        total[used] += np.add.reduceat(points[order], starts, axis=0)


def encode_matrix(matrix: np.ndarray, codebooks: Sequence[np.ndarray],
                  normalize: bool) -> np.ndarray:
    residual = unit_rows(matrix) if normalize else matrix
    codes = np.empty((len(matrix), len(codebooks)), dtype=np.int32)
    for layer, book in enumerate(codebooks):
        codes[:, layer] = nearest(residual, book)[0]
        residual = residual - book[codes[:, layer]]
        if normalize:
            residual = unit_rows(residual)
    return codes


def _matrix(array: pa.ListArray) -> np.ndarray:
    return vectors.as_matrix(array)


def _list_array(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    ends = pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(matrix).ravel()))


def quantize(table: DataFrame, codebooks: Sequence[np.ndarray], *, normalize: bool = True,
             item: str = "item_id") -> DataFrame:
    """Codes per item (array<int>), one map over the vectors."""
    books = table.sparkSession.sparkContext.broadcast([np.asarray(b, dtype=np.float64)
                                                       for b in codebooks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = encode_matrix(_matrix(batch.column(1)), books.value, normalize)
                yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(codes)],
                                                 names=[item, "codes"])

    kind = table.schema[item].dataType.simpleString()
    return table.select(item, F.col("embedding").cast(vectors.DOUBLES).alias("embedding")) \
                .mapInArrow(run, f"{item} {kind}, codes array<int>")


def distortion(table: DataFrame, quantizer: ResidualQuantizer, layers: int) -> DataFrame:
    """Mean squared length of the residual before normalisation at the last of ``layers``."""
    books = [np.asarray(b) for b in quantizer.codebooks[:layers]]
    normalize = quantizer.normalize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            residual = _matrix(batch.column(0))
            if not len(residual):
                continue
            residual = unit_rows(residual) if normalize else residual
            for layer, book in enumerate(books):
                residual = residual - book[nearest(residual, book)[0]]
                if normalize and layer + 1 < len(books):
                    residual = unit_rows(residual)
            yield pa.RecordBatch.from_arrays(
                [pa.array([float((residual ** 2).sum())]), pa.array([len(residual)])],
                names=["cost", "n"])

    parts = table.select(F.col("embedding").cast(vectors.DOUBLES)).mapInArrow(
        run, "cost double, n long")
    return parts.agg((F.sum("cost") / F.sum("n")).alias("distortion"))


class _Layer:
    """Passes over the residuals of one layer."""

    def __init__(self, residuals: DataFrame, item: str, seed: int):
        self.residuals, self.item, self.seed = residuals, item, seed
        self.context = residuals.sparkSession.sparkContext

    def shuffled(self, *salt: int | str) -> Column:
        """A repeatable random key of every id."""
        return F.md5(F.concat_ws("|", F.lit(self.seed), *[F.lit(s) for s in salt], F.col(self.item).cast("string")))

    def pick(self, n: int, *salt: int) -> np.ndarray:
        """``n`` points in a repeatable random order of the ids (a distributed top-n)."""
        order = self.shuffled(*salt).alias("_order")
        # ids first: only the chosen vectors reach the driver, not n of every task
        chosen = self.residuals.select(self.item, order).orderBy("_order", self.item).limit(n)
        rows = self.residuals.select(self.item, "residual").join(F.broadcast(chosen), self.item).collect()
        rows.sort(key=lambda r: (r["_order"], r[self.item]))
        return np.asarray([r["residual"] for r in rows], dtype=np.float64)

    def sums(self, centroids: np.ndarray,
             part: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Sum and number of points per nearest centroid, and the total cost."""
        shared = self.context.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = shared.value
            total, count = np.zeros_like(book), np.zeros(len(book), dtype=np.int64)
            cost = np.zeros(len(book))
            for batch in batches:
                points = _matrix(batch.column(0))
                for start in range(0, len(points), ROWS_PER_CHUNK):
                    chunk = points[start:start + ROWS_PER_CHUNK]
                    code, distance = nearest(chunk, book)
                    sum_by_code(chunk, code, total)
                    count += np.bincount(code, minlength=len(book))
                    cost += np.bincount(code, weights=distance, minlength=len(book))
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(count[used]),
                     pa.array(cost[used]), _list_array(total[used])],
                    names=["code", "n", "cost", "total"])

        source = self.residuals if part is None else part
        # a task sends one row per code, so few tasks move few rows
        partial = source.select("residual").coalesce(2 * self.context.defaultParallelism).mapInArrow(
            run, "code int, n long, cost double, total array<double>")
        rows = partial.select("code", "n", "cost", array_to_vector("total").alias("total")) \
            .groupBy("code").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                 vector_to_array(Summarizer.sum(F.col("total"))).alias("total")) \
            .collect()  # at most K rows
        total, count = np.zeros_like(centroids), np.zeros(len(centroids))
        for row in rows:
            total[row["code"]], count[row["code"]] = row["total"], row["n"]
        shared.unpersist()
        return total, count, float(sum(r["cost"] for r in rows))

    def update(self, centroids: np.ndarray, spare: np.ndarray,
               turn: int) -> tuple[np.ndarray, float]:
        """Means of the assigned points; an empty cluster takes a random point.

        The random points come from ``spare``, other ones in every turn.
        """
        total, count, cost = self.sums(centroids)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            at = (np.arange(len(empty)) + turn * len(empty)) % len(spare)
            total[empty], count[empty] = spare[at], 1
        return total / count[:, None], cost

    def lloyd(self, centroids: np.ndarray, spare: np.ndarray, max_iterations: int,
              tolerance: float) -> tuple[np.ndarray, dict]:
        shift = np.inf
        for iteration in range(max_iterations):
            updated, _ = self.update(centroids, spare, iteration)
            shift = float(np.linalg.norm(centroids - updated, axis=1).mean())
            centroids = updated
            if shift <= tolerance:
                break
        centroids, cost = self.update(centroids, spare, iteration + 1)
        return centroids, {"iterations": iteration + 1, "shift": shift, "cost": cost}

    def mini_batch(self, centroids: np.ndarray, epochs: int, tolerance: float, batches: int,
                   shuffle: bool) -> tuple[np.ndarray, dict]:
        """A centroid is the mean of all points that any batch so far has given it.

        The points are written once per dealing, in one folder per batch, so a
        batch reads its own points only.
        """
        given, points, moved, done, dealt = np.zeros_like(centroids), np.zeros(len(centroids)), np.inf, 0, None
        while done < epochs and moved > tolerance:
            start, done = centroids, done + 1
            if dealt is None or shuffle:
                dealt = self.dealt(batches, done - 1 if shuffle else 0)
            for batch in range(batches):
                sums, counts, _ = self.sums(centroids, dealt.filter(F.col("_batch") == batch))
                given, points = given + sums, points + counts
                known = points[:, None] > 0
                centroids = np.where(known, given / np.maximum(points, 1)[:, None], centroids)
            moved = float(np.linalg.norm(centroids - start, axis=1).mean())
        return centroids, {"iterations": done, "shift": moved}

    def dealt(self, batches: int, salt: int) -> DataFrame:
        """The residuals with their batch, a hash of the id, stored by batch."""
        number = F.conv(F.substring(self.shuffled(salt, "batch"), 1, 15), 16, 10).cast("long")
        batch = F.pmod(number, F.lit(batches)).cast("int")
        return cut_lineage(self.residuals.withColumn("_batch", batch), partition_by=["_batch"])


def _check(num_layers: int, codebook_size: int | Sequence[int], max_iterations: int,
           tolerance: float) -> list[int]:
    sizes = [codebook_size] * num_layers if isinstance(codebook_size, int) else list(codebook_size)
    if num_layers <= 0 or len(sizes) != num_layers or min(sizes) <= 0:
        raise ValueError("one positive codebook size per layer is needed")
    if max_iterations <= 0 or tolerance <= 0:
        raise ValueError("max_iterations and tolerance must be positive")
    return sizes


def fit(table: DataFrame, *, num_layers: int, codebook_size: int | Sequence[int],
        max_iterations: int = 25, tolerance: float = 1e-4, normalize: bool = True, seed: int = 0,
        item: str = "item_id", mini_batches: int | None = None, mini_batch_epochs: int | None = None,
        shuffle_mini_batches: bool = True,
        store: Callable[[DataFrame], DataFrame] = cut_lineage) -> ResidualQuantizer:
    """Fit the codebooks layer by layer.

    The residuals of a layer are written once (``store``, by default a
    checkpoint in the shared folder) and read by every iteration of the
    layer, so the plan does not grow and a lost executor costs one re-read.
    """
    sizes = _check(num_layers, codebook_size, max_iterations, tolerance)
    vector = F.col("embedding").cast(vectors.DOUBLES)
    if normalize:
        vector = vectors.l2_normalize(vector, EPS)
    residuals = store(table.select(item, vector.alias("residual")))
    result = ResidualQuantizer([], normalize)
    for layer, size in enumerate(sizes):
        passes = _Layer(residuals, item, seed)
        points = passes.pick(2 * size, layer)
        if len(points) < size:
            raise ValueError("a codebook is larger than the number of vectors")
        centroids, spare = points[:size], points[size:] if len(points) > size else points
        if mini_batches:
            centroids, stats = passes.mini_batch(
                centroids, mini_batch_epochs or max_iterations, tolerance, mini_batches,
                shuffle_mini_batches)
        else:
            centroids, stats = passes.lloyd(centroids, spare, max_iterations, tolerance)
        result.codebooks.append(centroids)
        result.layers.append(stats)
        if layer + 1 < len(sizes):
            residuals = store(next_residuals(residuals, centroids, normalize, item))
    return result


def next_residuals(residuals: DataFrame, centroids: np.ndarray, normalize: bool,
                   item: str) -> DataFrame:
    """Subtract the nearest centroid of every point and normalise again."""
    shared = residuals.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column(1))
                rest = points - shared.value[nearest(points, shared.value)[0]]
                rest = unit_rows(rest) if normalize else rest
                yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(rest)],
                                                 names=[item, "residual"])

    kind = residuals.schema[item].dataType.simpleString()
    return residuals.mapInArrow(run, f"{item} {kind}, residual array<double>")
