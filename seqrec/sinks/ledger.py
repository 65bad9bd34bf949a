"""Vectors of many items, made in chunks that survive an interruption.

The plan deals the items to chunks of a fixed number of rows, once; items that
come later continue it with chunks of their own. Chunks are embedded in waves,
and each wave is published as a whole with the rows of its chunks
(``published``), in their order. What is pending is dealt to the waves once, so
a wave reads its own items only, and waves too small to keep the cores busy are
made several at a time. A run that is interrupted loses the waves it was in:
what they wrote is never read, their chunks are made again, and finished ones
are neither read nor embedded again. When every planned chunk is finished the run
says so in a last entry, with the chunks and rows it vouches for.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqrec.operators import skew
from seqrec.session import cut_lineage
from seqrec.sinks import published

ROWS_PER_CHUNK = 500_000
CHUNKS_PER_WAVE = 64


@dataclass(frozen=True)
class State:
    """What a folder of vectors holds."""

    planned_chunks: int
    planned_rows: int
    finished_chunks: int
    finished_rows: int
    complete: bool


class ChunkLedger:
    """The plan and the finished chunks under ``root``."""

    def __init__(self, spark: SparkSession, root: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> None:
        if rows_per_chunk <= 0:
            raise ValueError("a chunk must hold at least one row")
        self.spark, self.root, self.rows_per_chunk = spark, root, rows_per_chunk
        self._read: dict[str, dict[int, published.Manifest]] = {"plan": {}, "chunks": {}}

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _entries(self, name: str) -> dict[int, published.Manifest]:
        """The published numbers of a folder; each manifest is read once."""
        self._read[name] = published.manifests(self.spark, self._folder(name), self._read[name])
        return self._read[name]

    def plan(self) -> DataFrame | None:
        """``item_id, chunk`` of all planned items."""
        parts = [m.read(self.spark, self._folder("plan")) for m in self._entries("plan").values()]
        return _union(parts)

    def extend(self, items: DataFrame) -> None:
        """Plan the items that are not planned yet, in the order of their ids."""
        entries = self._entries("plan")
        planned, first = self.plan(), sum(m.notes["chunks"] for m in entries.values())
        new = items.filter(F.col("item_id").isNotNull()).select("item_id").distinct()
        if planned is not None:
            new = new.join(planned.select("item_id"), "item_id", "left_anti")
        numbered = cut_lineage(skew.number_rows(new, [], ["item_id"], "_nth"))
        rows = numbered.count()
        if rows:
            chunk = (F.floor(F.col("_nth") / self.rows_per_chunk) + first).cast("int")
            # a second planner of the same number fails and plans again on what the first one planned
            published.publish(numbered.select("item_id", chunk.alias("chunk")), self._folder("plan"), len(entries),
                              notes={"chunks": -(-rows // self.rows_per_chunk), "rows": rows})

    def _waves(self) -> list[published.Manifest]:
        return [m for m in self._entries("chunks").values() if "chunks" in m.notes]

    def finished(self) -> dict[int, int]:
        """Finished chunks and the rows written for each; the first wave that finished a chunk counts."""
        out: dict[int, int] = {}
        for wave in self._waves():
            for chunk, rows in wave.notes["chunks"].items():
                out.setdefault(int(chunk), rows)
        return out

    def state(self) -> State:
        entries = self._entries("plan").values()
        chunks, rows, done = sum(m.notes["chunks"] for m in entries), sum(m.notes["rows"] for m in entries), self.finished()
        marks = [m.notes["complete"] for m in self._entries("chunks").values() if "complete" in m.notes]
        vouched = bool(marks) and marks[-1] == {"chunks": chunks, "rows": sum(done.values())}
        return State(chunks, rows, len(done), sum(done.values()), vouched and len(done) == chunks)

    def run(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], *, chunks_per_wave: int = CHUNKS_PER_WAVE,
            most_waves: int | None = None) -> State:
        """Embed what is not finished: ``texts`` (item_id, ...) to ``item_id, embedding``.

        Items the encoder leaves out (blank texts) are finished without a row.
        ``most_waves`` ends the run early, as an interruption would.
        """
        self.extend(texts)
        state, done = self.state(), self.finished()
        pending = [c for c in range(state.planned_chunks) if c not in done]
        waves = [pending[at:at + chunks_per_wave] for at in range(0, len(pending), chunks_per_wave)][:most_waves]
        number = max(self._entries("chunks"), default=-1) + 1
        for chosen, written, rows in self._made(texts, embed, waves):
            notes = {"chunks": {str(c): rows.get(c, 0) for c in chosen}}
            number = published.claim(self.spark, written, number, exactly=False, notes=notes).number + 1
        if most_waves is not None and sum(len(w) for w in waves) < len(pending):
            return self.state()
        if state.planned_chunks and not self.state().complete:
            done = self.finished()
            nothing = self.spark.createDataFrame([], "item_id string")
            published.publish(nothing, self._folder("chunks"), notes={"complete": {"chunks": len(done), "rows": sum(done.values())}})
        return self.state()

    def _made(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame],
              waves: list[list[int]]) -> Iterator[tuple[list[int], published.Written, dict[int, int]]]:
        """Each wave's chunks, what was written for them and the rows per chunk, in order, none of them published."""
        if not waves:
            return
        rows = max(len(w) for w in waves) * self.rows_per_chunk
        # small waves: one per core, but no more than a chunk of the usual size together
        together = max(1, min(self.spark.sparkContext.defaultParallelism, ROWS_PER_CHUNK // rows))
        dealt = self._dealt(texts, waves, -(-rows // ROWS_PER_CHUNK))
        under_way: deque[tuple[list[int], Future]] = deque()
        with ThreadPoolExecutor(together) as pool:
            try:
                for nth, chosen in enumerate(waves):
                    if len(under_way) == 2 * together:
                        yield _ended(*under_way.popleft())
                    own = dealt.filter(F.col("_wave") == nth).drop("_wave")
                    mine = own.select("item_id", F.col("_chunk").alias("chunk")).distinct()
                    made = embed(own.drop("_chunk")).join(mine, "item_id").select("item_id", "embedding", "chunk")
                    under_way.append((chosen, pool.submit(inheritable_thread_target(self.spark)(self._written), made)))
                while under_way:
                    yield _ended(*under_way.popleft())
            finally:
                for _, future in under_way:
                    future.cancel()

    def _dealt(self, texts: DataFrame, waves: list[list[int]], parts: int) -> DataFrame:
        """The pending items with ``_chunk`` and ``_wave``, written once in a folder per wave, in ``parts`` files each."""
        # one row per pending chunk
        named = F.broadcast(self.spark.createDataFrame([(c, nth) for nth, wave in enumerate(waves) for c in wave], "_chunk int, _wave int"))
        plan = self.plan().withColumnRenamed("chunk", "_chunk").join(named, "_chunk")
        return cut_lineage(texts.drop("chunk").join(plan, "item_id").repartition("_wave", F.pmod("_chunk", F.lit(parts))), ["_wave"])

    def _written(self, made: DataFrame) -> tuple[published.Written, dict[int, int]]:
        """One wave's rows in a folder of their own, and how many each chunk has."""
        counted: dict[int, int] = {}

        def count(written: DataFrame) -> None:
            found = written.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item_id").alias("ids")).collect()
            if any(r["rows"] != r["ids"] for r in found):
                raise ValueError("the encoder returned an item more than once")
            counted.update({r["chunk"]: r["rows"] for r in found})

        return published.write(made, self._folder("chunks"), check=count), counted

    def read(self) -> DataFrame:
        """``item_id, embedding`` of the finished chunks, each from the wave that finished it first."""
        taken: set[int] = set()
        whole: dict[str, list[str]] = {}
        parts = []
        for wave in self._waves():
            held = {int(c) for c in wave.notes["chunks"]}
            if not held & taken:
                whole.setdefault(wave.schema, []).append(f"{self._folder('chunks')}/{wave.folder}")
            elif held - taken:
                parts.append(wave.read(self.spark, self._folder("chunks")).filter(F.col("chunk").isin(sorted(held - taken))))
            taken |= held
        # waves that share no chunk are read together
        parts += [self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*folders) for schema, folders in whole.items()]
        found = _union(parts)
        if found is None:
            raise FileNotFoundError(f"no finished chunk under {self.root}")
        return found.select("item_id", "embedding")


def _ended(chosen: list[int], future: Future) -> tuple[list[int], published.Written, dict[int, int]]:
    return chosen, *future.result()


def _union(parts: list[DataFrame]) -> DataFrame | None:
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
