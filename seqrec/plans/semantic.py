"""Item text to vectors, quantizer and semantic ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.operators import quantizer, semantic_ids
from seqrec.session import cut_lineage


@dataclass
class SemanticIds:
    model: quantizer.ResidualQuantizer
    codes: DataFrame


Texts = DataFrame | Sequence[tuple[DataFrame, str | None]]


def run(texts: Texts, encoder: Callable[[DataFrame], DataFrame], *, num_layers: int,
        codebook_size: int | Sequence[int], cardinality: int | None = 256,
        store: Callable[[DataFrame], DataFrame] = cut_lineage, **fit_options) -> SemanticIds:
    """Embed (item_id, text), fit the quantizer, and assign codes with slots.

    ``texts`` is one table or several with a prefix for their ids. ``encoder``
    maps texts to (item_id, embedding); ``store`` keeps the vectors, which both
    later steps read. All rows of all sources are fitted; codes go to the first
    occurrence of an id.
    """
    named = [(texts, None)] if isinstance(texts, DataFrame) else list(texts)
    sources = [(store(encoder(t)).withColumn("ord", F.col("item_id")), prefix) for t, prefix in named]
    every = store(semantic_ids.combine_sources(sources, first_wins=False))
    model = quantizer.fit(every.select("item_id", "embedding"), num_layers=num_layers, codebook_size=codebook_size,
                          **fit_options)
    return SemanticIds(model, infer(model, sources, cardinality=cardinality))


def infer(model: quantizer.ResidualQuantizer, sources: Sequence[tuple[DataFrame, str | None]], *,
          cardinality: int | None = 256) -> DataFrame:
    """Codes and slots of several sources; the first occurrence of an id wins."""
    table = semantic_ids.combine_sources(sources)
    coded = model.quantize(table).join(table.select("item_id", "source", "ord"), "item_id")
    return semantic_ids.dedup_slots(coded, ["source", "ord", "item_id"], cardinality=cardinality)
