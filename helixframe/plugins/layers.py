"""Vectors of inner layers as a nested stream: (layer, block of positions, vectors) of one sequence after the other.

A scorer hands over its layers block by block. ``layer_blocks`` makes a row of each block;
``pooled_layers`` keeps no block: a task holds one block and, for one sequence, a sum for
each layer and region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LayerScorer(Protocol):
    def layers(self, sequence: str) -> Iterator[tuple[str, int, np.ndarray]]:
        """(layer, first position, vectors by position) of a sequence; blocks may come in any order and cover a position once."""


def _typed(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def layer_blocks(df: DataFrame, keys: list[str], sequence: str, make: Callable[[], LayerScorer]) -> DataFrame:
    """(keys, layer, start, vectors): one row for each block of each layer; null sequences have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                for layer, start, vectors in scorer.layers(row[-1]):
                    yield pd.DataFrame([(*row[:-1], layer, start, [v.tolist() for v in vectors])], columns=[*keys, "layer", "start", "vectors"])

    return df.filter(F.col(sequence).isNotNull()).select(*keys, sequence).mapInPandas(run, f"{_typed(df, keys)}, layer string, start long, vectors array<array<double>>")


def pooled_layers(df: DataFrame, keys: list[str], sequence: str, regions: str, make: Callable[[], LayerScorer], rows: int = 512) -> DataFrame:
    """(keys, layer, region, mean): the mean vector of each half-open region of each layer.

    ``regions`` is an array of (region, start, end). A region that is empty or that the
    layer's blocks don't cover whole has a null mean; a layer without any block has no rows.
    """
    columns = [*keys, "layer", "region", "mean"]

    def pooled(scorer: LayerScorer, text: str, asked: list) -> Iterator[tuple]:
        sums: dict[str, list] = {}
        for layer, start, vectors in scorer.layers(text):
            held = sums.setdefault(layer, [[0, 0.0] for _ in asked])
            for (_, first, end), one in zip(asked, held):
                a, b = max(first - start, 0), min(end - start, len(vectors))
                if a < b:
                    one[0] += b - a
                    one[1] = one[1] + vectors[a:b].sum(axis=0, dtype=float)
        for layer, held in sums.items():
            for (name, first, end), (n, total) in zip(asked, held):
                yield layer, name, (total / n).tolist() if n and n == end - first else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, out = make(), []
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                asked = [(r["region"], r["start"], r["end"]) for r in row[-1]]
                out += [(*row[:-2], *x) for x in pooled(scorer, row[-2], asked)]
                if len(out) >= rows:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    there = df.filter(F.col(sequence).isNotNull() & F.col(regions).isNotNull())
    return there.select(*keys, sequence, regions).mapInPandas(run, f"{_typed(df, keys)}, layer string, region string, mean array<double>")
