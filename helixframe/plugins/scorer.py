"""The plug point for sequence models: score distinct windows, in batches, once each.

A scorer is made once for each Python worker and sees batches of sequences. The one that
ships here is a deterministic stand-in without any biology; it serves tests and examples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.joins import scored_once


class SequenceScorer(Protocol):
    def score(self, sequences: list[str]) -> list[tuple[float, np.ndarray]]:
        """(mean log probability, embedding) of each sequence."""


class StandInScorer:
    """Not a model: numbers that depend on the sequence's k-mers alone."""

    def __init__(self, dimension: int = 8, k: int = 4):
        self.dimension, self.k = dimension, k

    def score(self, sequences: list[str]) -> list[tuple[float, np.ndarray]]:
        out = []
        for s in sequences:
            v = np.zeros(self.dimension)
            for i in range(max(0, len(s) - self.k + 1)):
                h = hashlib.blake2b(s[i : i + self.k].encode(), digest_size=8).digest()
                v[h[0] % self.dimension] += (h[1] - 127.5) / 127.5
            out.append((float(-np.log1p(np.abs(v)).mean()), v.astype(np.float32)))
        return out


def scored_windows(df: DataFrame, sequence: str, make: Callable[[], SequenceScorer] = StandInScorer, batch: int = 64) -> DataFrame:
    """``df`` with score and embedding of ``sequence``; a sequence that several rows share is scored once."""

    def score(distinct: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = make()
            for frame in frames:
                for a in range(0, len(frame), batch):
                    some = frame[sequence].iloc[a : a + batch].tolist()
                    found = scorer.score(some)
                    yield pd.DataFrame({sequence: some, "score": [x for x, _ in found], "embedding": [v for _, v in found]})

        return distinct.filter(F.col(sequence).isNotNull()).mapInPandas(run, f"{sequence} string, score double, embedding array<float>")

    return scored_once(df, [sequence], score)


def allele_effects(variants: DataFrame, ref_window: str, alt_window: str, key: list[str], make: Callable[[], SequenceScorer] = StandInScorer) -> DataFrame:
    """(key, ref_score, alt_score, delta_score, ref_embedding, alt_embedding): REF windows shared by several ALTs are scored once."""
    long = variants.select(*key, F.explode(F.array(F.struct(F.lit("ref").alias("allele"), F.col(ref_window).alias("seq")), F.struct(F.lit("alt").alias("allele"), F.col(alt_window).alias("seq")))).alias("w")).select(*key, "w.allele", "w.seq")
    s = scored_windows(long, "seq", make)
    pick = lambda a, c: F.max_by(c, F.when(F.col("allele") == a, 1))
    out = s.groupBy(*key).agg(pick("ref", "score").alias("ref_score"), pick("alt", "score").alias("alt_score"), pick("ref", "embedding").alias("ref_embedding"), pick("alt", "embedding").alias("alt_embedding"))
    return out.withColumn("delta_score", F.col("alt_score") - F.col("ref_score"))
