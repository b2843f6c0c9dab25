"""Token ids of texts, and the exact length histogram that answers questions about context limits.

Encoding follows the tokenizer file exactly. Its pre-tokenizer cuts at white space and
never merges across it, so a text's ids are the ids of its words end to end. A chunk's
words are split and numbered by Arrow; each distinct word is encoded once. A word of
letters, with or without closing marks, is the ids of the lower-cased letters and of
the marks: such parts go to the tokenizer many at a time and are remembered, as Arrow
and numpy arrays, up to a bound. Any other word goes to the tokenizer as it is.

Null and empty texts have no tokens of their own. Other columns are ignored. An empty
table gives an empty histogram.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.batches import text_chunks, texts_of
from helixframe.llm.storage import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: About how many bytes of text are encoded at a time.
ENCODED_BYTES = 4_000_000
#: Letters whose normal form and case do not depend on their surroundings, then marks.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-įı-ž]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """One tokenizer for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    ends = np.zeros(found.get_vocab_size(), bool)
    for token, i in found.get_vocab().items():
        ends[i] = token.endswith("</w>")
    return found, ends


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... ``count[i]`` of them, for each i in turn."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Pieces:
    """Ids of strings, laid end to end: string i has ``ids[start[i] : start[i] + count[i]]``."""

    def __init__(self, ids: np.ndarray, count: np.ndarray):
        self.ids, self.count = ids, count
        self.start = np.cumsum(count) - count

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.ids[spread(self.start[at], self.count[at])], self.count[at])

    def join(self, other: Pieces) -> Pieces:
        return Pieces(np.concatenate((self.ids, other.ids)), np.concatenate((self.count, other.count)))


class WordEncoder:
    """Ids of texts, by words; ``most`` parts or so are remembered from chunk to chunk."""

    def __init__(self, path: str = TOKENIZER, most: int = 200_000):
        self.tokenizer, self.ends = _tokenizer(path)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known, self.parts = pa.array([""]), Pieces(np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def _each(self, words: list[str]) -> Pieces:
        """Ids of words that the tokenizer takes one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []
        return Pieces(np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found)))

    def _together(self, parts: list[str]) -> Pieces:
        """Ids of parts of words, a thousand at a time: each ends where a word of the tokenizer does."""
        ids, count = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            laid = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[laid]) + 1
            found = Pieces(laid, np.diff(stops, prepend=0)) if len(stops) == len(some) else self._each(some)
            ids.append(found.ids)
            count.append(found.count)
        return Pieces(np.concatenate(ids), np.concatenate(count))

    def _part_ids(self, parts: pa.Array) -> tuple[Pieces, np.ndarray]:
        """The ids that are known now, and where each of the distinct ``parts`` is among them."""
        if len(self.known) > self.most:
            self._forget()
        new = parts.filter(pc.invert(pc.is_in(parts, value_set=self.known)))
        if len(new):
            self.parts = self.parts.join(self._together(new.to_pylist()))
            self.known = pa.concat_arrays([self.known, new])
        return self.parts, pc.index_in(parts, value_set=self.known).to_numpy(zero_copy_only=False)

    def _word_ids(self, words: pa.Array) -> Pieces:
        """Ids of distinct words."""
        cut = pc.extract_regex(words, PLAIN)
        plain = cut.is_valid()
        odd = words.filter(pc.invert(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        stem, marks = cut.drop_null().flatten()
        both = pa.concat_arrays([pc.utf8_lower(stem), marks]).dictionary_encode()
        known, at = self._part_ids(both.dictionary)
        at = at[both.indices.to_numpy(zero_copy_only=False)]
        # a plain word is its stem's ids and its marks'; any other is its own
        pool = known.join(self._each(odd.to_pylist()))
        first, second = np.full((2, len(words)), -1, np.int64)
        first[plain], second[plain] = at[: len(stem)], at[len(stem) :]
        first[~plain] = len(known.count) + np.arange(len(odd))
        parts = np.stack((first, second), axis=1).ravel()
        there = parts >= 0
        laid = pool.take(parts[there])
        count = np.zeros(len(parts), np.int64)
        count[there] = laid.count
        return Pieces(laid.ids, count.reshape(-1, 2).sum(axis=1))

    @staticmethod
    def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, numbered, and where each text's words begin and end."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        return cut.flatten().dictionary_encode(), np.asarray(cut.offsets) - cut.offsets[0].as_py()

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        return self.lengths_of(*self.cut(texts))

    def lengths_of(self, words: pa.DictionaryArray, ends: np.ndarray) -> np.ndarray:
        """How many ids each text has that ``cut`` has cut."""
        count = self._word_ids(words.dictionary).count[words.indices.to_numpy(zero_copy_only=False)]
        return np.diff(np.concatenate(([0], np.cumsum(count)))[ends])

    def ids(self, texts: pa.Array) -> Pieces:
        """The ids of each text."""
        words, ends = self.cut(texts)
        laid = self._word_ids(words.dictionary).take(words.indices.to_numpy(zero_copy_only=False))
        return Pieces(laid.ids, np.diff(np.concatenate(([0], np.cumsum(laid.count)))[ends]))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        found = self.ids(pa.array(texts, pa.string()))
        body = found.ids.tobytes()
        return [body[4 * a : 4 * (a + n)] for a, n in zip(found.start.tolist(), found.count.tolist())]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer)  # what it remembers goes with the task
        for chunk in text_chunks(batches, most=ENCODED_BYTES):
            yield pa.record_batch([chunk.column(0), pa.array(encode.lengths(chunk.column(1)), pa.int64())], names=["doc_id", "n_tokens"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(length, n_docs): how many rows have each length."""
    return counts.groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 256) -> DataFrame:
    """What every context limit asks, one row for each length of the histogram.

    For limit = length: ``docs_at_least`` and ``tokens_at_least`` over documents of this
    length or more, ``docs_over`` over longer ones, ``truncated_tokens`` the total when
    each document is cut to the limit, ``quantile`` the share of documents no longer.
    Sums run within blocks of ``block`` lengths; blocks add the totals of later blocks,
    so no window spans the whole histogram.
    """
    histogram = written(histogram, "histogram")  # a row for each length; read more than once below
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / block).alias("block"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for each ``block`` lengths: a few thousand even for texts of a million tokens
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = totals.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"))
    whole = totals.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    at = h.join(after, "block").select(
        "length", "n_docs", "tokens",
        (F.sum("n_docs").over(inside) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("t_after")).alias("tokens_at_least"),
    )
    over = F.col("docs_at_least") - F.col("n_docs")
    return at.join(F.broadcast(whole)).select(
        "length", "n_docs", "tokens", "docs_at_least", "tokens_at_least", over.alias("docs_over"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("tokens") + over * F.col("length")).alias("truncated_tokens"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
    )


def context_totals(answers: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens) for any limits, from ``suffix_sums`` rows.

    A limit between two lengths takes the next longer one's suffix sums.
    """
    spark = answers.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    longer = answers.join(F.broadcast(asked), F.col("length") > F.col("context_limit"), "right").groupBy("context_limit").agg(
        F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("docs_over"), F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("tokens_over")
    )
    whole = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    return longer.join(F.broadcast(whole)).select("context_limit", "docs_over", (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")).alias("truncated_tokens"))
