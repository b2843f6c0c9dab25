"""Language identification as mixture inference.

Training counts hashed letter n-grams of labelled texts by language; the counts are a
table of languages x buckets, whatever the corpus. A text's language proportions are
found by expectation-maximisation over its n-grams' likelihoods. Which languages the
text holds is chosen by penalised likelihood: starting from all, the language whose
removal costs least leaves as long as the penalised score does not fall. ``mixtures``
returns the whole set with its proportions; the label is the language of the largest
proportion, the score that proportion.

Training may use a bounded sample: for each language at most about ``max_docs`` texts,
taken by a hash of the id, so the rate falls as the corpus grows and the model's cost
stays fixed. Everything is predicted from whole texts.

Null texts and texts without a letter are ``und`` with score 0. Without labelled texts
every text is ``und``. Ties go to the language that comes first in the alphabet. Rows
with a null doc_id are predicted and never trained on. Repeated rows give repeated
results. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.batches import text_chunks, texts_of

BUCKETS, ORDERS, MAX_DOCS = 1 << 14, (1, 2, 3), 20_000
#: Languages that a model can hold: 128 kB of likelihoods each.
MOST_LANGS = 500
UNKNOWN = "und"


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; anything that isn't a letter is a single blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    table = _letter_table()
    return table[np.minimum(code, len(table) - 1)]


_TABLE: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0; made once for each Python worker."""
    if not _TABLE:
        _TABLE.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x32000)] + [0], np.uint32))
    return _TABLE[0]


def ngram_buckets(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the hashed n-grams of a text that hold a letter; none if it has no letter."""
    c = _letters(text)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = np.concatenate(([0], c[keep], [0])).astype(np.uint64)
    if not c.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for n in orders:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        if n == 1:
            h = h[c != 0]
        found.append((h >> np.uint64(20)) % np.uint64(buckets))
    all_ = np.concatenate(found).astype(np.int64)
    count = np.bincount(all_, minlength=buckets)
    at = np.flatnonzero(count)
    return at, count[at]


class Model:
    """log p(bucket | language) of every language."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        p = counts + smooth
        self.p = (p / p.sum(axis=1, keepdims=True)).astype(np.float64)

    def predict(self, text: str | None, rounds: int = 25) -> tuple[str, float]:
        """The language of the largest proportion, and that proportion."""
        found = self.mixture(text, rounds)
        return max(found, key=lambda x: x[1]) if found else (UNKNOWN, 0.0)

    def mixture(self, text: str | None, rounds: int = 25) -> list[tuple[str, float]]:
        """The chosen languages in alphabetical order, with their proportions; none for a text without a letter."""
        if not text or not self.langs:
            return []
        at, n = ngram_buckets(text, self.p.shape[1])
        if not len(at):
            return []
        like = self.p[:, at]
        # n-grams of several orders tell the same letters again
        n = n / len(ORDERS)
        chosen = list(range(len(self.langs)))
        share, score = self._fit(like, n, chosen, rounds)
        penalty = 0.5 * np.log(max(2.0, n.sum()))
        while len(chosen) > 1:
            # the language that explains least goes first
            out = chosen[len(share) - 1 - int(np.argmin(share[::-1]))]
            rest = [k for k in chosen if k != out]
            less_share, less = self._fit(like, n, rest, rounds)
            if less + penalty < score:
                break
            chosen, share, score = rest, less_share, less
        return [(self.langs[k], float(min(1.0, max(0.0, s)))) for k, s in zip(chosen, share)]

    @staticmethod
    def _fit(like: np.ndarray, n: np.ndarray, chosen: list[int], rounds: int) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log likelihood."""
        p = like[chosen]
        share, total = np.full(len(chosen), 1 / len(chosen)), n.sum()
        if len(chosen) == 1:
            return share, float(n @ np.log(p[0]))
        for _ in range(rounds):
            mix = share @ p
            new = share * (p @ (n / mix)) / total
            if np.abs(new - share).max() < 1e-4:
                share = new
                break
            share = new
        return share, float(n @ np.log(share @ p))


def train(labelled: DataFrame, buckets: int = BUCKETS, max_docs: int = MAX_DOCS, most_langs: int = MOST_LANGS) -> Model:
    """A model from ``labelled`` (doc_id, text, lang), from at most about ``max_docs`` texts of each language.

    Raises if there are more than ``most_langs`` languages, since the model travels to every task.
    """
    known = texts_of(labelled).filter("doc_id is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}  # a row for each language
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not sizes:
        return Model([], np.zeros((0, buckets)))
    langs = sorted(sizes)
    rate = F.lit(None).cast("double")
    for k in langs:
        rate = F.when(F.col("lang") == k, min(1.0, max_docs / sizes[k])).otherwise(rate)
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(u < rate).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(langs), buckets), np.int64)
        row = {k: i for i, k in enumerate(langs)}
        for chunk in text_chunks(batches):
            for text, lang in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                if text:
                    at, n = ngram_buckets(text, buckets)
                    count[row[lang], at] += n
        lang, at = np.nonzero(count)
        yield pa.record_batch([pa.array(lang), pa.array(at), pa.array(count[lang, at])], names=["lang", "bucket", "n"])

    summed = sample.mapInArrow(run, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets
    counts = np.zeros((len(langs), buckets))
    counts[summed["lang"], summed["bucket"]] = summed["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in text_chunks(batches):
            found = [m.predict(t) for t in chunk.column(1).to_pylist()]
            yield pa.record_batch([chunk.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def mixtures(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, languages) for each row of ``docs``: the chosen languages, most first, as structs of lang and share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in text_chunks(batches):
            found = [[{"lang": k, "share": s} for k, s in sorted(m.mixture(t), key=lambda x: (-x[1], x[0]))] for t in chunk.column(1).to_pylist()]
            yield pa.record_batch([chunk.column(0), pa.array(found, kind)], names=["doc_id", "languages"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, languages array<struct<lang:string,share:double>>")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
