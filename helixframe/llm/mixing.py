"""Mixing sources to target weights by iterative proportional fitting.

Documents carry their token counts in cells of (source, language, topic). Raking scales
the cells until the token totals of each source, language and topic match their targets
at the wanted size. A cell's factor is the probability by which each of its documents is
sampled; a hash of the id decides, so a rerun or a lost executor changes nothing.

Tokens are those of the tokenizer. The table has no topics: unless the caller names a
column of them, a text's topic is the cluster of its long words, one of eight by the
signs of three random projections of how often it has each.

No factor exceeds one: cells that reach it are held there while the others are fitted.
A value whose target is more than all its tokens keeps them all, and the other values of
its margin share the rest in proportion. Values that explicit targets leave out share
what the targets leave, or their own share of all tokens where that is nothing; no value
is dropped because it isn't listed. Targets that no factors can meet together are missed
by what is left; ``margins`` tells what is reached.

Every source and language has cells of its own. Up to ``SMALL`` cells are fitted from
arrays in the driver; more are fitted as a table, by sums and joins on Spark.

Null sources and languages are a value of their own. Null and empty texts have no
tokens: they weigh nothing and take their cell's probability. Repeated rows of one
doc_id are sampled together. Rows with a null doc_id are sampled by their text's hash.
An empty table gives an empty result. Columns of the input keep their names; the
operator's own columns replace equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from helixframe.llm.batches import text_chunks, texts_of
from helixframe.llm.storage import Written, written
from helixframe.llm.tokens import ENCODED_BYTES, TOKENIZER, WordEncoder

MARGINS = ("source", "lang", "topic")
#: Up to so many cells are fitted in the driver and their table is broadcast.
SMALL = 100_000
#: Characters of the words that tell a topic, and projections of their counts.
LONG_WORD, PROJECTIONS = 6, 3


def topics_of(words: pa.DictionaryArray, ends: np.ndarray) -> list[str]:
    """The topic of each text that ``WordEncoder.cut`` has cut; ``none`` without a long word."""
    distinct = pc.ascii_lower(pc.ascii_trim(words.dictionary, characters=".,;:!?\"'()"))
    long_ = pc.greater_equal(pc.utf8_length(distinct), LONG_WORD).to_numpy(zero_copy_only=False)
    hashes = np.zeros(len(distinct), np.uint64)
    hashes[long_] = [xxhash.xxh64_intdigest(w, 3) for w in distinct.filter(pa.array(long_)).to_pylist()]
    at = words.indices.to_numpy(zero_copy_only=False)
    code, any_ = np.zeros(len(ends) - 1, np.int64), np.diff(np.concatenate(([0], np.cumsum(long_[at])))[ends])
    for j in range(PROJECTIONS):
        sign = np.where(long_, np.where(hashes >> np.uint64(7 + j) & np.uint64(1), 1, -1), 0)
        code |= (np.diff(np.concatenate(([0], np.cumsum(sign[at])))[ends]) > 0).astype(np.int64) << j
    return [f"t{c}" if n else "none" for c, n in zip(code.tolist(), any_.tolist())]


@dataclass(frozen=True)
class Targets:
    """Exponents that flatten the token shares of each margin, or explicit shares by value."""

    source: float | dict[str, float] = 0.7
    lang: float | dict[str, float] = 0.7
    topic: float | dict[str, float] = 0.9


def _shares(values: list[str | None], totals: np.ndarray, wanted: float | dict[str | None, float]) -> np.ndarray:
    """The wanted share of each value of a margin."""
    if isinstance(wanted, dict):
        listed = np.array([k in wanted for k in values])
        raw = np.array([wanted.get(k, 0.0) for k in values])
        given, others = raw.sum(), totals[~listed].sum()
        if others > 0:
            rest = 1 - given if 0 < given < 1 else others / totals.sum()
            raw[listed] *= (1 - rest) / given if given > 0 else 0.0
            raw[~listed] = rest * totals[~listed] / others
    else:
        raw = np.where(totals > 0, totals**wanted, 0.0)
    raw = raw if raw.any() else totals
    return raw / (raw.sum() or 1.0)


def _within(shares: np.ndarray, totals: np.ndarray, whole: float) -> np.ndarray:
    """Goals in proportion to the shares, none above its value's total, that add up to ``whole`` as far as they can."""
    full = np.zeros(len(shares), bool)
    while True:
        free = shares[~full].sum()
        goal = np.where(full, totals, shares * ((whole - totals[full].sum()) / free if free > 0 else 0.0))
        over = ~full & (goal > totals)
        if not over.any():
            return goal
        full |= over


def _fit(codes: list[np.ndarray], v: np.ndarray, goals: list[np.ndarray], most: float, rounds: int, tolerance: float) -> np.ndarray:
    """Factors of cells with totals ``v``; factors above ``most`` count as ``most``, and their cells are held while the rest is fitted."""
    whole = v.sum() or 1.0
    f = np.full(len(v), goals[0].sum() / whole)
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals):
            sums = lambda x: np.bincount(code, x, len(goal))  # noqa: B023, E731
            held = f >= most
            fixed, free = sums(np.where(held, v * most, 0.0)) if held.any() else np.zeros(len(goal)), sums(np.where(held, 0.0, v * f))
            now = fixed + free
            worst = max(worst, float(np.abs(now - goal).max()) / whole)
            by_rest = (free > 0) & (goal > fixed)
            down = ~by_rest & (now > goal)
            scale = np.ones(len(goal))
            scale[by_rest] = (goal - fixed)[by_rest] / free[by_rest]
            scale[down] = goal[down] / now[down]
            f = np.minimum(f * scale[code], 1e12)
        if worst < tolerance:
            break
    return f


def _cut(v: np.ndarray, f: np.ndarray, goal: float) -> np.ndarray:
    """Probabilities in proportion to ``f``, cut at one, under which ``goal`` of ``v`` is expected."""
    low, high = 0.0, 1.0
    total = lambda c: float((v * np.minimum(1.0, c * f)).sum())
    while total(high) < goal and high < 1e12:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < goal else (low, mid)
    return np.minimum(1.0, high * f)


def _coded(keys: list[tuple[str, str, str]]) -> list[tuple[list[str], np.ndarray]]:
    """The values of each margin, and each cell's place among them."""
    out = []
    for column in zip(*keys):
        values = sorted(set(column), key=lambda v: (v is not None, v or ""))
        place = {k: i for i, k in enumerate(values)}
        out.append((values, np.fromiter(map(place.__getitem__, column), np.int64, len(column))))
    return out


def rake(cells: dict[tuple[str, str, str], float], targets: Targets, rounds: int = 200, tolerance: float = 1e-9) -> dict[tuple[str, str, str], float]:
    """The factor of each cell after iterative proportional fitting of its token total to the margins, without a bound."""
    v, margins = np.array(list(cells.values())), _coded(list(cells))
    totals = [np.bincount(code, v) for _, code in margins]
    goals = [_shares(values, t, getattr(targets, d)) * v.sum() for d, (values, _), t in zip(MARGINS, margins, totals)]
    return dict(zip(cells, _fit([code for _, code in margins], v, goals, np.inf, rounds, tolerance).tolist()))


def probabilities(cells: dict[tuple[str, str, str], float], factor: dict[tuple[str, str, str], float], fraction: float) -> dict[tuple[str, str, str], float]:
    """Sampling probabilities in proportion to the factors, cut at one, that keep ``fraction`` of all tokens."""
    v = np.array(list(cells.values()))
    return dict(zip(cells, _cut(v, np.array([factor[k] for k in cells]), fraction * v.sum()).tolist()))


def bounded(cells: dict[tuple[str, str, str], float], targets: Targets, fraction: float, rounds: int = 1000, tolerance: float = 1e-10) -> tuple[dict[tuple[str, str, str], float], list[tuple[str, str, float, float]]]:
    """Probabilities that keep ``fraction`` of all tokens at the margins, and (margin, value, target share, reached share)."""
    if not cells:
        return {}, []
    v, margins = np.array(list(cells.values())), _coded(list(cells))
    whole = fraction * v.sum()
    totals = [np.bincount(code, v) for _, code in margins]
    shares = [_shares(values, t, getattr(targets, d)) for d, (values, _), t in zip(MARGINS, margins, totals)]
    f = _fit([code for _, code in margins], v, [_within(s, t, whole) for s, t in zip(shares, totals)], 1.0, rounds, tolerance)
    p = _cut(v, f, whole)
    kept = (v * p).sum() or 1.0
    report = [(d, k, a, b) for d, (values, code), s in zip(MARGINS, margins, shares) for k, a, b in zip(values, s.tolist(), (np.bincount(code, v * p) / kept).tolist())]
    return dict(zip(cells, p.tolist())), report


def counted(docs: DataFrame, keep: list[str], tokenizer: str = TOKENIZER, topic: str | None = None) -> DataFrame:
    """The columns ``keep`` with n_tokens, topic, and the cell's _source and _lang, and _u in [0, 1) from the id."""
    kept = [c for c in keep if c not in ("n_tokens", "topic", "probability", "sampled")]
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    own_topic = F.lit(None).cast("string") if topic is None else F.col(topic).cast("string")
    rows = texts_of(docs).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"), own_topic.alias("_topic"), u.alias("_u"), "text")
    out = StructType([*rows.drop("text", "_topic").schema.fields, StructField("n_tokens", LongType()), StructField("topic", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer)
        for chunk in text_chunks(batches, most=ENCODED_BYTES):
            words, ends = encode.cut(chunk.column("text"))
            names = chunk.column("_topic") if topic is not None else pa.array(topics_of(words, ends), pa.string())
            columns = [chunk.column(c) for c in ("kept", "_source", "_lang", "_u")]
            yield pa.record_batch([*columns, pa.array(encode.lengths_of(words, ends), pa.int64()), names], names=[f.name for f in out.fields])

    return rows.mapInArrow(run, out)


def _cell_table(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of each cell."""
    return rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic").agg(F.sum("n_tokens").cast("double").alias("tokens"))


def _raked_table(cells: DataFrame, targets: Targets, fraction: float, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(source, lang, topic, probability): ``bounded`` for cells beyond ``SMALL``, on Spark; each round is written and read again."""
    whole = fraction * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    goals = {}
    for d in MARGINS:
        total, wanted = cells.groupBy(d).agg(F.sum("tokens").alias("total")), getattr(targets, d)
        if isinstance(wanted, dict):
            # only values that are listed come to the driver; the others keep their proportions
            listed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in wanted.items()], f"{d} string, raw double")
            t = total.join(listed, total[d].eqNullSafe(listed[d]), "left").select(total[d], "total", "raw")
            s = t.agg(F.coalesce(F.sum("raw"), F.lit(0.0)).alias("given"), F.coalesce(F.sum(F.when(F.col("raw").isNull(), F.col("total"))), F.lit(0.0)).alias("others"), F.sum("total").alias("all")).first()
            rest = 0.0 if not s["others"] else 1 - s["given"] if 0 < s["given"] < 1 else s["others"] / (s["all"] or 1.0)
            raw = F.when(F.col("raw").isNull(), F.lit(rest) * F.col("total") / F.lit(s["others"] or 1.0)).otherwise(F.col("raw") * F.lit((1 - rest) / (s["given"] or 1.0)))
            t = t.select(d, "total", raw.alias("share"))
        else:
            t = total.select(d, "total", F.when(F.col("total") > 0, F.pow("total", F.lit(float(wanted)))).otherwise(0.0).alias("share"))
        # goals in proportion to the shares, none above its value's total
        table, factor = Written(t, f"goal_{d}"), None
        full = 0.0
        while True:
            over = (F.col("share") * F.lit(factor) >= F.col("total")) if factor is not None else F.lit(False)
            r = table.df.agg(F.coalesce(F.sum(F.when(over, F.col("total"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~over, F.col("share"))), F.lit(0.0)).alias("free")).first()
            new = (whole - r["full"]) / r["free"] if r["free"] > 0 else factor
            if new is None or (factor is not None and r["full"] == full):
                break
            factor, full = new, r["full"]
        goals[d] = table.df.select(d, F.least(F.col("share") * F.lit(factor or 0.0), F.col("total")).alias("goal"))
    state = Written(cells.withColumn("f", F.lit(fraction)), "raking")
    for _ in range(rounds):
        worst = 0.0
        for d in MARGINS:
            held = F.col("f") >= 1
            sums = state.df.groupBy(d).agg(F.coalesce(F.sum(F.when(held, F.col("tokens"))), F.lit(0.0)).alias("fixed"), F.coalesce(F.sum(F.when(~held, F.col("tokens") * F.col("f"))), F.lit(0.0)).alias("free"))
            s = sums.join(goals[d], sums[d].eqNullSafe(goals[d][d])).select(sums[d].alias("_key"), "fixed", "free", "goal")
            now = F.col("fixed") + F.col("free")
            scale = F.when((F.col("free") > 0) & (F.col("goal") > F.col("fixed")), (F.col("goal") - F.col("fixed")) / F.col("free")).when(now > F.col("goal"), F.col("goal") / now).otherwise(1.0)
            scaled = s.select("_key", scale.alias("scale"), (F.abs(now - F.col("goal")) / F.lit(whole or 1.0)).alias("off"))
            new = Written(state.df.drop("off").join(scaled, F.col(d).eqNullSafe(F.col("_key"))).select(*MARGINS, "tokens", F.least(F.col("f") * F.col("scale"), F.lit(1e12)).alias("f"), "off"), "raking")
            worst = max(worst, new.df.agg(F.max("off")).first()[0] or 0.0)
            state.drop()
            state = new
        if worst < tolerance:
            break
    return state.df.select(*MARGINS, F.least(F.col("f"), F.lit(1.0)).alias("probability"))


def _driver_cells(cells: DataFrame) -> dict[tuple[str | None, str | None, str | None], float]:
    found = cells.toArrow().to_pydict()
    return dict(zip(zip(found["source"], found["lang"], found["topic"]), found["tokens"]))


def margins(docs: DataFrame, targets: Targets = Targets(), fraction: float = 0.8, topic: str | None = None) -> DataFrame:
    """(margin, value, target, reached): the share of tokens that each source, language and topic should have and is expected to have.

    For up to ``SMALL`` cells; raises beyond.
    """
    cells = written(_cell_table(counted(docs, ["doc_id"], topic=topic)), "cells")
    if cells.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"more than {SMALL} cells")
    return docs.sparkSession.createDataFrame(bounded(_driver_cells(cells), targets, fraction)[1], "margin string, value string, target double, reached double")


def with_probabilities(docs: DataFrame, targets: Targets = Targets(), fraction: float = 0.8, keep: list[str] | None = None, topic: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, topic, probability and sampled.

    ``fraction`` of all tokens is what the sample is expected to hold. ``keep`` names the
    columns to return. Texts are read once: what was counted is written beside them.
    """
    rows = written(counted(docs, list(docs.columns if keep is None else keep), topic=topic), "counted")
    cells = written(_cell_table(rows), "cells")
    if small := cells.limit(SMALL + 1).count() <= SMALL:
        p, _ = bounded(_driver_cells(cells), targets, fraction)
        table = docs.sparkSession.createDataFrame([(*k, v) for k, v in p.items()], "source string, lang string, topic string, probability double")
    else:
        table = _raked_table(cells, targets, fraction)
    t = table.select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"), "probability")
    same = F.col("_source").eqNullSafe(F.col("s")) & F.col("_lang").eqNullSafe(F.col("l")) & rows["topic"].eqNullSafe(F.col("t"))
    joined = rows.join(F.broadcast(t) if small else t, same, "left")
    return joined.withColumn("sampled", F.col("_u") < F.col("probability")).select("kept.*", "n_tokens", "topic", "probability", "sampled")


def sample(docs: DataFrame, targets: Targets = Targets(), fraction: float = 0.8, topic: str | None = None) -> DataFrame:
    """The sampled rows of ``docs``, with its own columns."""
    whole = docs.select("doc_id", "text", "source", "lang", *([topic] if topic else []), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    return with_probabilities(whole, targets, fraction, keep=["_all"], topic=topic).filter("sampled").select("_all.*")
