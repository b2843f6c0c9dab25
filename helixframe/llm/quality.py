"""Quality rules as learned decision lists, in DataFrame functions only.

Features of each document are counted row by row. Sequential covering learns an ordered
list of rules from labelled rows: a rule for rejection is a conjunction of thresholds,
grown condition by condition by information gain over counts that Spark aggregates, then
pruned on held-back rows; rows that it covers leave, and the next rule is learned from
the rest. Only counts by (feature, threshold) reach the driver. The list is emitted as an
ordered conditional expression.

Null and empty texts have no words: every count is 0 and the base rule rejects them.
Labels that are null or for unknown documents are ignored; a document labelled more than
once counts once for each label. Without labels, or where no rule is precise enough, the
list is empty and keeps what the base rule keeps. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.storage import written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK, -1), lambda w: w != "")


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """How many words lie in ``window``-word sequences that the text holds at least twice.

    Words are hashed once each, sequences from their words' hashes. Only a text with a
    repeated sequence has its positions sorted: equal sequences are then neighbours, and
    the covered words follow from the gaps between positions.
    """
    starts = F.sequence(F.lit(1), F.size(words) - window + 1)
    # bound as a lambda variable, so that the words' hashes are made once
    hashes = F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda each: F.transform(starts, lambda i: F.xxhash64(F.slice(each, i, window)))), F.lit(0))

    def covered(h: Column) -> Column:
        placed = F.array(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
        twice = F.transform(placed, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, j: F.coalesce(x["h"] == F.get(p, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, j + 1)["h"], F.lit(False))), lambda x: x["i"])))
        return F.get(F.transform(twice, lambda q: F.aggregate(F.transform(q, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(q, k + 1) - at, F.lit(window)))), F.lit(0), lambda u, x: u + x)), F.lit(0))

    # bound once as a lambda variable, so that the hashes are made once
    found = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > window, F.get(found, F.lit(0))).otherwise(F.lit(0)).cast("long")


def features(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """doc_id with the base counts and the shares that rules can test; one row for each row of ``docs``.

    ``carried`` is a column to keep beside them, as ``carried``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    extra = [] if carried is None else ["carried"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([] if carried is None else [carried.alias("carried")]))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    counted = rows.select("doc_id", *extra, "text", words_of(F.col("text")).alias("words"), lines.alias("lines")).select(
        "doc_id", *extra,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        without(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[A-Z]+").alias("n_upper"), without("[!?]").alias("n_marks"), without("[0-9]+").alias("n_digits"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        "*",
        per("n_symbols", "n_words").alias("symbols_per_word"), per("word_chars", "n_words").alias("chars_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_upper", "word_chars").alias("upper_share"), per("n_marks", "n_words").alias("marks_per_word"),
        per("n_digits", "word_chars").alias("digit_share"), per("n_words", "n_lines").alias("words_per_line"),
    )


#: What rules may test.
TESTED = ("n_words", "symbols_per_word", "chars_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word", "digit_share", "words_per_line")


def base_failed() -> Column:
    """Too short, or more than 30 % of its words in repeated sequences."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature >= threshold, or feature < threshold."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, otherwise a document is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def keeps(self) -> Column:
        out = None
        for rule in self.rules:
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column()
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "keep"])


def _sides(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """(rejected, kept) labels on the covered side of every threshold, from one aggregation over (feature, bin)."""
    below = lambda f, ts: F.size(F.filter(F.lit(ts), lambda t: t <= F.col(f)))
    bins = [F.struct(F.lit(f).alias("feature"), below(f, ts).alias("bin")) for f, ts in cuts.items() if ts]
    if not bins:
        return {}
    counted = rows.select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    by = {(r["feature"], r["bin"]): (r["p"], r["n"]) for r in counted}
    out = {}
    for f, ts in cuts.items():
        for k, t in enumerate(ts):
            for at_least in (True, False):
                side = [by.get((f, b), (0, 0)) for b in (range(k + 1, len(ts) + 1) if at_least else range(k + 1))]
                out[Condition(f, at_least, t)] = (sum(p for p, _ in side), sum(n for _, n in side))
    return out


def _holding(rows: DataFrame, rule: list[Condition]) -> DataFrame:
    for c in rule:
        rows = rows.filter(c.column())
    return rows


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(
    labelled: DataFrame, features: tuple[str, ...] = TESTED, bins: int = 24, max_rules: int = 8, max_conditions: int = 3,
    min_precision: float = 0.9, min_covered: int = 5,
) -> DecisionList:
    """A decision list from ``labelled`` (features, bad 0/1, held 0/1) by sequential covering.

    ``held`` marks the rows that prune and judge a rule but never grow it. A rule stays
    if its precision on them, and on the growing rows, is at least ``min_precision``.
    Thresholds are ``bins`` quantiles of each feature over the rows still uncovered.
    """
    found = DecisionList()
    left = labelled
    while len(found.rules) < max_rules:
        grow, prune = left.filter("held = 0"), left.filter("held = 1")
        quantiles = left.filter("held = 0").select([F.percentile_approx(f, [k / bins for k in range(1, bins)], 10_000).alias(f) for f in features] + [F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), [k / bins for k in range(bins)], 10_000).alias(f"bad_{f}") for f in features] + [F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")]).first()
        p0, n0 = quantiles["p"] or 0, quantiles["n"] or 0
        if p0 < min_covered or not n0:
            break
        cuts = {f: sorted({float(x) for x in [*(quantiles[f] or []), *(quantiles[f"bad_{f}"] or [])] if x is not None}) for f in features}
        rule: list[Condition] = []
        while len(rule) < max_conditions and n0:
            sides = _sides(_holding(grow, rule), cuts)
            best = max(sides, key=lambda c: (_gain(*sides[c], p0, n0), str(c)), default=None)
            if best is None or sides[best][0] < min_covered or _gain(*sides[best], p0, n0) <= 1e-9:
                break
            rule.append(best)
            p0, n0 = sides[best]
        if not rule:
            break
        # counts of every prefix of the rule on both halves, at once
        hit = [F.lit(True)]
        for c in rule:
            hit.append(hit[-1] & c.column())
        row = left.agg(*[F.coalesce(F.sum(F.when(h & (F.col("bad") == b) & (F.col("held") == g), 1)), F.lit(0)).alias(f"c{k}_{b}_{g}") for k, h in enumerate(hit) for b in (0, 1) for g in (0, 1)]).first()
        score = lambda k: (row[f"c{k}_1_1"] - row[f"c{k}_0_1"]) / max(1, row[f"c{k}_1_1"] + row[f"c{k}_0_1"])
        cut = max(range(1, len(hit)), key=lambda k: (score(k), -k))
        precise = lambda g: row[f"c{cut}_1_{g}"] >= min_precision * (row[f"c{cut}_1_{g}"] + row[f"c{cut}_0_{g}"])
        if not (precise(0) and precise(1) and row[f"c{cut}_1_1"]):
            break
        found.rules.append(rule[:cut])
        holds = F.lit(True)
        for c in rule[:cut]:
            holds = holds & c.column()
        left = left.filter(~holds)
    return found


def label_rows(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled documents with bad = 1 for quality 0; one row in three prunes."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality")).cast("long").alias("bad"))
    return feats.filter(~base_failed()).join(known, "doc_id").withColumn("held", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).cast("int"))


def judged(docs: DataFrame, labels: DataFrame, carried: Column | None = None) -> tuple[DataFrame, DecisionList]:
    """(features, base_failed and kept of each row; the decision list that was learned)."""
    feats = written(features(docs, carried), "features")
    rules = learn(written(label_rows(feats.drop("carried"), labels), "labelled"))
    return feats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps()), rules


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; rows that repeat a doc_id are judged by their own text.

    Rows are written once beside their features, so texts are counted once and cross no
    shuffle.
    """
    found, _ = judged(docs, labels, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return found.filter("kept").select("carried.*")
