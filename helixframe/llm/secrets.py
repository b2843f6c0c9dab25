"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by pattern and always stay. Further credential formats are
candidates: each candidate's hash is counted over the corpus by distinct repositories
and by distinct owners. A value that many owners hold is a widely copied example; one
that few owners hold looks live and adds its span. The same count tells live-looking
base values from examples. The number of repositories is reported beside that of owners
and decides nothing: copies of a page within one owner make its key no example, however
many there are, and a growing corpus turns no verdict by copies alone.

Positions come from the pieces between matches: with the text split by a pattern, a
match starts where the pieces and matches before it end. Positions count code points,
ends are exclusive.

Hot values: an example in a third of all documents is pre-aggregated to one row for each
(value, owner) before it is counted, and the join back has two plain exchanges, which
AQE splits. Null and empty texts have no spans; a null owner or repository counts as
one more owner or repository. Repeated rows and rows that share a doc_id or have none
are scanned each on its own. An empty table gives an empty result; other columns,
whatever their names, are ignored and come back from redaction as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.storage import written

#: The base kinds, as (kind, pattern, group that holds the value, least length of that group).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Published credential formats that are candidates for the method.
TOKEN = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|sk-[A-Za-z0-9]{20,}"
)
BASE = ("assign", "access", "hex")
#: A value is an example once it has more owners than this.
MAX_OWNERS = 2

SPANS = "array<struct<start:int,order:int,kind:string,end:int,value:string>>"


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def spans(text: Column, kind: str, order: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Sorted spans of one kind; matches whose group is shorter than ``least`` drop out."""
    whole = F.regexp_extract_all(text, _literal(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, _literal(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    # code points up to the end of each match
    steps = F.transform(whole, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

    def span(m: Column, i: Column) -> Column:
        end = F.aggregate(F.slice(steps, 1, i + 1), F.lit(0), lambda a, x: a + x)
        return F.struct((end - F.length(m)).alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"), F.get(value, i).alias("value"))

    found = F.filter(F.transform(whole, span), lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """(doc_id, owner, repo, base, candidates): spans of each row, the base kinds and the method's candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(spans(text, "assign", 0, ASSIGN, 2, 6), spans(text, "access", 1, ACCESS), spans(text, "hex", 2, HEX))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"),
        base.alias("base"), spans(text, "token", 3, TOKEN).alias("candidates"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repos) of every value in ``found`` (owner, repo, value_hash)."""
    blank = F.lit("\u0000")
    pairs = found.select("value_hash", F.coalesce("owner", blank).alias("owner"), F.coalesce("repo", blank).alias("repo"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("n_owners"))
    repos = pairs.groupBy("value_hash", "repo").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value_hash")


def scanned(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """(row_id, doc_id, spans) of every row: its spans in order, each with ``live`` (owner-specific), ``base``, and the ``owners`` and ``repos`` that hold its value.

    ``spans`` holds every base span and the live candidates; ``row_id`` tells repeated rows apart.
    """
    rows = written(scan(docs, owner, repo).withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    every = rows.select("row_id", "owner", "repo", F.explode(F.concat("base", "candidates")).alias("s")).withColumn("value_hash", F.sha2(F.col("s.value"), 256))
    counts = written(ownership(every), "ownership")
    judged = every.select("row_id", "s", "value_hash").join(counts.select("value_hash", (F.col("n_owners") <= max_owners).alias("live"), F.col("n_owners").alias("owners"), F.col("n_repos").alias("repos")), "value_hash")
    stays = judged.filter(F.col("s.kind").isin(*BASE) | F.col("live"))
    one = F.struct(F.col("s.start").alias("start"), F.col("s.order").alias("order"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "live", F.col("s.kind").isin(*BASE).alias("base"), "owners", "repos")
    found = stays.groupBy("row_id").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    return rows.select("row_id", "doc_id").join(found, "row_id", "left").withColumn("spans", F.coalesce("spans", F.array()))


def secret_spans(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """The rows of ``scanned`` that have any span."""
    return scanned(docs, owner, repo, max_owners).filter(F.size("spans") > 0)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with every base span and live candidate in ``text`` replaced by ``mark``, and ``n_chars`` to match.

    A candidate is live if at most ``max_owners`` distinct owners hold it. The spans are
    found again row by row; only which candidate values are live comes from the corpus,
    joined by the text's hash to the rows that hold candidates. No other row meets the join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(spans(text, "assign", 0, ASSIGN, 2, 6), spans(text, "access", 1, ACCESS), spans(text, "hex", 2, HEX))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = written(
        docs.select(F.xxhash64("text").alias("text_hash"), F.col(owner).cast("string").alias("owner"), F.lit(None).cast("string").alias("repo"), F.explode(spans(text, "token", 3, TOKEN)).alias("s"))
        .select("text_hash", "owner", "repo", F.col("s.value").alias("value")).withColumn("value_hash", F.sha2("value", 256)), "candidates",
    )
    if held.limit(1).count():
        alive = held.select("text_hash", "value", "value_hash").distinct().join(ownership(held).filter(F.col("n_owners") <= max_owners), "value_hash")
        by_text = written(alive.groupBy("text_hash").agg(F.collect_set("value").alias("live")), "live")
        tokens = spans(text, "token", 3, TOKEN)
        some = rows.filter(text.rlike(TOKEN)).withColumn("text_hash", F.xxhash64("text")).join(by_text, "text_hash", "left")
        extra = F.filter(tokens, lambda s: F.coalesce(F.array_contains(F.col("live"), s["value"]), F.lit(False)))
        marked = rows.filter(~text.rlike(TOKEN)).select("row", "text", base.alias("spans")).unionByName(some.select("row", "text", F.concat(base, extra).alias("spans")))
    else:
        marked = rows.select("row", "text", base.alias("spans"))
    # overlapping spans become one: the text before each span starts where the furthest earlier span ended
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    built = F.aggregate(
        F.sort_array("spans"), start,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))),
    )
    changed = F.size("spans") > 0
    fixed = marked.select("row", changed.alias("changed"), F.when(changed, built).otherwise(F.col("text")).alias("text"))
    n_chars = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return fixed.select(*[F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
