"""Integrity checks as tables: hashes of membership, consistency of groups, expectations, recomputed metrics."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import rename


def membership_hash(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """n and the SHA-256 of the compact JSON list of each group's sorted members.

    A group's members meet in one row, as the hash asks: meant for groups like folds, not
    for a whole table.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.to_json(F.sort_array(F.collect_list(member))), 256).alias("membership_sha256"))


def group_consistency(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many rows and different values each group has, and whether all rows agree."""
    n = F.count_distinct(F.struct(*columns))
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), n.alias("n_variants")).withColumn("consistent", F.col("n_variants") == 1)


def expectations(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] = {}) -> DataFrame:
    """(expectation, passed, failures): a NULL condition counts as met, as a check constraint would.

    All conditions come from one pass; each uniqueness rule adds an aggregation by its key.
    """
    row = df.agg(*[F.count_if(~c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    stacked = row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("expectation"), F.col(f"r{i}").alias("failures")) for i, name in enumerate(rules)])).alias("x")).select("x.*") if rules else None
    for name, key in unique.items():
        one = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failures")).select(F.lit(name).alias("expectation"), "failures")
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.select("expectation", (F.col("failures") == 0).alias("passed"), "failures")


def audit_status(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """PASS if every row is ok, FAIL if none is, else PARTIAL_PASS; a NULL isn't ok."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("passed"))
    return out.withColumn("status", F.when(F.col("passed") == F.col("n"), "PASS").when(F.col("passed") == 0, "FAIL").otherwise("PARTIAL_PASS"))


def recompute_audit(stored: DataFrame, recomputed: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Each key and metric with both values and whether they agree: within tolerance, or both NaN, or both NULL."""
    long = lambda df, into: df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", into)
    both = long(stored, "stored").join(long(recomputed, "recomputed"), [*keys, "metric"], "full_outer")
    a, b = F.col("stored"), F.col("recomputed")
    same = (F.abs(a - b) <= tolerance) | (F.isnan(a) & F.isnan(b)) | (a.isNull() & b.isNull())
    return both.withColumn("agrees", F.coalesce(same, F.lit(False)))


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """``df``, raising when it runs if a row doesn't meet the condition."""
    return df.filter(F.coalesce(F.assert_true(holds, F.lit(message)).cast("boolean"), F.lit(True)))


def assert_schema(df: DataFrame, columns: list[str], rows: int | None = None) -> None:
    """The exact columns in order, and the row count if given."""
    if df.columns != columns:
        raise ValueError(f"columns are {df.columns}, not {columns}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows, not {rows}")


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def fingerprint(value: object) -> str:
    """SHA-256 of a document's canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _store(path: str):
    """(file system, path) of the running session's Hadoop configuration; None without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_json_atomic(path: str, value: object, replace: bool = True) -> bool:
    """A small JSON document that is there whole or not at all, in any store that Spark reaches.

    It is written beside its place and renamed. With ``replace=False`` a document that is
    there already stays, and False is returned. Without a running session the path is a
    local one.
    """
    body = json.dumps(value, sort_keys=True, indent=2, allow_nan=False).encode()
    if (found := _store(path)) is None:
        return _write_local(path, body, replace)
    fs, target = found
    part = target.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    out.write(body)
    out.close()
    # one step, so a crash leaves the old document or the new one; of two writers that mustn't replace, one finds the other's
    done = rename(SparkSession.getActiveSession(), part.toString(), path, overwrite=replace)
    if not done:
        fs.delete(part, False)
    return done


def _write_local(path: str, body: bytes, replace: bool) -> bool:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("wb", dir=folder, suffix=".tmp", delete=False) as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    try:
        if replace:
            os.replace(f.name, path)
        else:
            os.link(f.name, path)
            os.unlink(f.name)
        return True
    except FileExistsError:
        os.unlink(f.name)
        return False


def read_json(path: str) -> object | None:
    """A document of ``write_json_atomic``, None if it isn't there."""
    if (found := _store(path)) is None:
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return json.load(f)
    fs, at = found
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def freeze(path: str, protocol: dict) -> dict:
    """Write a protocol once; a later run must bring the same one."""
    if not write_json_atomic(path, protocol, replace=False) and read_json(path) != json.loads(canonical_json(protocol)):
        raise ValueError(f"{path} holds another protocol")
    return protocol


def compatible(left: dict, right: dict, fields: list[str]) -> None:
    """Two runs' configurations agree in ``fields``."""
    if odd := [f for f in fields if left.get(f) != right.get(f)]:
        raise ValueError(f"runs differ in {odd}")


def gate_chain(status: DataFrame, name: str, state: str, wanted: dict[str, str]) -> None:
    """Raise unless every named step has reported exactly the state that is wanted of it."""
    seen = {r[name]: r[state] for r in status.filter(F.col(name).isin(*wanted)).select(name, state).collect()}  # one row a step
    if odd := {k: seen.get(k) for k, v in wanted.items() if seen.get(k) != v}:
        raise ValueError(f"not ready: {odd}")


def reads_only(df: DataFrame, folders: list[str]) -> DataFrame:
    """``df``, if every file that it would read lies below one of ``folders``; raises before anything is read otherwise."""
    bare = lambda p: re.sub("^[a-z0-9]+:/+", "/", p)
    allowed = tuple(bare(f).rstrip("/") + "/" for f in folders)
    if odd := sorted(p for p in map(bare, df.inputFiles()) if not p.startswith(allowed)):
        raise ValueError(f"reads {odd[:3]}")
    return df


def repeat_control(first: DataFrame, second: DataFrame, key: list[str], series: str) -> DataFrame:
    """(key, equal, changed, first_position) of two runs of one reference input: any difference is the machine's."""
    from helixframe.functions.vectors import changed_count, first_change

    both = first.select(*key, F.col(series).alias("_a")).join(second.select(*key, F.col(series).alias("_b")), key)
    out = both.select(*key, changed_count(F.col("_a"), F.col("_b")).alias("changed"), first_change(F.col("_a"), F.col("_b")).alias("first_position"))
    return out.withColumn("equal", F.col("changed") == 0)


def progress(done: int, planned: int, recent_seconds: list[float], window: int = 100) -> dict:
    """A progress document: the rest at the mean of the last ``window`` timings."""
    tail = recent_seconds[-window:]
    mean = sum(tail) / len(tail) if tail else None
    return {"completed": done, "planned": planned, "mean_seconds": mean, "remaining_seconds": None if mean is None else mean * max(0, planned - done)}
