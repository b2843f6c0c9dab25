"""Writers: CSV in fixed column order, several tables from one scan, pass and quarantine, resumable runs."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import rename


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Exactly ``columns``, in order; others don't go out."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_csv_union(frames: list[DataFrame], path: str) -> list[str]:
    """All frames under the union of their columns, in order of first appearance; returns the header."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    write_csv(out, path, out.columns)
    return out.columns


def export_csv_file(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A single CSV file with a byte-order mark, for reports: raises rather than pull more than ``most`` rows to the driver."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    rows.to_csv(path, index=False, encoding="utf-8-sig")


def write_many(df: DataFrame, outputs: dict[str, tuple[Column, list[str]]], folder: str) -> None:
    """Several filtered tables from one pass: rows go out once for each output they belong to, as partitions of one write."""
    kinds = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, (holds, _) in outputs.items()]))
    df.withColumn("output", F.explode(kinds)).write.mode("overwrite").partitionBy("output").parquet(folder)


def read_output(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """One of ``write_many``'s tables; partition pruning reads its files alone."""
    return spark.read.parquet(folder).filter(F.col("output") == name).select(*columns)


class RunStore:
    """Results by run_id that a stopped job can take up again, behind a log of commits.

    A commit writes its files first, into a folder of its own, and then one log entry
    under the next free number. Readers list the log: files without an entry are an
    interrupted commit and count nowhere. An entry is made by a rename that fails where
    the number is taken, so of two writers one takes the next number. Rows that fail
    validation go to quarantine and never count as complete. Of a run that several
    commits hold, the earliest counts. A commit reads nothing of the store but the log's
    names; the driver sees one line for each commit.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "run_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> list[dict]:
        """The entries in order: number, commit, fingerprint."""
        path, fs = self._path("log")
        if not fs.exists(path):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(path))
        out = []
        for name in (n for n in names if n.endswith(".json")):
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(self._path(f"log/{name}")[0]), "UTF-8")
            out.append({"number": int(name.removesuffix(".json")), **json.loads(text)})
        return out

    def _append(self, entry: dict) -> int:
        folder, fs = self._path("log")
        fs.mkdirs(folder)
        waiting, _ = self._path(f"log/{entry['commit']}.waiting")
        stream = fs.create(waiting, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        taken = [int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")]
        number = max(taken, default=-1) + 1
        while not rename(self.spark, waiting.toString(), f"{self.folder}/log/{number:012d}.json", overwrite=False):
            number += 1  # taken meanwhile
        return number

    def commit(self, results: DataFrame, passed: Column, fingerprint: str) -> int:
        """Add results; returns the commit's number."""
        commit = uuid.uuid4().hex
        marked = results.withColumn("_state", F.when(F.coalesce(passed, F.lit(False)), "passed").otherwise("quarantine"))
        marked.withColumn("config_fingerprint", F.lit(fingerprint)).write.partitionBy("_state").parquet(f"{self.folder}/commits/{commit}")
        return self._append({"commit": commit, "fingerprint": fingerprint})

    def _rows(self, state: str, fingerprint: str | None = None) -> DataFrame | None:
        """Rows of all commits, with ``_number``; only the files of this state are read."""
        out = None
        for entry in self.log():
            if fingerprint is not None and entry["fingerprint"] != fingerprint:
                continue
            path, fs = self._path(f"commits/{entry['commit']}/_state={state}")
            if fs.exists(path):
                rows = self.spark.read.parquet(path.toString()).withColumn("_number", F.lit(entry["number"]))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def completed(self, fingerprint: str) -> DataFrame | None:
        found = self._rows("passed", fingerprint)
        return None if found is None else found.select(self.key).distinct()

    def pending(self, plan: DataFrame, fingerprint: str) -> DataFrame:
        """Rows of the plan that no commit of this fingerprint completed; a config lock: those of another don't count."""
        done = self.completed(fingerprint)
        return plan if done is None else plan.join(done, self.key, "left_anti")

    def results(self, fingerprint: str) -> DataFrame | None:
        """Complete rows, one for each run: the earliest commit's; of several in one commit any."""
        found = self._rows("passed", fingerprint)
        if found is None:
            return None
        first = found.groupBy(self.key).agg(F.min_by(F.struct(*[c for c in found.columns if c != self.key]), "_number").alias("_f"))
        return first.select(self.key, "_f.*").drop("_number")

    def quarantined(self) -> DataFrame | None:
        found = self._rows("quarantine")
        return None if found is None else found.drop("_number")


def write_staged(df: DataFrame, path: str) -> None:
    """Write beside the target and swap by two renames; no moment leaves fewer than one whole table.

    The old table waits at ``<path>.old`` until the new one is in place; a crash between
    the renames leaves both whole, and the next call puts the old one back first. A reader
    that opens the path between the renames finds nothing there, never half a table.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staging, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.partial", path, f"{path}.old"))
    fs = target.getFileSystem(conf)

    def move(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"{a} can't be moved to {b}")

    if fs.exists(old) and not fs.exists(target):
        move(old, target)
    df.write.mode("overwrite").parquet(f"{path}.partial")
    fs.delete(old, True)
    if fs.exists(target):
        move(target, old)
    move(staging, target)
    fs.delete(old, True)


def write_fasta(df: DataFrame, path: str, name: str, sequence: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the files below a folder."""
    from helixframe.sources.tables import list_files

    return list_files(spark, folder, content=True).select("name", "bytes", "sha256")
