"""Hash trees over arrays: two runs are compared by hashes, and only blocks that differ are read.

``write_tree`` cuts each array into blocks and writes them in shards beside a tree of
SHA-256 hashes: level 0 has a hash for each block, each level above one for every ``fan``
nodes below, up to the root. ``differences`` walks two trees from their top level down
along unequal nodes, so what it joins is in proportion to what differs, and then reads
the shards of blocks whose hashes differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.quality.checks import read_json, write_json_atomic
from helixframe.session import written


def array_blocks(df: DataFrame, keys: list[str], series: str, size: int) -> DataFrame:
    """(keys, block, values): ``size`` elements a block; an empty or null array has one empty block."""
    held = F.coalesce(F.col(series), F.array().cast(df.schema[series].dataType))
    last = F.greatest(F.ceil(F.size(held) / size) - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.slice(held, (b * size + 1).cast("int"), size))
    return df.select(*keys, F.posexplode(cut).alias("block", "values")).withColumn("block", F.col("block").cast("long"))


def block_hash(values: Column) -> Column:
    """SHA-256 of the elements' shortest exact decimal forms; 0.0 and -0.0 are one value, as are all NaNs."""
    return F.sha2(F.array_join(F.transform(values, lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))), ",", "null"), 256)


def write_tree(df: DataFrame, keys: list[str], series: str, folder: str, size: int = 1024, fan: int = 16, shards: int = 64) -> int:
    """Write ``df``'s arrays of numbers as blocks and tree; returns the number of levels.

    ``keys`` tell rows apart and have no nulls. ``tree.json`` comes last: without it the
    tree isn't there.
    """
    spark = df.sparkSession
    # neighbouring blocks of an array share a shard
    shard = F.pmod(F.xxhash64(*keys, F.floor(F.col("block") / fan)), F.lit(shards)).cast("int")
    blocks = array_blocks(df, keys, series, size).select("*", block_hash(F.col("values")).alias("hash"), shard.alias("shard"))
    blocks.write.partitionBy("shard").parquet(f"{folder}/blocks")
    nodes = spark.read.parquet(f"{folder}/blocks").select(*keys, F.col("block").alias("node"), "hash")
    most, level = nodes.agg(F.max("node")).first()[0] or 0, 0
    nodes.write.parquet(f"{folder}/nodes/level=0")
    while most:
        below, level, most = spark.read.parquet(f"{folder}/nodes/level={level}"), level + 1, most // fan
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most ``fan``
        up = below.groupBy(*keys, F.floor(F.col("node") / fan).alias("_up")).agg(F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256).alias("hash"))
        up.select(*keys, F.col("_up").alias("node"), "hash").write.parquet(f"{folder}/nodes/level={level}")
    write_json_atomic(f"{folder}/tree.json", {"keys": keys, "size": size, "fan": fan, "shards": shards, "levels": level + 1})
    return level + 1


def _matched(a: DataFrame, b: DataFrame, on: list[str], column: str) -> DataFrame:
    return a.select(*on, F.col(column).alias("_a")).join(b.select(*on, F.col(column).alias("_b")), on, "full_outer")


def unequal_blocks(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(keys, block): the blocks whose hashes differ or that only one run has."""
    a, b = read_json(f"{left}/tree.json"), read_json(f"{right}/tree.json")
    if odd := [f for f in ("keys", "size", "fan", "shards") if a[f] != b[f]]:
        raise ValueError(f"trees differ in {odd}")
    keys, fan = a["keys"], a["fan"]
    nodes = lambda folder, level: spark.read.parquet(f"{folder}/nodes/level={level}")
    level = min(a["levels"], b["levels"]) - 1
    differ = ~F.col("_a").eqNullSafe(F.col("_b"))
    odd = _matched(nodes(left, level), nodes(right, level), [*keys, "node"], "hash").filter(differ).select(*keys, "node")
    while level:
        level -= 1
        below = written(odd.select(*keys, F.explode(F.sequence(F.col("node") * fan, F.col("node") * fan + fan - 1)).alias("node")), "hash-tree")
        here = [nodes(x, level).join(below, [*keys, "node"], "left_semi") for x in (left, right)]
        odd = _matched(*here, [*keys, "node"], "hash").filter(differ).select(*keys, "node")
    return odd.withColumnRenamed("node", "block")


def differences(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(keys, changed, first_position, max_abs, blocks) for each key of either run.

    ``changed`` counts positions that differ or that only one array has, ``max_abs`` is the
    largest gap of positions that both have (null without one), ``blocks`` how many blocks
    were compared.
    """
    found = read_json(f"{left}/tree.json")
    keys, size, fan, shards = (found[f] for f in ("keys", "size", "fan", "shards"))
    odd = written(unequal_blocks(spark, left, right), "hash-tree")
    shard = F.pmod(F.xxhash64(*keys, F.floor(F.col("block") / fan)), F.lit(shards)).cast("int")
    named = [r["shard"] for r in odd.select(shard.alias("shard")).distinct().collect()]  # at most ``shards``
    on = [*keys, "block"]
    read = lambda folder: spark.read.parquet(f"{folder}/blocks").filter(F.col("shard").isin(named)).join(odd, on, "left_semi")
    both = _matched(read(left), read(right), on, "values")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema["_a"].dataType))
    unlike = F.zip_with(empty(F.col("_a")), empty(F.col("_b")), lambda x, y: ~x.eqNullSafe(y))
    gaps = F.zip_with(empty(F.col("_a")), empty(F.col("_b")), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    at = F.array_position(unlike, True)
    each = both.select(*keys, F.size(F.filter(unlike, lambda u: u)).cast("long").alias("_n"), F.when(at > 0, F.col("block") * size + at - 1).alias("_first"), F.array_max(gaps).alias("_gap"))
    per_key = each.groupBy(*keys).agg(F.sum("_n").alias("changed"), F.min("_first").alias("first_position"), F.max("_gap").alias("max_abs"), F.count("*").alias("blocks"))
    every = _matched(*[spark.read.parquet(f"{x}/nodes/level=0").filter("node = 0") for x in (left, right)], keys, "node").select(*keys)
    return every.join(per_key, keys, "left").fillna(0, ["changed", "blocks"])
