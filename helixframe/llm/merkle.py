"""A Merkle manifest of a dataset, stored by parents' preimages.

Each row is a leaf. Rows of a group (``lang``) form a binary tree by ascending doc_id, and
the groups' roots form one above. H is SHA-256 as lowercase hex over concatenated
digests' hex text; a run of one node at a level's end is hashed alone.

For each parent the manifest stores its preimage: its children's digests end to end. A
leaf takes its ancestors' preimages; its sibling is what is left when its own 64
characters are cut out, and a changed leaf is folded up by putting its new digest there.
So a proof needs no look at other leaves.

Trees are built 8 levels at a time: a table row holds 256 neighbours and the preimages
above them, so no group is larger, and a tree of 10^10 leaves has five such tables. The
leaves' places come from range partitions (``with_ordinals``): a group that holds a third
of all rows is spread over tasks. Only digests are shuffled, never texts; each table is
written before the next is built.

Null fields are hashed as ``-``. Null doc_ids come first in their group; rows of equal
doc_id go by their leaves. Null is a group of its own and comes first. Rows without a
doc_id are never tampered with. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.storage import written
from helixframe.operators.ordinals import with_ordinals

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a table, and children below one of its rows.
LEVELS = 8
HEX = 64


def _h(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    """H of the values, each as its UTF-8 byte count, a colon and itself, or ``-`` if null."""
    shown = [v.cast("string") for v in values]
    return _h(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown]))


def leaves(docs: DataFrame, group: str = "lang") -> DataFrame:
    """(tree, doc_id, leaf, tampered): a row's group as text that sorts as the groups do, its digest, and the digest after tampering."""
    n, doc_id = F.col("n_chars"), F.col("doc_id").cast("long")
    changed = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False)) & n.isNotNull()
    values = lambda chars: [chars if f == "n_chars" else F.col(f) for f in FIELDS]
    leaf = leaf_digest(values(n))
    return docs.select(
        F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"),
        doc_id.alias("doc_id"), leaf.alias("leaf"), F.when(changed, leaf_digest(values(n + 1))).otherwise(leaf).alias("tampered"),
    )


def _pairs(first: Column, digest) -> Column:
    """Preimages of a level: what ``digest`` makes of each two neighbours of ``first``, end to end."""
    at = F.sequence(F.lit(0), F.shiftright(F.size(first) - 1, 1))
    return F.transform(at, lambda i: F.concat(digest(F.get(first, 2 * i)), F.coalesce(digest(F.get(first, 2 * i + 1)), F.lit(""))))


class Forest:
    """Trees over ``nodes`` (tree, place, digest, and columns that the lowest table keeps), as a list of written tables.

    A row of table t is (tree, block, n_levels, members, preimages, digest): up to 256
    neighbours below level 8 (t + 1), the preimages of each level above them, and the
    digest that they become.
    """

    def __init__(self, nodes: DataFrame, name: str):
        counts = written(nodes.groupBy("tree").agg(F.count("*").alias("_n")), f"{name}-counts")
        most = counts.agg(F.max("_n")).first()[0] or 1
        depth = F.when(F.col("_n") > 1, F.length(F.bin(F.col("_n") - 1))).otherwise(0)
        depths, self.tables = counts.select("tree", depth.alias("_depth")), []
        while not self.tables or most > 1 << LEVELS * len(self.tables):
            t = len(self.tables)
            table = self._table(nodes, depths, t)
            self.tables.append(written(table, f"{name}-{t}"))
            nodes = self.tables[-1].select("tree", F.col("block").alias("place"), "digest")
        self.roots = self.tables[-1].select("tree", "digest")

    @staticmethod
    def _table(nodes: DataFrame, depths: DataFrame, t: int) -> DataFrame:
        held = F.sort_array(F.collect_list(F.struct("place", *[c for c in nodes.columns if c not in ("tree", "place")])))
        blocks = nodes.groupBy("tree", F.shiftright("place", LEVELS).alias("block")).agg(held.alias("members"))
        blocks = blocks.join(depths, "tree").withColumn("n_levels", F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.col("_depth") - LEVELS * t)))
        first = _pairs(F.col("members"), lambda m: m["digest"])
        rest = F.when(F.col("n_levels") > 1, F.sequence(F.lit(2), F.col("n_levels"))).otherwise(F.array().cast("array<int>"))
        above = F.aggregate(rest, F.array(first), lambda levels, _: F.concat(levels, F.array(_pairs(F.element_at(levels, -1), _h))))
        blocks = blocks.withColumn("preimages", F.when(F.col("n_levels") > 0, above).otherwise(F.array().cast("array<array<string>>")))
        top = F.when(F.col("n_levels") > 0, _h(F.get(F.element_at("preimages", -1), F.lit(0)))).otherwise(F.col("members")[0]["digest"])
        return blocks.select("tree", "block", "n_levels", "members", "preimages", top.alias("digest"))

    @staticmethod
    def _ancestors(place: Column) -> Column:
        """A member's ancestors inside its row, from below: preimage, and which of its slots is the member's way."""
        halved = lambda j: F.floor(place % (1 << LEVELS) / F.pow(F.lit(2), j)).cast("int")
        step = lambda level, j: F.struct(F.get(level, halved(j + 1)).alias("preimage"), (halved(j) % 2).alias("slot"))
        return F.transform(F.col("preimages"), step)

    def paths(self, above: DataFrame) -> DataFrame:
        """The lowest table with each row's ``path``, from (tree, subroot, root, path) of the trees' roots: one row for each 256 leaves."""
        upper = above.withColumn("block", F.lit(0).cast("long"))
        for t in range(len(self.tables) - 1, -1, -1):
            rows = self.tables[t].join(upper, ["tree", "block"])
            if t:
                each = F.transform("members", lambda m: F.struct(m["place"].alias("block"), F.concat(self._ancestors(m["place"]), F.col("path")).alias("path")))
                upper = rows.select("tree", "subroot", "root", F.inline(each))
        return rows


def _left(x: Column) -> Column:
    return F.substr(x["preimage"], F.lit(1), x["slot"] * HEX)


def _right(x: Column) -> Column:
    return F.substr(x["preimage"], x["slot"] * HEX + HEX + 1)


def siblings(path: Column) -> Column:
    """The digests beside a path, each preimage without the path's own slot, end to end."""
    return F.array_join(F.transform(path, lambda x: F.concat(_left(x), _right(x))), "")


def folded(path: Column, digest: Column) -> Column:
    """The root that ``digest`` gives in place of the leaf of ``path``."""
    return F.aggregate(path, digest, lambda below, x: _h(F.concat(_left(x), below, _right(x))))


def manifest(docs: DataFrame, group: str = "lang") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    ``folded_root`` is recomputed from the tampered leaf, if a row is tampered with, and the
    original siblings; ``verified`` says whether it is the root.
    """
    made = written(leaves(docs, group), "leaves")  # texts are read and hashed once
    placed = with_ordinals(made, ["tree"], ["doc_id", "leaf", "tampered"], "place", written)
    trees = Forest(placed.select("tree", "place", F.col("leaf").alias("digest"), "doc_id", "tampered"), "tree")
    # a row for each group
    roots = with_ordinals(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["tree"], ["group"], "place", written)
    top = Forest(roots, "top")
    start = top.roots.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<struct<preimage:string,slot:int>>").alias("path"))
    to_root = F.transform("members", lambda m: F.struct(m["group"].alias("tree"), m["digest"].alias("subroot"), F.concat(Forest._ancestors(m["place"]), F.col("path")).alias("path")))
    above = top.paths(start).select("root", F.inline(to_root))
    each = F.transform("members", lambda m: F.struct(m["doc_id"].alias("doc_id"), m["digest"].alias("leaf"), m["tampered"].alias("tampered"), F.concat(Forest._ancestors(m["place"]), F.col("path")).alias("path")))
    rows = trees.paths(above).select("subroot", "root", F.inline(each))
    rows = rows.select("doc_id", "leaf", "subroot", "root", _h(siblings(F.col("path"))).alias("proof_sha256"), folded(F.col("path"), F.col("tampered")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
