"""The Merkle manifest against a plain one."""

import hashlib
import zlib
from collections import defaultdict

from helixframe.llm import merkle
from tests.llm.test_operators import ROWS, SCHEMA

EXTRA = "tree string, place string, digest string, members string, path string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(nodes):
    """Each level's nodes, from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(all_levels, i):
    """(siblings to the left, to the right) at each level from leaf ``i`` up."""
    for nodes in all_levels[:-1]:
        run = i // 2 * 2
        yield "".join(nodes[run:i]), "".join(nodes[i + 1 : run + 2])
        i //= 2


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r[:5]
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        leaf = plain_leaf(*r[:5])
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, plain_leaf(doc_id, text, lang, source, n_chars + 1) if hit else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (there, doc_id, leaf, tampered) in enumerate(sorted(groups[g])):
            path = [*way(trees[g], i), *way(top, at)]
            folded = tampered
            for left, right in path:
                folded = sha(left + folded + right)
            root = top[-1][0]
            out.append((doc_id if there else None, leaf, trees[g][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_awkward_rows(spark):
    rows = [*ROWS, *ROWS[:5], (None, "no id", "de", None, 5, "c", "c", 1, "c"), (None, None, None, None, None, "c", "c", 1, "c"), (70, "x", "é", "s", None, "c", "c", 1, "c"), (71, "", "", "s", 0, "c", "c", 1, "c")]
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], f"{SCHEMA}, {EXTRA}").repartition(3)
    found = merkle.manifest(df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert order(found.collect()) == order(plain_manifest(rows))
    assert merkle.manifest(df.limit(0)).count() == 0


def test_sizes_of_trees(spark):
    rows = [(i * 3, f"t{i}", f"l{n}", "s", i) for n in (1, 2, 3, 255, 256, 257, 700) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert order(merkle.manifest(df).collect()) == order(plain_manifest(rows))
    assert order(merkle.manifest(df.filter("doc_id = 0 and lang = 'l1'")).collect()) == order(plain_manifest(rows[:1]))


def test_many_groups_and_tables(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)  # 4 children a row: the trees take several tables
    rows = [(i, f"t{i}", f"g{i % 23}" if i % 3 else "hot", "s", i) for i in range(330)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = merkle.manifest(df).collect()
    assert order(got) == order(plain_manifest(rows)) and 20 < sum(not r["verified"] for r in got) < 90
