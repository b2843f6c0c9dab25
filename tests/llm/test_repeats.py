"""Tandem repeats and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from helixframe.llm import queries, repeats, tandem
from tests.llm.test_operators import DOCS, SCHEMA, WORD, prose

FOLDER = "/root/testdata/sf0.001"


def plain_runs(t, least=2, exponent=2):
    """By every period in turn; a period that a smaller one divides or replaces is none."""
    found = []
    for q in range(1, len(t) // exponent + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            n = i + q - s
            if n >= max(least, exponent * q) and not any(all(t[j] == t[j + p] for j in range(s, s + n - p)) for p in range(1, q)):
                found.append((s, n, q))
            i += 1
    return sorted(found)


def small_sequences(n):
    r = random.Random(4)
    for _ in range(n):
        t = [r.randrange(r.choice([1, 2, 2, 3, 4])) for _ in range(r.choice([0, 1, 3, 9, 20, 45]))]
        yield t if r.random() < 0.7 else (t[:5] * 9)[: r.randrange(40)] + t + (t[3:7] * 9)[: r.randrange(30)]


def test_runs_of_sequences():
    for t in small_sequences(3000):
        assert tandem.runs(t) == plain_runs(t), t


def test_stretches_lose_no_run():
    for least, exponent in ((2, 2), (6, 4), (3, 2), (9, 3)):
        finder, some = repeats._Finder(least, exponent), list(small_sequences(400))
        sizes = np.array([len(t) for t in some])
        found = repeats.found_runs(np.array([x for t in some for x in t]), sizes, finder)
        assert found == [plain_runs(t, least, exponent) for t in some]


def test_blocks_are_longest_earlier_matches():
    for t in small_sequences(300):
        cuts = tandem.SuffixTree(t).blocks()
        for a, b in zip(cuts, cuts[1:]):
            longest = max((next((k for k in range(len(t) - a) if t[j + k] != t[a + k]), len(t) - a) for j in range(a)), default=0)
            assert b - a == max(1, longest)


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if rest == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, len(w)))]
    found = plain_runs(w, 6, 4)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)), len(w))


def test_rows(spark):
    once = prose(9)
    texts = [*DOCS.values(), (once + " ") * 5 + prose(20), prose(5) + " " + "x y z " * 30 + "x", "same " * 6, "same " * 5, ("the cat sat\n") * 40 + " ".join([once] * 4), None]
    rows = [(None if i % 11 == 5 else i // 2 * 3, t, "en", None, 1, "c", "c", 1, "c") for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in repeats.digests(repeats.periodic_runs(df, repeat_tails=True)).collect()]
    key = lambda x: repr(x)
    assert sorted(got, key=key) == sorted((plain_row(r[0], r[1]) for r in rows), key=key)
    assert sum(x[1] > 0 for x in got) > 10
    assert repeats.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        repeats.periodic_runs(df, exponent=1)


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in docs if len(r["text"]) < 4000}
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, FOLDER).collect()}
    assert len(got) == len(docs) and all(got[k] == v for k, v in short.items()) and len(short) > 100
