"""SimHash near-duplicates by anchor-point covering.

A fingerprint has one bit for each of 64 votes over the XXH64 values of a text's
word shingles. Two fingerprints link at Hamming distance <= 3, so in one of their
two 32-bit halves they differ in at most one bit. Over 31 bits of a half the
[31, 26] Hamming code is a perfect covering code of radius 1: its codewords are the
anchors, and the 32nd bit is carried along unchanged. A fingerprint lives at its
nearest anchor and is replicated to every anchor within radius + threshold (1 + 1),
hence any linked pair meets at the home anchor of one of the two. Only anchors above
the own home get a replica, which is enough for each pair to meet once.

Per anchor, fingerprints are compared and only a spanning star of each local
component is kept, so a group of near copies yields rows in proportion to its size
and not to its square. Components over all fingerprints follow by min-label hooking
with pointer jumping, in joins whose two sides are plain exchanges (AQE splits hot
ones).

``near_copies`` links by likeness instead: texts of which the Jaccard likeness of their
sets of five-word shingles is at least 0.8. At that likeness 64-bit fingerprints differ
in about 10 bits, where no covering is selective, so anchors alone can't find such pairs.
Candidates are what the anchors link and, beside them, pairs that share one of their
``KEYS`` smallest shingle hashes: a pair at 0.8 shares none of them with a chance of
10^-7. Candidates are compared by fingerprint first and then, exactly, by their shingles:
one pair of each form first, and then those pairs that are not in one class yet. Texts
with equal sets are one form, so copies cost one row, and only the texts of candidates
are read again.

Texts with a common template share hashes without being alike, so a hash of more than
``SMALL_GROUP`` forms doesn't name pairs. Forms that have such hot hashes are compared in
three steps, each between the classes that the one before has left apart:

1. Under each hot hash forms are put in order of their turned fingerprints over all tasks
   and cut into blocks; each form is a candidate with its nearest in the block and with the
   block's first, each block's first with the hash's first. Each hot hash turns otherwise.
   This leaves pairs out; it only makes the classes that spare the next steps most pairs.
2. Two forms that share a shingle which at most ``SMALL_GROUP`` of them have are candidates.
3. All other pairs share nothing but hot shingles, so they can't share more of them than
   the lesser has: of a form at least ``LIKENESS`` of all shingles must be hot, and a pair
   whose hot ones are too few for its two sizes isn't alike. All pairs that this bound and
   the sizes leave are compared by their shingles, in cells of two blocks of forms; a cell
   gives the links that join classes and no others.

Nulls and empty texts: a text without words has fingerprint zero and links like any
other. Rows with a null ``doc_id`` take part; ``component_id`` ignores null ids.
Repeated rows are equal fingerprints and thus one component; rows that share a doc_id
are told apart by their texts. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.batches import text_chunks, texts_of
from helixframe.llm.storage import Written, written
from helixframe.operators.ordinals import with_ordinals

SEED = 42
#: What near copies are: shingles of so many words, a Jaccard likeness of at least so much.
WORDS, LIKENESS = 5, 0.8
#: Smallest shingle hashes of a text that name it as a candidate, and fingerprint bits in which candidates may differ: at a likeness of 0.8 bits differ in 9.7 of 64 with a deviation of 2.9.
KEYS, NEAR_BITS = 10, 22
#: Groups of so many forms are compared pair by pair, larger ones in blocks of fingerprints and by their rare shingles.
SMALL_GROUP, BLOCK = 64, 4096
#: Blocks that forms of hot shingles are cut into at least, and the least and most shingles of one.
SPREAD, CELL = 16, (1 << 14, 1 << 22)
#: Hot shingles that a task remembers; others are sent again, and found hot where they meet.
KNOWN_HOT = 500_000
#: Tables of ids of at most so many rows, counted first, are broadcast; larger ones meet the texts in a shuffle.
SMALL_SIDE = 500_000
#: Fingerprints of one anchor beyond which it is split.
SPLIT = 4096


def simhash64(text: str | None, words: int = 3, lower: bool = True) -> int:
    """The 64-bit fingerprint of a whole text; zero if it has no words."""
    if not text:
        return 0
    raw = text.encode("utf-8", "replace")
    parts = (raw.lower() if lower else raw).split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, lower: bool = True) -> DataFrame:
    """(doc_id, text_hash, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            fps = np.array([simhash64(t, words, lower) for t in chunk.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([chunk.column(0), chunk.column(2), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, row of fp) for both halves of each fingerprint: its home and the anchors it is replicated to."""
    positions = np.arange(1, 32, dtype=np.uint32)
    keys, rows = [], []
    every = np.arange(len(fp))
    for half in (0, 1):
        h = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        syndrome = np.zeros(len(h), np.uint32)
        for j in range(5):
            mask = np.uint32(sum(1 << (int(p) - 1) for p in positions if p >> j & 1))
            syndrome |= (np.bitwise_count(h & mask) & 1).astype(np.uint32) << np.uint32(j)
        flip = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - 1), np.uint32(0)).astype(np.uint32)
        home = h ^ flip
        base = np.uint64(half) << np.uint64(32)
        keys.append(home | base)
        rows.append(every)
        near = [(home ^ np.uint32(1 << 31), np.ones(len(h), bool))]
        for a in range(1, 32):
            b = syndrome ^ np.uint32(a)
            ok = (syndrome > 0) & (b > a)
            near.append((h ^ np.uint32(1 << (a - 1)) ^ np.where(ok, np.uint32(1) << (np.maximum(b, 1) - 1), 0).astype(np.uint32), ok))
        for word, ok in near:
            ok = ok & (word > home)
            keys.append(word[ok] | base)
            rows.append(every[ok])
    return np.concatenate(keys).astype(np.int64), np.concatenate(rows)


def cover(fps: DataFrame) -> DataFrame:
    """(anchor, fp) for distinct fingerprints ``fps`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50_000):
                fp = batch.column(0).slice(i, 50_000).to_numpy(zero_copy_only=False).view(np.uint64)
                key, row = _anchors(fp)
                yield pa.record_batch([pa.array(key), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def _star(fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (root, member) of the components of one anchor's fingerprints."""
    left = np.unique(fp)
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        reached = []
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, 4_000_000 // len(left))
            for i in range(0, len(front), step):
                hit |= (np.bitwise_count(front[i : i + step, None] ^ left[None, :]) <= most).any(axis=0)
            front, left = left[hit], left[~hit]
            reached.append(front)
        if reached and (members := np.concatenate(reached)).size:
            yield np.full(len(members), root), members


def _split(fp: np.ndarray, half: int) -> Iterator[np.ndarray]:
    """The fingerprints of one anchor of a half; many are split by each byte of the other half.

    Of four bytes at most three hold a difference, so fingerprints that link share a split.
    """
    if len(fp) <= SPLIT:
        yield fp
        return
    for i in range(4):
        byte = (fp >> np.uint64(32 * (1 - half) + 8 * i)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        yield from np.split(fp[order], np.flatnonzero(np.diff(byte[order])) + 1)


def links(covered: DataFrame, most: int = 3) -> DataFrame:
    """(u, v) with fingerprints that link, at least a spanning star of each anchor's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(u: list, v: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

        def groups(key: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
            cut = np.flatnonzero(np.diff(key)) + 1
            starts, sizes = np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [len(key)])))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most]
            u, v = [fp[two]], [fp[two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for some in _split(fp[s : s + n], int(key[s]) >> 32):
                    for a, b in _star(some, most):
                        u.append(a)
                        v.append(b)
            return u, v

        keys, fps = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            # the last anchor may go on in the next batch
            last = int(np.searchsorted(key, key[-1], side="left"))
            keys.append(key[:last])
            fps.append(fp[:last])
            if last or (keys and keys[0].size and keys[0][0] != key[-1]):
                u, v = groups(np.concatenate(keys), np.concatenate(fps))
                keys, fps = [], []
                yield edges(u, v)
            keys.append(key[last:])
            fps.append(fp[last:])
        if keys:
            yield edges(*groups(np.concatenate(keys), np.concatenate(fps)))

    sides = covered.select("anchor", "fp").repartition("anchor").sortWithinPartitions("anchor")
    return sides.mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for each node of the undirected ``edges`` (u, v)."""
    both = Written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    e = both.df
    state = Written(e.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "labels")
    total = None
    while True:
        now = state.df.agg(F.sum(F.col("comp").cast("decimal(38,0)")), F.count("*")).first()
        if not now[1] or now[0] == total:
            break
        total = now[0]
        label = state.df
        around = e.join(label.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("comp"))
        seen = Written(label.join(around.select(F.col("u").alias("node"), F.col("comp").alias("near")), "node").select("node", "comp", F.least("comp", "near").alias("near")), "near")
        s = seen.df
        hooked = s.select("node", "near").unionByName(s.select(F.col("comp").alias("node"), "near")).groupBy("node").agg(F.min("near").alias("comp"))
        up = Written(hooked, "hooked")
        jumped = up.df.alias("a").join(up.df.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp").select("node", F.col("top").alias("comp"))
        state, old = Written(jumped, "labels"), state
        for x in (old, seen, up):
            x.drop()
    both.drop()
    return state.df


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, lower: bool = True) -> DataFrame:
    """(doc_id, text_hash, fp, class_id, component_id): each row's fingerprint, its component's smallest, and the smallest doc_id reachable over links.

    ``most`` is the largest Hamming distance of a link; the covering handles up to 3.
    """
    if not 0 <= most <= 3:
        raise ValueError("the covering is built for a distance of at most 3")
    rows = written(fingerprints(docs, words, lower), "fingerprints")
    first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    label = components(written(links(cover(first), most), "links"))
    linked = first.join(label.select(F.col("node").alias("fp"), "comp"), "fp", "left").select("fp", "first_id", F.coalesce("comp", "fp").alias("comp"))
    smallest = written(linked.groupBy("comp").agg(F.min("first_id").alias("component_id")), "components")
    classes = written(linked.join(smallest, "comp").select("fp", F.col("comp").alias("class_id"), "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "text_hash", "fp", "class_id", "component_id")


def hex_fingerprint(fp: str = "fp"):
    """The fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- near copies by likeness --------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, end to end, and how many each has.

    A text of fewer words has its whole sequence as one shingle, a text without words the shingle 0.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = cut.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
    coded = flat.filter(there).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    size = np.diff(ends)
    long_ = size >= words
    rows, hashes = [np.flatnonzero(size == 0)], [np.zeros(int((size == 0).sum()), np.uint64)]
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words if len(rolled) else 0):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(rolled)]
    row = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(row)) - ends[:-1][row] <= size[row] - words
    at = np.flatnonzero(inside & long_[row])
    rows.append(row[at])
    hashes.append(_mixed(rolled[at]))
    for i in np.flatnonzero((size > 0) & ~long_).tolist():  # fewer than ``words`` words each
        v = np.uint64(size[i])
        for x in h[ends[i] : ends[i + 1]]:
            v = _mixed(np.array([v]))[0] ^ x
        rows.append(np.array([i]))
        hashes.append(_mixed(np.array([v])))
    row, hash_ = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hash_, row))
    row, hash_ = row[order], hash_[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])
    return hash_[new], np.bincount(row[new], minlength=len(size))


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, set, fp, n, keys) of each row: name, fingerprint, size and smallest hashes of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            h, n = shingle_sets(chunk.column(1), words)
            start = np.cumsum(n) - n
            votes = np.zeros((len(n), 64), np.int64)
            for i in range(0, len(h), 40_000):
                part = h[i : i + 40_000]
                bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = np.searchsorted(start, i, side="right") - 1
                last = np.searchsorted(start, i + len(part), side="left")
                votes[first:last] += np.add.reduceat(bits, np.maximum(start[first:last] - i, 0), axis=0, dtype=np.int64)
            fp = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8").ravel().view(np.int64)
            few = np.minimum(n, KEYS)
            keys = h[np.repeat(start - (np.cumsum(few) - few), few) + np.arange(int(few.sum()))].view(np.int64)
            names = [xxhash.xxh128_digest(h[a : a + k].tobytes()) for a, k in zip(start.tolist(), n.tolist())]
            yield pa.record_batch(
                [chunk.column(0), chunk.column(2), pa.array(names, pa.binary()), pa.array(fp), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(few))).astype(np.int32)), pa.array(keys))],
                names=["doc_id", "text_hash", "set", "fp", "n", "keys"],
            )

    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, set binary, fp long, n int, keys array<long>")


def _side(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join with texts that has ``rows`` rows of ids."""
    return F.broadcast(df) if rows <= SMALL_SIDE else df.hint("merge")


def texts_by_name(docs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, text) of each row of ``docs`` that ``wanted`` (columns, doc_id, text_hash) names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return rows.join(_side(wanted, wanted.count()), same).select(*columns, "text")


def shingles_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(form, shingles) for ``wanted`` (form, doc_id, text_hash): 32 bits of each hash of the text's shingle set, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            h, n = shingle_sets(chunk.column(1), words)
            short, start = (h >> np.uint64(32)).astype("<u4"), np.cumsum(n) - n
            blobs = [short[a : a + k].tobytes() for a, k in zip(start.tolist(), n.tolist())]
            yield pa.record_batch([chunk.column(0), pa.array(blobs, pa.binary())], names=["form", "shingles"])

    return texts_by_name(docs, wanted, ["form"]).mapInArrow(run, "form long, shingles binary").dropDuplicates(["form"])


def _may(fp: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, likeness: float) -> np.ndarray:
    """Whether pairs could be alike, by their fingerprints and sizes."""
    return (np.bitwise_count(fp[i] ^ fp[j]) <= NEAR_BITS) & (np.minimum(n[i], n[j]) >= likeness * np.maximum(n[i], n[j]))


def _groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs inside each group, of groups that stand one after the other."""
    starts, left, right = np.cumsum(sizes) - sizes, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(k, 1)
        at = starts[sizes == k][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _pair_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1), axis=0)
    return pa.record_batch([pa.array(np.ascontiguousarray(both[:, c])) for c in (0, 1)], names=["u", "v"])


def _walked(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of integers, cut where the first ``keys`` columns change: each group of rows comes whole, several together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
        # the last group may go on in the next batch
        last = len(columns[0]) - int(np.argmax(np.any([c[::-1] != c[-1] for c in columns[:keys]], axis=0)))
        if all((c == c[-1]).all() for c in columns[:keys]):
            last = 0
        if last or (held and any(held[0][c][0] != columns[c][0] for c in range(keys))):
            held.append([c[:last] for c in columns])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _sizes(*keys: np.ndarray) -> np.ndarray:
    """How long each run of equal keys is."""
    cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
    return np.diff(np.concatenate(([0], cut, [len(keys[0])])))


def cold_candidates(keyed: DataFrame, likeness: float) -> DataFrame:
    """(u, v): all pairs of forms that share a key, of ``keyed`` (key, form, fp, n) with few forms to a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, form, fp, n in _walked(batches, 1):
            i, j = _groups(_sizes(key))
            ok = _may(fp.view(np.uint64), n, i, j, likeness)
            yield _pair_batch(form[i[ok]], form[j[ok]])

    return keyed.select("key", "form", "fp", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def hot_candidates(keyed: DataFrame, likeness: float) -> DataFrame:
    """(u, v): of ``keyed`` (key, form, fp, n) with many forms to a key, each with its nearest and the first of its block, and blocks' firsts with the key's first.

    Not all pairs that could be alike: ``rare_candidates`` and ``hot_links`` have the rest.
    """
    turned = F.expr("shiftleft(fp, cast(pmod(key, 64) as int)) | shiftrightunsigned(fp, 64 - cast(pmod(key, 64) as int))")
    placed = with_ordinals(keyed.select("key", "form", "fp", "n", turned.alias("turned")), ["key"], ["turned", "form"], "place", written)
    placed = placed.select("key", F.floor(F.col("place") / BLOCK).alias("block"), "place", "form", "fp", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, _, form, fp, n in _walked(batches, 2):
            at, fp = 0, fp.view(np.uint64)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in _sizes(key, block).tolist():
                some = np.arange(at, at + k)
                left.append(some[1:])
                right.append(np.full(k - 1, at))
                for b in range(1, k, 512):
                    rows = some[b : b + 512]
                    apart = np.bitwise_count(fp[rows][:, None] ^ fp[some[: b + len(rows)]][None, :]).astype(np.int16)
                    apart[np.arange(len(rows))[:, None] + b <= np.arange(b + len(rows))[None, :]] = 99
                    left.append(rows)
                    right.append(some[apart.argmin(axis=1)])
                at += k
            i, j = np.concatenate(left), np.concatenate(right)
            ok = _may(fp, n, i, j, likeness)
            yield _pair_batch(form[i[ok]], form[j[ok]])

    near = placed.repartition("key", "block").sortWithinPartitions("key", "block", "place").mapInArrow(run, "u long, v long")
    first = placed.filter("place = 0").select("key", F.col("form").alias("u"))
    firsts = placed.filter(f"place % {BLOCK} = 0").join(first, "key").filter("form <> u").select(F.least("u", "form").alias("u"), F.greatest("u", "form").alias("v"))
    return near.unionByName(firsts)


_HOT = -1
#: What a part gets of each form that has shingles in it; ``behind`` is how far its class's name is below its own.
_FORM = np.dtype([("form", "<i8"), ("fp", "<i8"), ("n", "<u4"), ("behind", "<i8"), ("shingles", "<u4")])


def rare_candidates(texts: DataFrame, words: int, likeness: float, parts: int | None = None) -> DataFrame:
    """(u, v): pairs of ``texts`` (form, fp, comp, text) of different ``comp`` that share a shingle which at most ``SMALL_GROUP`` of them have."""
    return rare_shingles(texts, words, likeness, parts).filter("rare = 0").select("u", "v")


def rare_shingles(texts: DataFrame, words: int, likeness: float, parts: int | None = None) -> DataFrame:
    """(u, v, rare): the pairs of ``rare_candidates`` with ``rare`` 0 and, as ``u`` = ``v``, how many such shingles a form has in a part of the hashes.

    A task sends each part of the shingles' hashes one blob for a chunk of texts. Once a
    task has met a shingle more than ``SMALL_GROUP`` times it sends a mark in its place, so
    a shingle of all texts costs each task ``SMALL_GROUP`` entries.
    """
    parts = parts or 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = SMALL_GROUP

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(0, np.uint64)  # shingles that this task knows to be hot
        for chunk in text_chunks(batches):
            chunk = chunk.take(pa.array(np.unique(chunk.column(0).to_numpy(zero_copy_only=False), return_index=True)[1]))  # a repeated row is one form
            h, n = shingle_sets(chunk.column(2), words)
            row = np.repeat(np.arange(len(n)), n)
            stay = ~np.isin(h, often, assume_unique=False)
            h, row = h[stay], row[stay]
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            if len(h):
                size = _sizes(h)
                hot = np.repeat(size > few, size)
                first = np.concatenate(([True], h[1:] != h[:-1]))
                often = np.union1d(often, h[hot & first])[-KNOWN_HOT:]
                local = np.where(hot, _HOT, row)
                keep = ~hot | first
                h, local = h[keep], local[keep]
            form, fp, comp = (chunk.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 3))
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((local, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[p] : cuts[p + 1]]
                mine, shingles = np.unique(local[at], return_counts=True)
                table = np.zeros(len(mine), _FORM)
                for c, x in zip(_FORM.names, (form, fp, n, comp - form)):
                    table[c] = np.where(mine < 0, _HOT if c == "form" else 0, x[mine])
                table["shingles"] = shingles
                # bytes of one place stand together, which compresses; a part and 32 more bits name
                # a shingle: what they confuse is compared as a candidate, no more
                planes = np.ascontiguousarray(table.view(np.uint8).reshape(-1, _FORM.itemsize).T)
                out.append((p, len(mine), planes.tobytes(), (h[at] >> np.uint64(32)).astype("<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "n", "forms", "shingles"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def pairs() -> pa.RecordBatch:
            h, form, fp, n, behind = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((form, h))
            h, form, fp, n, comp = h[order], form[order], fp[order], n[order], (form + behind)[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (form[1:] != form[:-1])))
            h, form, fp, n, comp = h[once], form[once], fp[once], n[once], comp[once]
            size = _sizes(h)
            size_at, hot = np.repeat(size, size), np.repeat(np.minimum.reduceat(form, np.cumsum(size) - size) == _HOT, size)
            cold = (size_at <= few) & ~hot
            own, rare = np.unique(form[cold], return_counts=True)
            ok = (size_at > 1) & cold
            h, form, fp, n, comp = h[ok], form[ok], fp[ok], n[ok], comp[ok]
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if len(h):
                size = _sizes(h)
                # a million pairs or so at a time
                cut = np.flatnonzero(np.diff(np.cumsum(size * (size - 1) // 2) // 1_000_000)) + 1
                ends = np.concatenate(([0], np.cumsum(size)))
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(size)]):
                    s = slice(int(ends[a]), int(ends[b]))
                    i, j = _groups(size[a:b])
                    good = comp[s][i] != comp[s][j]
                    i, j = i[good], j[good]
                    good = _may(fp[s].view(np.uint64), n[s], i, j, likeness)
                    both = np.unique(np.stack((form[s][i[good]], form[s][j[good]]), axis=1), axis=0)
                    u.append(both[:, 0])
                    v.append(both[:, 1])
            both = _pair_batch(np.concatenate(u), np.concatenate(v))
            ends = [np.concatenate((both.column(c).to_numpy(), own)) for c in (0, 1)]
            counts = np.concatenate((np.zeros(both.num_rows, np.int32), rare.astype(np.int32)))
            return pa.record_batch([pa.array(x) for x in (*ends, counts)], names=["u", "v", "rare"])

        for batch in batches:
            for part, n, forms, shingles in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held and part != now:
                    yield pairs()
                    held = []
                now = part
                table = np.ascontiguousarray(np.frombuffer(forms, np.uint8).reshape(-1, n).T).view(_FORM).ravel()
                held.append((np.frombuffer(shingles, "<u4"), *[np.repeat(table[c], table["shingles"]) for c in _FORM.names[:4]]))
        if held:
            yield pairs()

    sent = texts.select("form", "fp", "text", "comp").mapInArrow(send, "part int, n int, forms binary, shingles binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "u long, v long, rare int")


def _joined(form: np.ndarray, n: np.ndarray, hot: np.ndarray, comp: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, likeness: float) -> Iterator[tuple[int, int]]:
    """Links that join classes, of all pairs of ``left`` and ``right`` places; ``ids`` are the shingles of all places, end to end."""
    ends, same = np.cumsum(n), left is right
    label = np.unique(comp, return_inverse=True)[1]
    there = np.zeros(int(ids.max()) + 1, bool)
    own, to_right = ends[right] - n[right], np.cumsum(n[right]) - n[right]
    flat = np.concatenate([ids[a : a + k] for a, k in zip(own.tolist(), n[right].tolist())])
    for at, i in enumerate(left.tolist()):
        may = (label[right] != label[i]) & (np.minimum(n[right], n[i]) >= likeness * np.maximum(n[right], n[i]))
        may &= (1 + likeness) * np.minimum(hot[right], hot[i]) >= likeness * (n[right] + n[i]) - 1e-6
        if same:
            may[: at + 1] = False
        if not (some := np.flatnonzero(may)).size:
            continue
        mine = ids[ends[i] - n[i] : ends[i]]
        there[mine] = True
        if 4 * len(some) > len(right):
            shared = np.add.reduceat(there[flat], to_right, dtype=np.int64)[some]
        else:
            size = n[right[some]]
            begin = np.cumsum(size) - size
            shared = np.add.reduceat(there[flat[np.repeat(to_right[some] - begin, size) + np.arange(int(size.sum()))]], begin, dtype=np.int64)
        there[mine] = False
        for j in right[some[shared >= likeness * (n[i] + n[right[some]] - shared)]].tolist():
            if label[j] != label[i]:
                yield int(form[i]), int(form[j])
                label[label == label[j]] = label[i]


def hot_links(forms: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(u, v): links that join the classes of ``forms`` (form, n, hot, comp, shingles), of all pairs that share none but hot shingles, of which each has ``hot``.

    Forms are in order of their size, cut into blocks of a bounded number of shingles. Two
    blocks whose sizes allow a link and that are not of one class make a cell; each cell is
    compared in one task, which holds two blocks.
    """
    forms = forms.filter(F.col("hot") >= likeness * F.col("n") - 1e-6).withColumn("octave", F.floor(F.log2("n")))
    placed = with_ordinals(forms, ["octave"], ["n", "comp", "form"], "place", written)
    room = min(max((placed.agg(F.sum("n")).first()[0] or 0) // SPREAD, CELL[0]), CELL[1])
    block = F.floor(F.col("place") / F.greatest(F.lit(1), F.floor(F.lit(room) / F.pow(F.lit(2.0), F.col("octave") + 1))))
    placed = placed.withColumn("at", F.col("octave") * (1 << 40) + block)
    blocks = placed.groupBy("octave", "at").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    a, b = (blocks.select(*[F.col(c).alias(f"{x}_{c}") for c in blocks.columns]) for x in ("a", "b"))
    reach = int(-math.log2(likeness)) + 1
    near = a.withColumn("b_octave", F.explode(F.sequence(F.col("a_octave"), F.col("a_octave") + reach))).join(b, "b_octave")
    near = near.filter((F.col("a_at") <= F.col("b_at")) & (F.col("b_least") * likeness <= F.col("a_most") + 1e-6))
    near = near.filter((F.least("a_c0", "b_c0") != F.greatest("a_c1", "b_c1"))).select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))
    cells = written(near, "cells").select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            cell = pa.Table.from_batches(held).combine_chunks()
            a, b, at, form, n, hot, comp = (cell.column(c).to_numpy() for c in range(7))
            blobs = cell.column(7).to_pylist()
            ids = np.unique(np.frombuffer(b"".join(blobs), "<u4"), return_inverse=True)[1]
            left = np.flatnonzero(at == a[0])
            right = left if a[0] == b[0] else np.flatnonzero(at == b[0])
            found = np.array(list(_joined(form, n.astype(np.int64), hot, comp, ids, left, right, likeness)), np.int64).reshape(-1, 2)
            return _pair_batch(found[:, 0], found[:, 1])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, at = [batch.column(c).to_numpy() for c in (0, 1)], 0
            for size in _sizes(*keys).tolist():
                if held and any(held[0].column(c)[0].as_py() != keys[c][at] for c in (0, 1)):
                    yield links(held)
                    held = []
                held.append(batch.slice(at, size))
                at += size
        if held:
            yield links(held)

    dealt = placed.join(cells, "at").select("a", "b", "at", "form", "n", "hot", "comp", "shingles")
    return dealt.repartition("a", "b").sortWithinPartitions("a", "b", "at", "form").mapInArrow(run, "u long, v long")


def hot_keys(forms: DataFrame) -> DataFrame:
    """(key): keys of more than ``SMALL_GROUP`` forms."""
    keys = forms.select(F.explode("keys").alias("key"))
    return written(keys.groupBy("key").agg(F.count("*").alias("_m")).filter(f"_m > {SMALL_GROUP}").select("key"), "hot")


def candidates(forms: DataFrame, hot: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(u, v), u < v: forms (form, fp, n, keys) that share a key and could be alike; of ``hot`` keys, neighbours in blocks."""
    keyed = forms.select(F.explode("keys").alias("key"), "form", "fp", "n")
    found = cold_candidates(keyed.join(hot, "key", "left_anti"), likeness)
    if hot.take(1):
        found = found.unionByName(hot_candidates(keyed.join(hot, "key", "left_semi"), likeness))
    return found.filter("u <> v").distinct()


def alike(pairs: DataFrame, sets: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The ``pairs`` (u, v) of which the shingle sets ``sets`` (form, shingles) have a Jaccard likeness of at least ``likeness``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= likeness * (len(x) + len(y) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("form").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in ("u", "v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "shingles_u", "shingles_v").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, words: int = WORDS, likeness: float = LIKENESS) -> DataFrame:
    """(doc_id, text_hash, class_id) of each row: rows of one class are alike, or linked by rows that are."""
    made = [rows := Written(sketches(docs, words), "sketches")]

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(Written(df, name))
        return made[-1].df

    one = rows.df.groupBy("set").agg(*[F.any_value(c).alias(c) for c in ("fp", "n", "keys")], F.min(F.struct("doc_id", "text_hash")).alias("at"))
    forms = kept(one.select("*", F.monotonically_increasing_id().alias("form")), "forms")
    # forms of one fingerprint are candidates too, and stand for it where anchors link it
    by_fp = kept(forms.groupBy("fp").agg(F.min("form").alias("first")), "by_fp")
    same = forms.join(by_fp, "fp").filter("form <> first").select(F.col("first").alias("u"), F.col("form").alias("v"))
    near = links(cover(by_fp)).join(by_fp.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(by_fp.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    anchored = near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    asked = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("form")).distinct()

    def named(some: DataFrame, name: str) -> DataFrame:
        return kept(forms.join(some, "form").select("form", "fp", "at.doc_id", "at.text_hash"), name)

    def settled(pairs: DataFrame, sets: DataFrame, linked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """``linked`` with those of ``pairs`` that join classes, and the classes: one pair of each form first, then what is still apart."""
        for again in (False, True):
            some = pairs if again else pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
            if again:  # pairs of one class say nothing new
                of = lambda c, name: label.select(F.col("node").alias(c), F.col("comp").alias(name))
                some = some.join(of("u", "cu"), "u", "left").join(of("v", "cv"), "v", "left").filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
            new = alike(some, sets, likeness)
            linked = kept(new if linked is None else linked.unionByName(new), "links")
            label = kept(components(linked), "components")
        return linked, label

    hot = hot_keys(forms)
    pairs = kept(candidates(forms, hot, likeness).unionByName(same).unionByName(anchored).distinct(), "candidates")
    first = named(asked(pairs), "wanted")
    sets = kept(shingles_of(docs, first, words), "sets")
    linked, label = settled(pairs, sets, None)
    if hot.take(1):
        # what the forms of hot keys share besides, between classes only
        many = named(forms.select("form", F.explode("keys").alias("key")).join(hot, "key", "left_semi").select("form").distinct(), "hot_forms")
        of_class = kept(many.join(label.withColumnRenamed("node", "form"), "form", "left").withColumn("comp", F.coalesce("comp", "form")), "hot_classes")
        shared = kept(rare_shingles(texts_by_name(docs, of_class, ["form", "fp", "comp"]), words, likeness), "shared")
        rare = kept(shared.filter("rare = 0").select("u", "v").distinct(), "rare")
        more = kept(shingles_of(docs, named(asked(rare).join(first, "form", "left_anti"), "wanted_too"), words), "sets")
        linked, label = settled(rare, sets.unionByName(more), linked)
        # and pairs that share nothing but hot shingles: of both most are hot
        counted = shared.filter("rare > 0").groupBy(F.col("u").alias("form")).agg(F.sum("rare").alias("rare"))
        mostly = many.select("form").join(forms.select("form", "n"), "form").join(counted, "form", "left").withColumn("hot", F.col("n") - F.coalesce("rare", F.lit(0)))
        mostly = mostly.filter(F.col("hot") >= likeness * F.col("n") - 1e-6).join(label.withColumnRenamed("node", "form"), "form", "left")
        mostly = kept(mostly.select("form", "n", "hot", F.coalesce("comp", "form").alias("comp")), "mostly_hot")
        new = hot_links(mostly.join(shingles_of(docs, named(mostly.select("form"), "wanted_hot"), words), "form"), likeness)
        linked = kept(linked.unionByName(new), "links")
        label = kept(components(linked), "components")
    classes = forms.select("set", "form").join(label.select(F.col("node").alias("form"), "comp"), "form", "left").select("set", F.coalesce("comp", "form").alias("class_id"))
    found = written(rows.df.select("doc_id", "text_hash", "set").join(classes, "set").select("doc_id", "text_hash", "class_id"), "classes")
    for x in made:
        x.drop()
    return found


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each class of ``found`` (doc_id, text_hash, class_id), by default its near copies.

    The row of smallest doc_id stays, of rows with equal ids one; rows with a null doc_id come last.
    """
    found = near_copies(docs) if found is None else found
    rows = written(found.groupBy("class_id", "doc_id", "text_hash").agg(F.count("*").alias("n")), "rows")
    first = rows.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("f")).select("f.*")
    mine = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.text_hash") == F.col("k.text_hash"))
    here = lambda df, name: written(df.select(F.col("r.doc_id").alias("gone_id"), F.col("r.text_hash").alias("gone_hash")), name)
    gone = here(rows.alias("r").join(first.alias("k"), mine, "left_anti"), "gone")
    twice = here(rows.filter("n > 1").alias("r").join(first.alias("k"), mine, "left_semi"), "twice")
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    stay = packed.join(_side(gone, gone.count()), same, "left_anti")
    if n := twice.count():
        side = _side(twice, n)
        stay = stay.join(side, same, "left_anti").unionByName(stay.join(side, same, "left_semi").dropDuplicates(["id", "hash"]))
    return stay.select("row.*")
