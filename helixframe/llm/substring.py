"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Text is a sequence of words. A window is ``window`` (13) consecutive words of one
document; it is a duplicate if a document of smaller id holds the same words somewhere.
A document is parsed greedily into factors: from its first duplicate window on, the
longest run of windows that stands as one piece in one earlier document, at one place;
then on from the next duplicate window, also where that window straddles the end of the
factor before. A factor covers window + run - 1 words and names its reference place.

The reference is the corpus itself, cut into blocks by content: each window belongs to
its anchor, the ``gram``-word sequence of smallest hash inside it, and the anchor's hash
names the reference block that indexes it. Equal windows have equal anchors, so every
earlier occurrence of a document's window is indexed in the one block that the window
goes to. A block sorts the window runs it indexes by content, as a suffix array does;
the longest earlier match of a run is the nearer of its two neighbours that stand in a
document of smaller id. Factors end at block boundaries, where neighbouring windows have
different anchors; the per-document step joins those that go on in the same reference.

A task parses against its own chunk first: windows found twice in the chunk are resolved
there, and of those only the smallest holder goes to the block. What was held twice
stays a reference for the task's later chunks. So a passage that a third of all
documents share sends an entry or so for each task to its block, not one for each
document. Blocks are walked one at a time, several to a shuffle partition.

A window is identified by its anchor's 64-bit hash and 48 bits of its own, 112 in all.
Two different windows can only be taken for one under one anchor: where 100,000 different
windows share an anchor, with a chance of 2 in 100,000.

Nulls, empty texts and texts shorter than a window have no factors. Rows with a null
doc_id have no place in the order: they index nothing and lose nothing. Rows of one
doc_id hold windows of the same document and are not duplicates of each other; each is
parsed by its own text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.batches import text_chunks, texts_of

WINDOW, GRAM = 13, 4
_MIX = 0x9E3779B97F4A7C15
FACTORS = "doc_id long, text_hash int, start int, length int, ref_id long, ref_start int"
#: Factors as they travel inside a task.
_FACTOR = np.dtype([("doc", "<i8"), ("hash", "<i4"), ("start", "<i4"), ("length", "<i4"), ("ref", "<i8"), ("ref_start", "<i4")])
#: Reference windows that a task keeps from chunk to chunk, about.
KEPT = 200_000
#: Blocks of one shuffle partition, walked one after the other.
BLOCKS_EACH = 2


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts end to end, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = cut.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
    return flat.filter(there), np.diff(ends)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive elements."""
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= np.uint64(_MIX | 1)
        out += h[j : j + m]
    return _mixed(out)


def _smallest(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum over every n consecutive elements."""
    done, out = 1, h
    while done * 2 <= n:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    if done < n:
        m = len(h) - n + 1
        out = np.minimum(out[:m], out[n - done : n - done + m])
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, 9) for w in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)


def windows_of(h: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, window hash, anchor) of every window inside the texts whose words' hashes are laid end to end."""
    if len(h) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(h) - window + 1]
    pos = np.arange(len(row)) - starts[row]
    ok = pos <= sizes[row] - window
    grams = _rolling(h, gram)
    return row[ok], pos[ok], _rolling(h, window)[ok], _smallest(grams, window - gram + 1)[ok]


# --- the parse of one block -----------------------------------------------------------


def _held_twice(own: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that several documents hold: (their places, a number for each content, whether the document is the smallest)."""
    order = np.argsort(own)
    new = np.ones(len(order), bool)
    new[1:] = (own[order[1:]] != own[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]])
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    group = np.cumsum(new) - 1
    d = doc[order]
    low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
    twice = (low != high)[group]
    at, group = order[twice], group[twice]
    back = np.argsort(at)
    return at[back], group[back], (doc[at] == low[group])[back]


def _ranks(content: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... windows of what is left of each run, until all of it is told apart."""
    n = len(content)
    levels = [np.unique(content, return_inverse=True)[1]]
    while (step := 1 << (len(levels) - 1)) < left.max():
        now = levels[-1]
        after = np.full(n, -1, np.int64)
        go = np.flatnonzero(left > step)
        after[go] = now[go + step]
        levels.append(np.unique(now * (n + 1) + after + 1, return_inverse=True)[1])
        if levels[-1].max() == now.max():
            break
    return levels


def _shared(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """How many windows a and b have in common from their starts on."""
    out = np.where(levels[-1][a] == levels[-1][b], left[a], 0)
    go = np.flatnonzero(out == 0)
    x, y, done = a[go], b[go], np.zeros(len(go), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        inside = (done < left[x]) & (done < left[y])
        i, j = (x + done)[inside], (y + done)[inside]
        same = levels[k][i] == levels[k][j]
        # equal ranks of runs that end early are equal to their ends
        done[np.flatnonzero(inside)[same]] += np.minimum(1 << k, left[i])[same]
    out[go] = done
    return out


def _nearest_smaller(doc: list[int], shared: list[int]) -> tuple[list[int], list[int]]:
    """For each run in sorted order, the nearest one before it of a smaller document: (windows in common, its place)."""
    size, place = [0] * len(doc), [-1] * len(doc)
    docs, common, at = [], [], []  # of the open runs: document, windows in common with the one below, place
    for i, d in enumerate(doc):
        c = shared[i - 1] if i else 0
        if not c:
            docs.clear()
            common.clear()
            at.clear()
        while docs and docs[-1] >= d:
            c = min(c, common.pop())
            docs.pop()
            at.pop()
        if docs:
            size[i], place[i] = c, at[-1]
        docs.append(d)
        common.append(c)
        at.append(i)
    return size, place


def parse(row: np.ndarray, pos: np.ndarray, doc: np.ndarray, content: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Greedy factors of the windows of one block that several documents hold.

    ``row`` tells texts apart, ``doc`` is their place in the order of documents and
    ``content`` a number for each window's words. Returns the place of each factor's first
    window, how many words it covers, and the place of its reference's first window.
    """
    empty = (np.zeros(0, np.int64),) * 3
    if not len(row):
        return empty
    order = np.lexsort((pos, row))
    row, pos, doc, content = row[order], pos[order], doc[order], content[order]
    n = len(row)
    cut = np.ones(n, bool)
    cut[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(cut)
    stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    left = stop - np.arange(n)
    levels = _ranks(content, left)
    by = np.lexsort((doc, levels[-1]))
    common = _shared(by[:-1], by[1:], levels, left).tolist()
    d = doc[by].tolist()
    up, up_at = (np.array(x, np.int64) for x in _nearest_smaller(d, common))
    down, down_at = (np.array(x, np.int64)[::-1] for x in _nearest_smaller(d[::-1], common[::-1]))
    down_at = np.where(down_at >= 0, n - 1 - down_at, -1)
    d = doc[by]
    other = (down > up) | ((down == up) & (down > 0) & (d[down_at] < d[up_at]))
    longest, ref = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest[by], ref[by] = np.where(other, down, up), by[np.where(other, down_at, up_at)]
    # greedy: the longest match of the first window that has one, then on behind it
    nxt = np.where(longest > 0, np.arange(n), n)
    nxt = np.append(np.minimum.accumulate(nxt[::-1])[::-1], n)
    found = []
    at, until = nxt[first], stop[first]
    while True:
        ok = at < until
        at, until = at[ok], until[ok]
        if not len(at):
            break
        found.append(at)
        at = nxt[at + longest[at]]
    if not found:
        return empty
    at = np.concatenate(found)
    return order[at], longest[at] + window - 1, order[ref[at]]


# --- chunks -----------------------------------------------------------------------------


class _References:
    """Windows that several documents of a task hold, at the smallest: references for its later chunks."""

    def __init__(self, most: int = KEPT):
        self.most, self.chunk = most, 0
        self.row, self.pos, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.own, self.anchor = (np.zeros(0, np.uint64) for _ in range(2))

    def keep(self, row, pos, doc, own, anchor) -> None:
        """The newest replace the oldest. Rows of earlier chunks have negative numbers of their own."""
        self.chunk += 1
        new = -1 - (row + (self.chunk << 32))
        new = np.where(row < 0, row, new)
        self.row, self.pos, self.doc, self.own, self.anchor = (x[-self.most :] for x in (new, pos, doc, own, anchor))


def _pieces(batches: Iterator[pa.RecordBatch], parts: int, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and block one row: what the chunk has for the block, or factors found in the chunk itself (block -1)."""
    blocks, refs = parts * BLOCKS_EACH, _References()
    for chunk in text_chunks(batches):
        there = chunk.filter(chunk.column(0).is_valid())
        words, sizes = cut_words(there.column(1))
        row, pos, own, anchor = windows_of(word_hashes(words), sizes, window, gram)
        del words
        if not len(row):
            continue
        ids = np.stack([there.column(c).to_numpy(zero_copy_only=False) for c in (0, 2)], axis=1).astype("<i8")
        old = len(refs.row)
        all_row, all_pos = np.concatenate((refs.row, row)), np.concatenate((refs.pos, pos))
        all_doc = np.concatenate((refs.doc, ids[row, 0]))
        all_own, all_anchor = np.concatenate((refs.own, own)), np.concatenate((refs.anchor, anchor))
        at, content, smallest = _held_twice(all_own, all_anchor, all_doc)
        first, length, ref = parse(all_row[at], all_pos[at], all_doc[at], content, window)
        own_factor = all_row[at[first]] >= 0
        first, length, ref = at[first[own_factor]], length[own_factor], at[ref[own_factor]]
        if len(first):
            found = np.empty(len(first), _FACTOR)
            r = all_row[first]
            found["doc"], found["hash"], found["start"], found["length"] = ids[r, 0], ids[r, 1], all_pos[first], length
            found["ref"], found["ref_start"] = all_doc[ref], all_pos[ref]
            yield _local(found, parts)
        keep = np.ones(len(row), bool)
        keep[at[~smallest & (at >= old)] - old] = False
        held = at[smallest]
        refs.keep(all_row[held], all_pos[held], all_doc[held], all_own[held], all_anchor[held])
        # what an earlier chunk of the task has sent needs no second entry
        keep[held[held >= old] - old] = True
        row, pos, own, anchor = row[keep], pos[keep], own[keep], anchor[keep]
        block = (_mixed(anchor) % np.uint64(blocks)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        yield _entries(block[by], row[by], pos[by], own[by], anchor[by], ids)


def _local(found: np.ndarray, parts: int) -> pa.RecordBatch:
    """Factors found in a chunk, dealt out by document."""
    part = found["doc"] % parts
    by = np.argsort(part, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part[by])) + 1, [len(by)]))
    payload = [found[by[a:b]].tobytes() for a, b in zip(cut, cut[1:])]
    n = len(payload)
    return pa.record_batch([pa.array(part[by[cut[:-1]]].astype(np.int32)), pa.array(np.full(n, -1, np.int32)), pa.array([b""] * n, pa.binary()), pa.array(payload, pa.binary())], names=["part", "block", "docs", "payload"])


def _entries(block: np.ndarray, row: np.ndarray, pos: np.ndarray, own: np.ndarray, anchor: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(part, block, docs, payload) for each block that the sorted windows go to."""
    cut = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
    docs, payload = [], []
    for a, b in zip(cut, cut[1:]):
        used, local = np.unique(row[a:b], return_inverse=True)
        docs.append(ids[used, 0].tobytes() + ids[used, 1].astype("<i4").tobytes())
        payload.append(_packed(anchor[a:b], own[a:b], pos[a:b], local))
    of = block[cut[:-1]] if len(block) else block
    return pa.record_batch(
        [pa.array((of // BLOCKS_EACH).astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(docs[: len(of)], pa.binary()), pa.array(payload[: len(of)], pa.binary())], names=["part", "block", "docs", "payload"]
    )


def _narrow(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest of them, after a byte that says how many."""
    width = next(w for w in (1, 2, 4) if int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _widened(payload: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """``n`` counts that ``_narrow`` wrote at ``at``, and where they end."""
    width = payload[at]
    return np.frombuffer(payload, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + width * n


def _packed(anchor: np.ndarray, own: np.ndarray, pos: np.ndarray, local: np.ndarray) -> bytes:
    """Windows in columns, sorted by text; consecutive windows of one anchor share its hash and place."""
    if not len(own):
        return b""
    run = np.ones(len(own), bool)
    run[1:] = (anchor[1:] != anchor[:-1]) | (local[1:] != local[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(run)
    count = np.diff(np.concatenate((first, [len(own)])))
    head = np.array([len(first), len(own)], "<u4")
    return b"".join((head.tobytes(), anchor[first].astype("<u8").tobytes(), own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes(), _narrow(pos[first]), _narrow(np.bincount(local[first])), _narrow(count)))


def _unpacked(docs: bytes, payload: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, 48 bits of the own hash, text among ``docs``, position) of each window of a row, and the texts' (doc_id, hash)."""
    n, m = np.frombuffer(payload, "<u4", 2).tolist()
    k = len(docs) // 12
    ids = np.stack((np.frombuffer(docs, "<i8", k), np.frombuffer(docs, "<i4", k, 8 * k)), axis=1)
    anchor = np.frombuffer(payload, "<u8", n, 8)
    own = np.zeros((m, 8), np.uint8)
    own[:, 2:] = np.frombuffer(payload, np.uint8, 6 * m, 8 + 8 * n).reshape(-1, 6)
    own = own.view("<u8").ravel()
    pos, at = _widened(payload, n, 8 + 8 * n + 6 * m)
    runs_of, at = _widened(payload, len(ids), at)
    count, _ = _widened(payload, n, at)
    step = np.arange(m) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(anchor, count), own, np.repeat(np.repeat(np.arange(len(ids)), runs_of), count), np.repeat(pos, count) + step, ids


def _parsed(rows: list[tuple[bytes, bytes]], window: int) -> np.ndarray:
    """Factors of the texts routed to one reference block."""
    anchors, owns, texts, places, ids, base = [], [], [], [], [], 0
    for docs, payload in rows:
        a, o, t, p, i = _unpacked(docs, payload)
        anchors.append(a)
        owns.append(o)
        texts.append(t + base)
        places.append(p)
        ids.append(i)
        base += len(i)
    anchor, own, row, pos, ids = (np.concatenate(x) for x in (anchors, owns, texts, places, ids))
    doc = ids[row, 0]
    at, content, _ = _held_twice(own, anchor, doc)
    first, length, ref = parse(row[at], pos[at], doc[at], content, window)
    found = np.empty(len(first), _FACTOR)
    first, ref = at[first], at[ref]
    r = row[first]
    found["doc"], found["hash"], found["start"], found["length"] = ids[r, 0], ids[r, 1], pos[first], length
    found["ref"], found["ref_start"] = doc[ref], pos[ref]
    return found


def _factor_batch(found: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(found[c])) for c in _FACTOR.names], names=[f.split()[0] for f in FACTORS.split(", ")])


def _parse_blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; each block is parsed when its last row is there."""
    rows, now = [], None
    for batch in batches:
        for block, docs, payload in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "docs", "payload"))):
            if block < 0:
                yield _factor_batch(np.frombuffer(payload, _FACTOR))
                continue
            if block != now:
                if rows:
                    yield _factor_batch(_parsed(rows, window))
                rows, now = [], block
            rows.append((docs, payload))
    if rows:
        yield _factor_batch(_parsed(rows, window))


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None) -> DataFrame:
    """(doc_id, text_hash, start, length, ref_id, ref_start): word spans of each document, and where an earlier document holds each.

    ``start``, ``length`` and ``ref_start`` count words. Each factor comes from one block;
    those of a document can touch or overlap, and their union is exactly the words to
    remove. ``text_hash`` tells texts that share a doc_id apart. ``blocks`` is the number
    of shuffle partitions that blocks are dealt to, by default 4 for each of the session's.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    n = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("text_hash"))
    pieces = rows.mapInArrow(lambda it: _pieces(it, n, window, gram), "part int, block int, docs binary, payload binary")
    return pieces.repartitionById(n, F.col("part")).sortWithinPartitions("block").mapInArrow(lambda it: _parse_blocks(it, window), FACTORS)


def joined(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, ref_id, ref_start) of one document; those that go on in the same reference are one."""
    out: list[tuple[int, int, int, int]] = []
    open_: dict[tuple[int, int], int] = {}
    for start, length, ref, at in sorted(found):
        k = open_.get((ref, at - start))
        if k is not None and out[k][0] + out[k][1] >= start:
            a = out[k]
            out[k] = (a[0], max(a[1], start + length - a[0]), a[2], a[3])
        else:
            open_[ref, at - start] = len(out)
            out.append((start, length, ref, at))
    return out


def covered(sizes: np.ndarray, found: list[list[tuple[int, int, int, int]]]) -> np.ndarray:
    """Which words of the texts, laid end to end, lie in a factor."""
    steps = np.zeros(int(sizes.sum()) + 1, np.int64)
    starts = (np.cumsum(sizes) - sizes).tolist()
    for base, n, some in zip(starts, sizes.tolist(), found):
        for start, length, *_ in joined(some):
            steps[base + start] += 1
            steps[base + min(start + length, n)] -= 1
    return np.cumsum(steps)[:-1] > 0


def without_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's words left after removal, joined by one space."""
    spans = factors(docs, window, gram, blocks).groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start", "length", "ref_id", "ref_start")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("text_hash"))
    both = rows.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words, sizes = cut_words(chunk.column(1))
            found = [[tuple(x.values()) for x in some or ()] for some in chunk.column(2).to_pylist()]
            left = ~covered(sizes, found)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            n_left = np.concatenate(([0], np.cumsum(left)))[ends]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(n_left.astype(np.int32)), words.filter(pa.array(left))), " ")
            yield pa.record_batch([chunk.column(0), pa.array(sizes), pa.array(sizes - np.diff(n_left)), kept], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
