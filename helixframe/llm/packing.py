"""Best-fit packing by a configuration linear program over the length histogram.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. How pieces
share sequences depends on their lengths alone, so the plan is made from the exact
histogram, which has at most ``capacity`` rows whatever the corpus: the only thing the
driver ever sees. Lengths above a small part of the capacity are grouped into classes
(linear grouping) that stand for lengths around their means, and the covering program over
configurations of classes is solved by multiplicative weights: each round prices classes,
a knapsack dynamic program finds the dearest configuration, and the prices of what it
covers fall. The fractional amounts are rounded; each configuration's last two pieces are
chosen so that they fill the sequence. What is left, some pieces in a hundred and the
smallest, is placed best-fit decreasing into what is open, counted in groups of equal
sequences.

The plan names, for each length, ranges of ranks and the sequences they fill. Ranks come
from counting within (length, salt): a hot length is spread over as many salts as its
count needs, so no window holds more than ``rank_block`` rows or so (by default a quarter
of a shuffle partition's share). Salts and ranks go by a number that each written piece
has of its own, so neither null nor repeated doc_ids make a group hot or leave a tie.

Null text is an empty document: one piece with only the closing id. Repeated rows are
packed as often as they occur. Rows with a null doc_id are packed too. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helixframe.llm.batches import text_chunks, texts_of
from helixframe.llm.storage import written
from helixframe.llm.tokens import ENCODED_BYTES, TOKENIZER, WordEncoder, spread

CAPACITY = 2048


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids, the closing id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer)  # what it remembers goes with the task
        for chunk in text_chunks(batches, most=ENCODED_BYTES):
            found = encode.ids(chunk.column(1))
            # each document's ids and its closing id, end to end
            size = found.count + 1
            body = np.full(int(size.sum()), end_id, "<u4")
            base = np.cumsum(size) - size
            body[spread(base, found.count)] = found.ids
            times = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), times)
            piece = spread(np.zeros(len(size), np.int64), times)
            length = np.minimum(capacity, size[row] - piece * capacity)
            at = base[row] + piece * capacity
            raw = memoryview(body).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            columns = [chunk.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(body.astype(np.int32))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest configuration: class -> copies, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int32)
    for k, s in enumerate(sizes):
        for _ in range(capacity // s):
            more = best[: capacity + 1 - s] + prices[k]
            better = more > best[s:] + 1e-15
            if not better.any():
                break
            best[s:][better] = more[better]
            took[s:][better] = k
    out: dict[int, int] = defaultdict(int)
    c = int(np.argmax(best))
    # walk back along choices; a cell's choice may have been refined later, which keeps it feasible
    while c > 0 and took[c] >= 0:
        out[int(took[c])] += 1
        c -= sizes[int(took[c])]
    return dict(out)


def _classes(counts: dict[int, int], smallest: int, n: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded-up size, [[length, count], ...] longest first) of about equal counts."""
    items = [[k, c] for k, c in sorted(counts.items(), reverse=True) if k >= smallest and c]
    total = sum(c for _, c in items)
    out, room = [], 0
    for k, c in items:
        if room <= 0:
            out.append((k, []))
            room = -(-total // n)
        out[-1][1].append([k, c])
        room -= c
    return out


def _epoch(sizes: list[int], demand: np.ndarray, capacity: int, start: np.ndarray, rate: float, sharp: float) -> tuple[dict[tuple, float], np.ndarray, float]:
    """One covering of ``demand`` from prices ``start``: amounts of configurations, when each class was covered, and a lower bound of the program."""
    left, weight, bound, spent = demand.copy(), start / start.sum(), 0.0, 0.0
    amount: dict[tuple, float] = defaultdict(float)
    done = np.zeros(len(sizes))
    while len(live := np.flatnonzero(left > 1e-9 * demand)):
        config = _knapsack([sizes[k] for k in live], weight[live], capacity)
        config = {int(live[k]): a for k, a in config.items()}
        bound = max(bound, float(weight[live] @ demand[live]) / sum(weight[k] * a for k, a in config.items()))
        step = min(min(left[k], rate * demand[k]) / a for k, a in config.items())
        amount[tuple(sorted(config.items()))] += step
        spent += step
        for k, a in config.items():
            left[k] -= a * step
            weight[k] *= np.exp(-sharp * a * step / demand[k])
            done[k] = spent
        weight /= weight.sum()
    return amount, done / spent, bound


def solve_configurations(sizes: list[int], demand: np.ndarray, capacity: int, rate: float = 0.05, sharp: float = 6.0, epochs: int = 12) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Fractional numbers of configurations that cover ``demand`` and no more, by multiplicative weights; and a lower bound of the program.

    Prices start in proportion to size, which is what the volume bound charges. A round
    adds the dearest configuration, at most ``rate`` of its scarcest class's demand, and
    lowers the prices of what it covers by a factor that grows with the share covered, so
    all classes run out together. A class that is covered leaves the program. In the next
    of the ``epochs`` classes that were covered late start dearer; the covering of fewest
    sequences counts. Any prices bound the program from below: the demand's price over
    the dearest configuration's.
    """
    demand = np.array(demand, float)
    start, bound, best = np.array(sizes, float) / capacity, 0.0, None
    for i in range(epochs):
        amount, done, low = _epoch(sizes, demand, capacity, start, rate, sharp)
        bound = max(bound, low)
        if best is None or sum(amount.values()) < sum(best.values()):
            best = amount
        if sum(best.values()) <= 1.01 * bound:
            break
        start = start * np.exp((done - done.mean()) / (1 + i) ** 0.5)
    return [(dict(c), x) for c, x in best.items()], bound


class _Open:
    """Groups of equal sequences: what they hold, how many they are, what room is left."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)

    def add(self, held: list[tuple[int, int]], times: int) -> None:
        room = self.capacity - sum(k * c for k, c in held)
        self.by_room[room].append((held, times))

    def place(self, length: int, count: int) -> None:
        """Best fit: the fullest sequences with room take as many as they can."""
        for room in sorted(r for r in self.by_room if r >= length):
            groups = self.by_room.pop(room)
            while groups and count:
                held, times = groups.pop()
                each = min(room // length, max(1, count // times))
                use = min(times, count // each)
                self.add([*held, (length, each)], use)
                count -= each * use
                if use < times:
                    groups.append((held, times - use))
            if groups:
                self.by_room[room].extend(groups)
            if not count:
                return
        each = self.capacity // length
        if count >= each:
            self.add([(length, each)], count // each)
        if count % each:
            self.add([(length, count % each)], 1)

    def groups(self) -> list[tuple[list[tuple[int, int]], int]]:
        return [g for room in sorted(self.by_room) for g in self.by_room[room]]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY, start: _Open | None = None) -> list[tuple[list[tuple[int, int]], int]]:
    state = start or _Open(capacity)
    for k in sorted(counts, reverse=True):
        if counts[k]:
            state.place(k, counts[k])
    return state.groups()


def _rounded(left: dict[int, int], groups: list[list[int]], solved: list[tuple[dict[int, int], float]], state: _Open, capacity: int) -> None:
    """Whole numbers of the configurations, put into ``state`` and taken off ``left``.

    A class stands for lengths around its mean. Of its classes but the last two the
    longest pieces are taken; the last two are two lengths that fill the sequence, the
    first of its class or near it and the other of any, or else come as close as they can.
    All sequences that can be made of the same lengths are made at once, so a step uses up
    a length or a configuration and their number doesn't grow with the counts.
    """
    every = sorted(k for k in left if k < capacity)

    def longest(most: int, used: Counter, lengths: list[int] = every) -> int | None:
        return next((k for k in reversed(lengths[: bisect_right(lengths, most)]) if left[k] > used[k]), None)

    def two(first: list[int], room: int, used: Counter) -> tuple[int, int] | None:
        best = None
        for a in reversed(first):
            if left[a] <= used[a] or a >= room:
                continue
            b = longest(room - a, used + Counter([a]))
            if b is not None and (best is None or a + b > sum(best)):
                best = a, b
                if a + b == room:
                    break
        return best

    for config, amount in solved:
        times = int(round(amount))
        order = sorted((k for k, copies in config.items() for _ in range(copies)), key=lambda k: -groups[k][-1])
        while times:
            used: Counter = Counter()
            for k in order[:-2] if len(order) > 1 else order:
                room = capacity - sum(c * n for c, n in used.items())
                found = longest(room, used, groups[k]) or longest(min(room, groups[k][-1]), used)
                used[found or 0] += 1
            if len(order) > 1:
                room = capacity - sum(c * n for c, n in used.items())
                pair = two(groups[order[-2]], room, used) or two(every, room, used)
                used += Counter(pair or (0, 0))
            if used[0] or (len(order) > 1 and capacity - sum(c * n for c, n in used.items()) > capacity // 256):
                break  # what is left can't fill this configuration
            many = min(times, *(left[k] // c for k, c in used.items()))
            state.add(sorted(used.items(), reverse=True), many)
            for k, c in used.items():
                left[k] -= c * many
            times -= many


def plan_with_share(
    histogram: dict[int, int], capacity: int = CAPACITY, classes: int = 48, smallest: float = 1 / 32, share: float = 0.98
) -> tuple[list[tuple[list[tuple[int, int]], int]], int]:
    """The plan, and how many pieces its configurations place.

    Pieces of the whole capacity are a configuration of their own. ``share`` of the
    fractional amounts is rounded; the rest, and pieces below ``smallest`` of the
    capacity, fill what is open and then new sequences, best-fit decreasing.
    """
    left, state = {k: c for k, c in histogram.items() if c}, _Open(capacity)
    if left.get(capacity):
        state.add([(capacity, 1)], left.pop(capacity))
    grouped = _classes(left, max(1, int(smallest * capacity)), classes)
    if grouped:
        groups = [sorted(k for k, _ in g) for _, g in grouped]
        demand = np.array([sum(c for _, c in g) for _, g in grouped], float)
        sizes = [max(1, round(sum(k * c for k, c in g) / d)) for (_, g), d in zip(grouped, demand)]
        solved, _ = solve_configurations(sizes, demand, capacity)
        _rounded(left, groups, sorted(((c, share * x) for c, x in solved), key=lambda x: -x[1]), state, capacity)
    placed = sum(histogram.values()) - sum(left.values())
    return best_fit(left, capacity, state), placed


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = 48, smallest: float = 1 / 32) -> list[tuple[list[tuple[int, int]], int]]:
    """[(what each sequence holds, as (length, copies)), how many such sequences]."""
    return plan_with_share(histogram, capacity, classes, smallest)[0]


def _slots(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, copies, first sequence, offset of the first copy), by rank."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    base = 0
    for held, times in groups:
        at = 0
        for length, copies in held:
            out[length].append((used[length], copies, base, at))
            used[length] += copies * times
            at += copies * length
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, rank_block: int | None = None) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = written(parts.withColumn("_slot", F.monotonically_increasing_id()), "pieces")
    counted = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if not counted:
        return parts.drop("_slot").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    slots = _slots(plan(counted, capacity))
    # windows of about a quarter of a shuffle partition, whatever the lengths
    rank_block = rank_block or -(-sum(counted.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = {k: -(-n // rank_block) for k, n in counted.items()}
    salt_of = spark.createDataFrame([(k, n) for k, n in salts.items()], "length long, salts int")
    salted = parts.join(F.broadcast(salt_of), "length").withColumn("salt", F.pmod(F.xxhash64("_slot"), F.col("salts"))).drop("salts")
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    inside = Window.partitionBy("length", "salt").orderBy("_slot")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("rank0")).drop("salt", "rank0", "_slot")
    names = [c for c in ranked.columns if c != "rank"]
    fields = [ranked.schema[c] for c in names]
    shared = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                slot = table[int(k)]
                s = slot[np.searchsorted(slot[:, 0], rank[rows], side="right") - 1]
                own = rank[rows] - s[:, 0]
                sequence[rows], offset[rows] = s[:, 2] + own // s[:, 1], s[:, 3] + own % s[:, 1] * k
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(pieces(docs, capacity, tokenizer), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
