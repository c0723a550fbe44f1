"""Best-fit packing by linear grouping.

Token counts are whole numbers up to the sequence length, so the plan needs
only how many pieces there are of each length, a table of at most that many
rows however large the corpus. On it the driver

1. sorts the large lengths into groups of about equal cardinality and rounds
   each up to its group's largest;
2. optimises configurations (how many pieces of which group share a sequence)
   over these few sizes: a linear program solved by column generation, rounded
   down;
3. substitutes actual pieces for the rounded ones, longest first;
4. puts what is left, large and small, by best fit into the room that is left.

The plan is a short table of runs: "the pieces of this length with ranks r to
r + n go to sequences from b on, so many each, from this offset". Ranks are
counted in the tasks that cut the pieces; only counts per task and length are
added up across tasks, so no length is gathered anywhere.

Edge cases: a null or empty text is the end id alone, a piece of one token; a
document longer than a sequence is cut into pieces of exactly that size, the
first may be shorter; rows with equal ``doc_id`` are packed as separate
documents; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import slices, written
from cohortspark.llm.tokens import CACHED_UNITS, encoder, vocabulary

CAPACITY, END_ID = 2048, 0
GROUPS = 96
LARGE = 3  # lengths over capacity / LARGE are grouped
SLACK = 1 / 64  # room a configuration may leave; the pieces of others go to best fit
GAP = 1e-3  # the linear program ends this close to its optimum
BROADCAST_ROWS = 1_000_000  # of the table of counts per task and length, about 30 MB
PIECES = "part int, nth long, doc_id long, piece int, start long, length int, ids binary"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cached_units: int = CACHED_UNITS) -> DataFrame:
    """Pieces of every document, written once: task, rank among the task's pieces of that length, ids."""
    path = path or vocabulary()
    end = END_ID.to_bytes(4, "little")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, code = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path, cached_units).ids
        for some in slices(batches):
            coded = [code(t or "") for t in some.column(1).to_pylist()]
            ids = end.join(coded) + end
            tokens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4 + 1
            of, piece, start, length = cuts(tokens, capacity)
            order = np.argsort(length, kind="stable")
            sizes = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = seen[sizes] + np.arange(len(sizes)) - np.searchsorted(sizes, sizes)
            seen += np.bincount(length, minlength=capacity + 1)
            ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            cols = [pa.array(np.full(len(of), part, np.int32)), pa.array(nth), some.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(start), pa.array(length.astype(np.int32)), packed], names=NAMES)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(make, PIECES), "pieces", "snappy")


NAMES = [c.split()[0] for c in PIECES.split(", ")]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document of ``n`` tokens; only the first may be short of ``capacity``."""
    _, _, start, length = cuts(np.array([n]), capacity)
    return list(zip(start.tolist(), length.tolist()))


def cuts(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of so many tokens, one after another: (document, number, start, length) of each piece; only first ones may be short."""
    many = -(-tokens // capacity)
    of = np.repeat(np.arange(len(tokens)), many)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    first = tokens - (many - 1) * capacity
    start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
    return of, piece, start, np.where(piece == 0, first[of], capacity)


def grouped(lengths: list[int], counts: list[int], groups: int) -> list[list[int]]:
    """Ascending lengths in consecutive groups that hold about equally many pieces."""
    total, out, filled = sum(counts), [], 0
    for length, n in zip(lengths, counts):
        g = min(groups - 1, (filled + n // 2) * groups // total)
        if not out or out[-1][0] != g:
            out.append((g, []))
        out[-1][1].append(length)
        filled += n
    return [x for _, x in out]


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces of each size that fit together and are worth most (dynamic programme over their number)."""
    most = capacity // int(sizes.min())
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(most):
        now, pick = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            with_i = best[: capacity + 1 - s] + worth[i]
            better = with_i > now[s:] + 1e-12
            now[s:][better] = with_i[better]
            pick[s:][better] = i
        chosen.append(pick)
        best = now
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            pattern[pick[room]] += 1
            room -= sizes[pick[room]]
    return pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over few sizes and how often each is used: the linear optimum, rounded down."""
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(20 * len(sizes)):
        worth = np.linalg.solve(basis.T, np.ones(len(size)))
        pattern = _best_pattern(size, worth, capacity)
        if worth @ pattern <= 1 + GAP:
            break
        used, step = np.linalg.solve(basis, need), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    used = np.linalg.solve(basis, need)
    tight = size @ basis >= capacity * (1 - SLACK)
    return [(basis[:, j], int(x + 1e-9)) for j, x in enumerate(used) if x >= 1 - 1e-9 and tight[j]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Runs (length, rank, n, sequence, per_sequence, offset) that place every piece, and the number of sequences."""
    runs, taken, sequences = [], defaultdict(int), 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, taken[length], n, first, each, offset))
        taken[length] += n

    large = sorted(x for x in histogram if x > capacity // LARGE)
    if large:
        parts = grouped(large, [histogram[x] for x in large], groups)
        queues = [deque((x, histogram[x]) for x in reversed(p)) for p in parts]
        left = [sum(n for _, n in q) for q in queues]
        for pattern, times in configurations([p[-1] for p in parts], left, capacity):
            open_bins = [(sequences, times, 0)]  # first, how many, filled
            sequences += times
            for g in np.repeat(np.arange(len(parts)), pattern.astype(int)):
                after = []
                for first, many, filled in open_bins:
                    while many and queues[g]:
                        length, n = queues[g].popleft()
                        k = min(n, many)
                        put(length, k, first, 1, filled)
                        after.append((first, k, filled + length))
                        first, many = first + k, many - k
                        if n > k:
                            queues[g].appendleft((length, n - k))
                    if many:
                        after.append((first, many, filled))
                open_bins = after
            for first, many, filled in open_bins:
                room[capacity - filled].append((first, many))
    rooms = sorted(room)
    for length in sorted(histogram, reverse=True):
        n = histogram[length] - taken[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                space, first, many = capacity, sequences, -(-n // each)
                sequences += many
            else:
                space = rooms[at]
                first, many = room[space].pop()
                if not room[space]:
                    rooms.pop(at)
            each = space // length
            full = min(many, n // each)
            rest = min(n - full * each, each - 1) if full < many else 0
            for some, k, start in ((full, each, first), (1 if rest else 0, rest, first + full)):
                if some:
                    put(length, some * k, start, k, capacity - space)
                    if space > k * length:
                        if not room[space - k * length]:
                            insort(rooms, space - k * length)
                        room[space - k * length].append((start, some))
            used = full + (1 if rest else 0)
            if used < many:
                if not room[space]:
                    insort(rooms, space)
                room[space].append((first + used, many - used))
            n -= full * each + rest
    return runs, sequences


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, cached_units: int = CACHED_UNITS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset.

    ``cached_units``: text units whose ids a Python worker keeps; fewer take less memory and more time.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, path, capacity, cached_units)
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity, groups)
    table = spark.createDataFrame(runs or [(0,) * 6], "length int, rank long, n long, first long, each long, base long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["part", "length"]).withColumn("at", F.col("before") + F.col("nth"))
    # the runs follow from the histogram: a few for each length, never the data's size
    near = F.broadcast(table.withColumnRenamed("length", "_length"))
    placed = ranked.join(near, (F.col("length") == F.col("_length")) & (F.col("at") >= F.col("rank")) & (F.col("at") < F.col("rank") + F.col("n")))
    k = F.col("at") - F.col("rank")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("first") + F.floor(k / F.col("each"))).alias("sequence_id"),
        (F.col("base") + k % F.col("each") * F.col("length")).alias("offset"),
    )
