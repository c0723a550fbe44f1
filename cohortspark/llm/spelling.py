"""Grouping of spelling variants through Bloom-guided edit neighbourhoods.

Words are near if one inserted, deleted or replaced letter makes one of the
other. Each pair is found from one side only: the longer word generates its
deletions, of two equally long words the one with the smaller letter generates
the replacement.

1. Words are counted in the tasks that read the texts, then across tasks.
2. A blocked Bloom filter is built for each length of word, in segments of
   64-bit blocks. Segments go to all tasks, at most ``ROUND_SEGMENTS`` (64 MB)
   at once; a larger vocabulary takes several rounds, each of which probes the
   edits that fall into its segments.
3. A word's edits are probed as hashes: the hash is a sum over (place, letter),
   so an edit's hash follows from the word's own by a subtraction and an
   addition. Only edits that the filter may hold become strings.
4. These are joined with the vocabulary, which removes false positives.
5. A word's form is its near word of largest count, if that is at least twice
   its own; roots are found by pointer doubling over the forms. Counts double
   along a chain, so chains are short.

Edge cases: null, empty and letterless texts hold no words; a null ``doc_id``
counts as an empty one; rows that repeat are counted each; runs of any length
are whole words; equal counts are ordered by code points; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import partitions, slices, utf8, written

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
RUN = re.compile("[a-z\u00C0-\u00FF]+")  # of a text whose A-Z are lowered: every letter is one byte of Latin-1
COUNTED = 200_000  # distinct words a task counts before it passes them on
BITS, PROBES = 16, 5  # bits of the filter for each word; bits set
SEGMENT = 1 << 16  # 64-bit blocks of a segment: 512 KB
ROUND_SEGMENTS = 128  # sent to all tasks at once
CELLS = 1 << 20  # edits probed in one step
EDITS = "edit string, word string, n long"


def runs(doc_id, text: bytes, every: int | None) -> Counter:
    """Counts of a text's words; with ``every`` a letter is deleted in the words of about one in so many (document, word)."""
    found = Counter(RUN.findall(text.lower().decode("utf-8", "replace")))
    if not every:
        return found
    out, start = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        out[word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]] += n
    return out


def word_counts(docs: DataFrame, every: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of enough letters and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for some in slices(batches):
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1)):
                for word, n in runs(doc_id, text.as_py(), every).items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > COUNTED:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    rows = docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cell(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to a word's hash."""
    return _mixed((place.astype(np.uint64) << np.uint64(8) | letter.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _letters(words: list[str]) -> np.ndarray:
    """Equally long words as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    size = np.array([len(w) for w in words], np.int64)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        step = max(1, min(8192, CELLS // int(length)))
        for k in range(0, len(at), step):
            yield int(length), at[k : k + step]


def blocks_of(count: int) -> int:
    """64-bit blocks of the filter for so many words."""
    return max(1, -(-count * BITS // 64))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, mask) of each hash."""
    x = _mixed(hashes)
    mask = np.zeros(len(x), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << (x >> np.uint64(6 * k) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mask


class Filters:
    """The segments of one round: length -> (blocks, first place of each segment or -1, the segments' blocks)."""

    def __init__(self, sizes: dict[int, int], segments: list[tuple[int, int, bytes]], segment: int):
        self.segment = segment
        self.of: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for length in {s[0] for s in segments}:
            blocks = blocks_of(sizes[length])
            where, held = np.full(-(-blocks // segment), -1, np.int64), []
            for k, (_, number, data) in enumerate(s for s in segments if s[0] == length):
                where[number] = k * segment
                held.append(np.frombuffer(data, "<u8"))
            self.of[length] = blocks, where, np.concatenate(held)

    def __contains__(self, length: int) -> bool:
        return length in self.of

    def may_hold(self, length: int, hashes: np.ndarray) -> np.ndarray:
        blocks, where, held = self.of[length]
        block, mask = _bits(hashes, blocks)
        first = where[block // self.segment]
        return (first >= 0) & (held[np.maximum(first, 0) + block % self.segment] & mask == mask)


def _edits(rows: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters of the edits that the filters may hold) of equally long words."""
    n, length = rows.shape
    place = np.arange(length)
    own = _cell(place[None, :], rows)
    total = own.sum(axis=1, dtype=np.uint64)
    if length in filters:
        step = max(1, CELLS // (n * len(alphabet)))
        for a in range(0, length, step):
            here = place[a : a + step]
            other = _cell(here[:, None], alphabet[None, :])
            row, at, letter = np.nonzero(alphabet[None, None, :] > rows[:, a : a + step, None])  # the smaller letter's word asks
            hit = filters.may_hold(length, total[row] - own[row, at + a] + other[at, letter])
            if hit.any():
                row, at, letter = row[hit], at[hit], letter[hit]
                out = rows[row].copy()
                out[np.arange(len(row)), at + a] = alphabet[letter]
                yield row, out
    if length - 1 in filters:
        before = np.cumsum(own, axis=1, dtype=np.uint64) - own
        moved = np.zeros_like(own)  # what the letters add one place earlier
        moved[:, 1:] = _cell(place[None, :-1], rows[:, 1:])
        after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        last = np.ones(rows.shape, bool)  # of a run of one letter: any deletion in it makes the same word
        last[:, :-1] = rows[:, 1:] != rows[:, :-1]
        row, at = np.nonzero(last)
        hit = filters.may_hold(length - 1, before[row, at] + after[row, at])
        for k in range(0, int(hit.sum()), max(1, CELLS // length)):
            r, x = row[hit][k : k + max(1, CELLS // length)], at[hit][k : k + max(1, CELLS // length)]
            yield r, rows[r][place[None, :] != x[:, None]].reshape(len(r), length - 1)


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n) to pairs (word, n, near, near_n) one edit apart, in both directions."""
    spark = words.sparkSession

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            seen.update(*b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in sorted(seen)], pa.int32())], names=["letter"])

    sizes = {r["length"]: r["n"] for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    alphabet = np.array(sorted(r[0] for r in words.select("word").mapInArrow(letters, "letter int").distinct().collect()), np.uint8)  # 90 at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_pylist()
            for length, at in _by_length(found):
                rows = _letters([found[k] for k in at])
                block, mask = _bits(_cell(np.arange(length)[None, :], rows).sum(axis=1, dtype=np.uint64), blocks_of(sizes[length]))
                cols = [pa.array(np.full(len(at), length, np.int32)), pa.array((block // SEGMENT).astype(np.int32))]
                cols += [pa.array((block % SEGMENT).astype(np.int32)), pa.array(mask.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["length", "segment", "block", "mask"])

    def build(rows: pa.Table) -> pa.Table:
        held = np.zeros(SEGMENT, np.uint64)
        np.bitwise_or.at(held, rows.column("block").to_numpy(), rows.column("mask").to_numpy().view(np.uint64))
        return pa.table([rows.column("length").slice(0, 1), rows.column("segment").slice(0, 1), pa.array([held.tobytes()], pa.binary())], names=["length", "segment", "data"])

    placed = words.select("word").mapInArrow(place, "length int, segment int, block int, mask long")
    built = written(placed.groupBy("length", "segment").applyInArrow(build, "length int, segment int, data binary"), "filters")
    order = [(length, s) for length in sorted(sizes) for s in range(-(-blocks_of(sizes[length]) // SEGMENT))]
    spread = words.repartition(partitions(spark))  # few bytes a word, much work
    found = None
    for k in range(0, len(order), ROUND_SEGMENTS):
        some = order[k : k + ROUND_SEGMENTS]
        bounds = F.struct("length", "segment").between(*(F.struct(F.lit(x[0]).alias("length"), F.lit(x[1]).alias("segment")) for x in (some[0], some[-1])))
        filters = spark.sparkContext.broadcast(Filters(sizes, [tuple(r) for r in built.where(bounds).collect()], SEGMENT))  # ROUND_SEGMENTS of 512 KB

        def probe(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).to_pylist()
                for length, at in _by_length(own):
                    if length not in filters.value and length - 1 not in filters.value:
                        continue
                    for row, made in _edits(_letters([own[i] for i in at]), alphabet, filters.value):
                        width = made.shape[1]
                        text = made.tobytes().decode("latin-1")
                        edit = pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string())
                        yield pa.RecordBatch.from_arrays([edit, *(b.column(c).take(pa.array(at[row])) for c in ("word", "n"))], names=["edit", "word", "n"])

        asked = spread.mapInArrow(probe, EDITS)
        found = asked if found is None else found.union(asked)
    if found is None:
        found = spark.createDataFrame([], EDITS)
    real = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    pairs = written(real, "near-words")
    there = pairs.select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    return there.union(pairs.select("edit", "edit_n", "word", "n"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n, each word once) to word, n, n_near, form, form_n, root."""
    words = written(words, "words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    each = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    named = words.join(each, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    named = named.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    named = written(named, "forms")
    at = named.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a root's count is at least twice its word's: chains have 63 words at most, so 7 rounds
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return named.join(at.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
