"""Exact removal of repeated word sequences, by level-wise doubling.

A window is ``window`` consecutive words of one document. A word goes if it
lies in a window whose words also stand in a document with a smaller id.
Whether a window is repeated is asked at lengths that double up to the whole
window (4, 7 and 13 words for 13); a window is asked about at the next length
only while all of its parts asked about so far are repeated, and the work ends
when none is left:

1. Equal texts form one class, so copies take no further part: all but the
   rows of the class's smallest id lose all their windows.
2. The texts of the classes are written once, dealt into slices by their hash,
   as a table bucketed by slice: no later step moves a text.
3. At the shortest length one part of each window, chosen by its words alone
   (the least hash), is asked about, at the lengths between the two ends. What
   goes to the comparing tasks is 32 bits of each part's hash, sorted and
   packed by slice and hash range; what comes back are those that another text
   holds as well. A collision there only makes a candidate.
4. At the full length 128-bit hashes of the windows go out with their slice's
   smallest document, and those come back that a smaller document has too.

Tasks hold a slice of about ``SLICE_BYTES`` of text or a range of hashes, and
slice counts follow the corpus. A sequence that many documents share is sent
once for each slice that has it.

Edge cases: a null, empty or blank text has no words; a text of fewer words
than a window loses none; rows with equal ``doc_id`` do not remove each
other's words; a null ``doc_id`` counts as larger than every other; an empty
table gives an empty result; very long texts are read whole; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import partitions, shared_path, utf8, written
from cohortspark.session import made_table

WINDOW, SEED = 13, 4  # words of a window; the first length is the last half of it of at least so many words
SLICE_BYTES = 32 << 20  # of text in a slice, about
RANGE_WORDS = 8_000_000  # windows compared in one task, about
CHUNK_BYTES = 1 << 17  # of words hashed at once
LARGEST = np.iinfo(np.int64).max  # stands for a null id
MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lengths(window: int, seed: int = SEED) -> list[int]:
    """Ascending lengths asked about: halves, rounded up, of the window."""
    out = [window]
    while out[0] > seed and -(-out[0] // 2) >= seed:
        out.insert(0, -(-out[0] // 2))
    return out


class Texts:
    """The words of several texts: where they stand in the joined bytes, and their hashes.

    A word's hash is a polynomial in its bytes' random numbers, modulo 2**64, so
    that running sums hash all words of a chunk at once; words of over ``LONG``
    bytes, where such polynomials can coincide, are hashed one by one.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        inside = ~BLANK[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]  # a word does not go on in the next text
        starts[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        at = np.flatnonzero(starts)
        self.hashes = self._hashed(data, at, np.flatnonzero(stops) + 1 - at)
        self.first = np.searchsorted(at, ends)  # the first word of each text, and the number of all
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))

    @staticmethod
    def _hashed(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out, k = np.empty(len(at), np.uint64), 0
        while k < len(at):
            end = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK_BYTES)) - 1)
            first = at[k]
            stop = at[end - 1] + size[end - 1]
            sums = np.zeros(stop - first + 1, np.uint64)
            power, inverse = _powers(stop - first)
            np.cumsum(NUMBERS[data[first:stop]] * power, out=sums[1:])
            here = at[k:end] - first
            out[k:end] = (sums[here + size[k:end]] - sums[here]) * inverse[here]
            k = end
        for k in np.flatnonzero(size > LONG):
            out[k] = xxhash.xxh64_intdigest(data[at[k] : at[k] + size[k]].tobytes())
        return _mixed(out)

    def parts(self, length: int, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the ``length`` words from each place (across texts too), or from the given ones."""
        n = max(0, len(self.hashes) - length + 1) if at is None else len(at)
        out = np.full(n, length + which, np.uint64)
        for i in range(length):
            out ^= self.hashes[i : i + n] if at is None else self.hashes[at + i]
            out *= MULTIPLIERS[which]
            out ^= out >> np.uint64(29)
        return out

    def windows(self, window: int) -> np.ndarray:
        """Places where a window starts that lies inside one text."""
        n = max(0, len(self.doc) - window + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[window - 1 :])

    def chosen(self, at: np.ndarray, hashes: np.ndarray, window: int, length: int) -> np.ndarray:
        """For each window, the place of its part with the least hash; the last bits of the hash give way to the place."""
        offsets = window - length + 1
        room = np.uint64(offsets.bit_length())
        n = len(hashes) - offsets + 1
        high = hashes >> room << room
        least = high[:n].copy()
        for o in range(1, offsets):
            np.minimum(least, high[o : o + n] | np.uint64(o), out=least)
        return at + (least[at] & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse, ``n`` at least."""
    global _kept
    if len(_kept[0]) < n:
        base = int(MULTIPLIERS[1])
        made = [np.full(max(n, CHUNK_BYTES), x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in made:
            x[0] = 1
        made = [np.multiply.accumulate(x) for x in made]
        if n > 2 * CHUNK_BYTES:
            return made[0][:n], made[1]
        _kept = made
    return _kept[0][:n], _kept[1]


_kept = [np.zeros(0, np.uint64)] * 2
LONG = 64
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
NUMBERS = _mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[0])


class Known:
    """A set of hashes; most that are not in it are told by a table of bits."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.uint64((1 << max(10, min(24, (8 * len(self.sorted)).bit_length()))) - 1)
        self.there = np.zeros(int(self.mask) + 1, bool)
        self.there[self._place(self.sorted)] = True

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ hashes >> np.uint64(32)) & self.mask

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are in the set, their places in it)."""
        at = np.flatnonzero(self.there[self._place(hashes)])
        if not len(self.sorted):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        same = self.sorted[place] == hashes[at]
        return at[same], place[same]


def _codes(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """(range << 32 | 32 bits) of each hash."""
    return ((hashes >> np.uint64(40)) % np.uint64(ranges) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


class Search:
    """The steps of the search; ``at_level`` and ``at_end`` work on the texts of (a part of) one slice."""

    def __init__(self, window: int, ranges: int):
        self.window, self.ranges, self.levels = window, ranges, lengths(window)

    def asked(self, texts: Texts, level: int, at: np.ndarray) -> list[np.ndarray]:
        """Places of the parts of this level of the windows that start at ``at``: one array for each part of a window."""
        if level == 0:
            return [texts.chosen(at, texts.parts(self.levels[0]), self.window, self.levels[0])] if len(at) else [at]
        return [at, at + (self.window - self.levels[level])]

    def alive(self, texts: Texts, level: int, known: Known) -> np.ndarray:
        """Starts of the windows all of whose parts of this level are among the ``known`` codes."""
        at, parts = texts.windows(self.window), texts.parts(self.levels[level])
        there = np.zeros(len(parts), bool)
        there[known.find(_codes(parts, self.ranges))[0]] = True
        return at[np.logical_and.reduce([there[place] for place in self.asked(texts, level, at)])]

    def ask(self, texts: Texts, level: int, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, packed codes): each part of the windows at ``at`` once, twice if several texts have it."""
        marked = np.zeros(len(texts.doc), bool)
        for place in self.asked(texts, level, at):
            marked[place] = True
        place = np.flatnonzero(marked)
        if not len(place):
            return
        code, doc = _codes(texts.parts(self.levels[level], at=place), self.ranges), texts.doc[place]
        order = np.argsort(code)
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        code = np.repeat(code[first], 1 + several)
        group = (code >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        low = code.astype("<u4")
        for a, b in zip(cuts, [*cuts[1:], len(code)]):
            yield int(group[a]), low[a:b].tobytes()

    def keys(self, texts: Texts, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, packed keys): the windows at these places, each once, with their least and largest id."""
        if not len(at):
            return
        a, b, doc = texts.parts(self.window, at=at), texts.parts(self.window, 1, at), ids[texts.doc[at]]
        group = (a >> np.uint64(40)) % np.uint64(self.ranges)
        order = np.lexsort((b, a, group))
        group, a, b, doc = group[order], a[order], b[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out, group = np.zeros(len(first), KEY), group[first].astype(np.int64)
        out["a"], out["b"] = a[first], b[first]
        out["least"], out["most"] = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for s, e in zip(cuts, [*cuts[1:], len(out)]):
            yield int(group[s]), out[s:e].tobytes()

    def covered(self, texts: Texts, ids: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The words inside a window of ``found`` (a, b, least id) that a smaller document has."""
        edge = np.zeros(len(texts.doc) + 1, np.int64)
        if len(found):
            found = found[np.argsort(found["a"])]
            same = np.flatnonzero(found["a"][1:] == found["a"][:-1])  # two windows that share 64 bits
            if len(same):
                found = _apart(found)
            known, at = Known(found["a"]), texts.windows(self.window)
            which, place = known.find(texts.parts(self.window)[at])
            at = at[which]
            if len(same):
                place = np.searchsorted(_both(found["a"], found["b"]), _both(known.sorted[place], texts.parts(self.window, 1, at)))
                place = np.minimum(place, len(found) - 1)
            gone = at[(found["b"][place] == texts.parts(self.window, 1, at)) & (found["least"][place] < ids[texts.doc[at]])]
            edge += np.bincount(gone, minlength=len(edge)) - np.bincount(gone + self.window, minlength=len(edge))
        return edge.cumsum()[:-1] > 0


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs as one sortable value."""
    out = np.zeros(len(a), np.dtype([("a", "<u8"), ("b", "<u8")]))
    out["a"], out["b"] = a, b
    return out


def _apart(found: np.ndarray) -> np.ndarray:
    return found[np.lexsort((found["b"], found["a"]))]


KEY = np.dtype([("a", "<u8"), ("b", "<u8"), ("least", "<i8"), ("most", "<i8")])


def _repeated(rows: pa.Table) -> pa.Table:
    """Of one range of codes: to each slice those that stand there twice, or in another packet.

    All packets are sorted together once: there are as many as slices, so work
    on all of the range's codes for each packet would grow with the square.
    """
    packets = [np.frombuffer(x, "<u4") for x in rows.column("packed").to_pylist()]
    every, held = np.concatenate(packets), np.array([len(p) for p in packets])
    order = np.sort(every.astype(np.uint64) << np.uint64(32) | np.arange(len(every), dtype=np.uint64))
    place = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = order[1:] >> np.uint64(32) == order[:-1] >> np.uint64(32)
    there = np.zeros(len(every), bool)
    there[place[:-1]] = same
    there[place[1:]] |= same
    packet = np.repeat(np.arange(len(packets)), held)[place]
    there[place[1:][same & (packet[1:] == packet[:-1])]] = False  # once to each
    kept = np.flatnonzero(there)
    found = every[kept].astype("<u8") | np.uint64(rows.column("range")[0].as_py()) << np.uint64(32)
    ends = np.searchsorted(kept, held.cumsum())
    starts = np.concatenate([[0], ends[:-1]])
    some = np.flatnonzero(ends > starts)
    return pa.table(
        {"slice": rows.column("slice").take(pa.array(some, pa.int64())), "packed": pa.array([found[starts[k] : ends[k]].tobytes() for k in some], pa.binary())}
    )


def _smaller(rows: pa.Table) -> pa.Table:
    """Of one range of windows: to each slice those that one of its documents has and a smaller one too, with the least id."""
    packets = [np.frombuffer(x, KEY) for x in rows.column("packed").to_pylist()]
    every = np.concatenate(packets)
    order = np.lexsort((every["b"], every["a"]))
    a, b = every["a"][order], every["b"][order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = np.empty(len(every), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(every["least"][order], first), np.diff(np.append(first, len(every))))
    out, at = [], 0
    for p in packets:
        low = least[at : at + len(p)]
        at += len(p)
        back = p[low < p["most"]].copy()
        back["least"] = low[low < p["most"]]
        out.append(back)
    kept = [k for k, x in enumerate(out) if len(x)]
    return pa.table({"slice": rows.column("slice").take(pa.array(kept, pa.int64())), "packed": pa.array([out[k].tobytes() for k in kept], pa.binary())})


def _dealt(classes: DataFrame, count: int) -> DataFrame:
    """``classes`` written as a table of ``count`` buckets, each one slice: the rows whose key hashes to it."""
    spark = classes.sparkSession
    # Spark names a bucket by hashing its column, so each slice gets a number that hashes to its bucket: 12 bytes a slice
    labels = spark.range(40 * count).select(F.col("id").cast("int").alias("slice"))
    labels = labels.groupBy(F.pmod(F.hash("slice"), F.lit(count)).alias("bucket")).agg(F.min("slice").alias("slice"))
    placed = classes.withColumn("bucket", F.pmod(F.hash("key"), F.lit(count)))
    # a bucket that none of the numbers fell into shares that of its own number
    placed = placed.join(F.broadcast(labels), "bucket", "left").withColumn("slice", F.coalesce("slice", "bucket")).drop("bucket")
    writer = placed.write.format("parquet").bucketBy(count, "slice").option("compression", "zstd")
    name = f"cohortspark_texts_{uuid.uuid4().hex}"
    path = shared_path(spark, "texts")
    made_table(path, name)
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, removed_spans (word ranges), kept_sha256."""
    spark = docs.sparkSession
    text = utf8(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    # a multiple of the shuffle's partitions: a slice lies in one of them, so it is one file
    count = partitions(spark) * max(1, -(-size // (SLICE_BYTES * partitions(spark))))
    ranges = max(partitions(spark), -(-size // (6 * RANGE_WORDS)))
    search = Search(window, ranges)
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("t").alias("t"))
    classes = _dealt(classes.withColumn("id", F.coalesce("first", F.lit(int(LARGEST)))), count)

    def packets(which: int, found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
        found = list(found)
        ranges_, packed = [r for r, _ in found], [p for _, p in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(ranges_, pa.int32()), pa.array([which] * len(found), pa.int32()), pa.array(packed, pa.binary())], names=["range", "slice", "packed"]
        )

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, held = b.column("slice").to_numpy(), pc.binary_length(b.column("t")).to_numpy().cumsum()
            starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (held[1:] // SLICE_BYTES != held[:-1] // SLICE_BYTES)]))
            for s, e in zip(starts, [*starts[1:], len(which)]):
                texts = Texts(b.column("t").slice(s, e - s))
                yield packets(int(which[s]), search.ask(texts, 0, texts.windows(window)))

    def replies(table: pa.Table, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column("packed").to_pylist())])

    def next_level(level: int):
        def step(key, own: pa.Table, reply: pa.Table) -> pa.Table:
            texts = Texts(own.column("t"))
            alive = search.alive(texts, level - 1, Known(replies(reply, "<u8")))
            return pa.Table.from_batches([packets(key[0].as_py(), search.ask(texts, level, alive))])

        return step

    def whole_windows(key, own: pa.Table, reply: pa.Table) -> pa.Table:
        texts, last = Texts(own.column("t")), len(search.levels) - 2
        alive = search.alive(texts, last, Known(replies(reply, "<u8"))) if last >= 0 else texts.windows(window)
        return pa.Table.from_batches([packets(key[0].as_py(), search.keys(texts, alive, own.column("id").to_numpy()))])

    def result(key, own: pa.Table, reply: pa.Table) -> pa.Table:
        texts = Texts(own.column("t"))
        gone = search.covered(texts, own.column("id").to_numpy(), replies(reply, KEY))
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), texts.first[:-1]) * (np.diff(texts.first) > 0)
        out = {"n_words": np.diff(texts.first), "n_removed": removed, "removed_spans": [], "kept_sha256": []}
        for text, a, b, some in zip(own.column("t"), texts.first[:-1], texts.first[1:], removed > 0):
            words, spans = text.as_py().split(), []
            if some:
                here = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
                spans = [{"first": int(x), "last": int(y)} for x, y in zip(edges[::2], edges[1::2])]
                words = [words[k] for k in np.flatnonzero(~here)]
            out["removed_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        kinds = (pa.int64(), pa.int64(), SPANS, pa.string())
        return pa.table([own.column("key"), own.column("first"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["key", "first", *out])

    texts, sent, reply = classes.select("slice", "id", "t"), "range int, slice int, packed binary", "slice int, packed binary"
    answer = spark.createDataFrame([], reply)
    for level in range(len(search.levels) - 1):
        if level == 0:
            asked = classes.select("slice", "t").mapInArrow(first_level, sent)
        else:
            asked = texts.groupBy("slice").cogroup(answer.groupBy("slice")).applyInArrow(next_level(level), sent)
        answer = written(asked.groupBy("range").applyInArrow(_repeated, reply), f"repeated-{search.levels[level]}")
        if answer.isEmpty():
            break
    else:
        asked = texts.groupBy("slice").cogroup(answer.groupBy("slice")).applyInArrow(whole_windows, sent)
        answer = written(asked.groupBy("range").applyInArrow(_smaller, reply), f"repeated-{window}")
    done = classes.groupBy("slice").cogroup(answer.groupBy("slice")).applyInArrow(
        result, "key binary, first long, n_words long, n_removed long, removed_spans array<struct<first:int,last:int>>, kept_sha256 string"
    )
    done = written(done, "kept-words")
    # a copy of a smaller document loses all words, if they make a window at all
    copy = F.coalesce(F.col("doc_id"), F.lit(int(LARGEST))) > F.coalesce(F.col("first"), F.lit(int(LARGEST)))
    whole = copy & (F.col("n_words") >= window)
    span = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))
    return rows.select("doc_id", "key").join(done, "key").select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, span).otherwise(F.col("removed_spans")).alias("removed_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
