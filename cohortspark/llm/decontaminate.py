"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item
is one window). Of every ``WINDOW - K + 1`` consecutive hashes of ``K`` words
the smallest is kept (the last of equal ones), in documents and items alike,
so a document and an item that share a window keep the same hash at the same
place in it. Items of fewer words than a window cannot be winnowed: for each
of their lengths, of which there are fewer than ``WINDOW``, all hashes of that
many words are kept.

Kept hashes are joined, each hit is extended along its diagonal (word ``p`` of
the document against word ``q`` of the item), and runs of a whole window or
more mark the document's words. A document's words are read as a whole; the
join moves only hashes, and of these, if the benchmark has few enough, only
those that occur in it.

Edge cases: a null text has no words; an item without words matches nothing;
items of equal words are compared once and all are named; a null item_id marks
words but is not listed; repeated documents each get their row; an empty
benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import slices, utf8, written

WINDOW, K = 10, 5
FILTER_HASHES = 4_000_000  # benchmark hashes sent to every task, at most 32 MB; with more, no filter before the join
CACHED_WORDS = 60_000
DOCS_AT_ONCE = 64  # documents whose words are hashed in one array
#: A-Z to a-z; what is no word character (ASCII but for digits and letters) to a blank.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Hashes:
    def __init__(self, short: list[int]):
        self.short = short  # the lengths of items shorter than a window
        self._known: dict[bytes, int] = {}

    def of_words(self, found: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > CACHED_WORDS:
            known.clear()
        try:
            return np.array([known[w] for w in found], np.uint64)
        except KeyError:
            for w in set(found):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in found], np.uint64)

    @staticmethod
    def grams(h: np.ndarray, k: int) -> np.ndarray:
        if len(h) < k:
            return h[:0]
        n, out = len(h) - k + 1, np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + n]) * MIX
            out ^= out >> np.uint64(29)
        return out

    def winnowed(self, h: np.ndarray, doc: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) kept of the words ``h`` of the documents ``doc``: winnowed, and all of the given lengths."""
        g, span = self.grams(h, K), WINDOW - K + 1
        n = len(g) - span + 1
        kept = np.zeros(len(g), bool)
        if n > 0:
            least = g[:n].copy()
            for o in range(1, span):
                np.minimum(least, g[o : o + n], out=least)
            open_ = doc[:n] == doc[WINDOW - 1 : WINDOW - 1 + n]  # windows inside one document
            for o in reversed(range(span)):  # the last of equal ones
                here = open_ & (g[o : o + n] == least)
                kept[o : o + n] |= here
                open_ &= ~here
        places = [np.flatnonzero(kept)]
        hashes = [g[places[0]]]
        for size in lengths:
            g = self.grams(h, size) ^ np.uint64(0x5851F42D4C957F2D + size)
            at = np.flatnonzero(doc[: len(g)] == doc[size - 1 : size - 1 + len(g)])
            places.append(at)
            hashes.append(g[at])
        return np.concatenate(hashes), np.concatenate(places)


def marked(doc: np.ndarray, item: np.ndarray, diagonals: set[int], hit: np.ndarray) -> bool:
    """Extend along each diagonal; mark in ``hit`` the runs of a window or a whole shorter item."""
    need, any_run = min(WINDOW, len(item)), False
    for d in diagonals:
        first, last = max(0, d), min(len(doc), d + len(item))
        same = np.concatenate([[False], doc[first:last] == item[first - d : last - d], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= need:
                hit[first + a : first + b] = True
                any_run = True
    return any_run


def spans(hit: np.ndarray) -> list[dict]:
    padded = np.concatenate([[False], hit, [False]])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return [{"first": int(a), "last": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes that tell documents apart by id and text (128 bits)."""
    name, text = F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), utf8(docs["text"])
    return F.xxhash64(name, text), F.xxhash64(F.lit(1), text, name)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, hit_spans (word ranges), item_ids (sorted as strings)."""
    spark = docs.sparkSession

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = [b" ".join(words(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(joined, pa.binary()), pa.array([len(j.split()) for j in joined], pa.int32())], names=["item_id", "joined", "n"]
            )

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8(F.col("text")).alias("t"))
    items = items.mapInArrow(read_items, "item_id string, joined binary, n int").where("n > 0")
    items = written(items.withColumn("cls", F.concat_ws("-", F.xxhash64("joined"), F.xxhash64(F.lit(1), "joined"))), "items")
    classes = items.select("cls", "joined", "n").dropDuplicates(["cls"])
    short = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # fewer than WINDOW rows

    def item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Hashes(short)
        for b in batches:
            for cls, joined in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = make.of_words(joined.split())
                hashes, at = make.winnowed(h, np.zeros(len(h), int), [len(h)] if len(h) < WINDOW else [])
                cols = [pa.array([cls] * len(at), pa.string()), pa.array(hashes.view(np.int64)), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["cls", "h", "q"])

    test = written(classes.select("cls", "joined").mapInArrow(item_hashes, "cls string, h long, q int"), "item-hashes")
    distinct = test.select("h").distinct()
    few = distinct.count() <= FILTER_HASHES
    sent = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["h"].to_numpy(np.int64)) if few else None)

    def read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Hashes(short), sent.value
        for some in slices(batches, DOCS_AT_ONCE):
            texts = [t.as_py() for t in some.column("t")]
            found = [words(t) for t in texts]
            n = np.array([len(f) for f in found])
            doc, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            hashes, places = make.winnowed(make.of_words([w for f in found for w in f]), doc, short)
            hashes = hashes.view(np.int64)
            if known is not None:
                near = np.searchsorted(known, hashes)
                near[near == len(known)] = 0
                there = known[near] == hashes if len(known) else np.zeros(len(hashes), bool)
                hashes, places = hashes[there], places[there]
            order = np.argsort(places, kind="stable")
            hashes, places = hashes[order], places[order]
            cuts = np.searchsorted(places, first[1:])
            out = {"n_words": n, "h": np.split(hashes, cuts), "p": [p - f for p, f in zip(np.split(places, cuts), first)]}
            out["text"] = [t if len(h) else None for t, h in zip(texts, out["h"])]
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in ("doc_id", "k1", "k2")), *(pa.array(v, t) for v, t in zip(out.values(), types))],
                names=["doc_id", "k1", "k2", *out],
            )

    k1, k2 = _keys(docs)
    source = docs.select(docs["doc_id"], k1.alias("k1"), k2.alias("k2"), utf8(docs["text"]).alias("t"))
    kind = dict(docs.dtypes)["doc_id"]
    train = written(
        source.mapInArrow(read_docs, f"doc_id {kind}, k1 long, k2 long, n_words long, h array<long>, p array<int>, text binary"), "doc-hashes"
    )
    near = train.where("size(h) > 0").dropDuplicates(["k1", "k2"])
    hits = near.select("k1", "k2", F.explode(F.arrays_zip("h", "p")).alias("x")).select("k1", "k2", "x.h", "x.p").join(test, "h")
    pairs = hits.groupBy("k1", "k2", "cls").agg(F.collect_set(F.col("p") - F.col("q")).alias("diagonals"))
    pairs = pairs.join(classes.select("cls", "joined"), "cls")
    each = pairs.groupBy("k1", "k2").agg(F.collect_list(F.struct("cls", "joined", "diagonals")).alias("items"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Hashes(short)
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                doc = make.of_words(words(row["text"]))
                hit = np.zeros(len(doc), bool)
                found = [
                    i["cls"] for i in row["items"] if marked(doc, make.of_words(i["joined"].split()), set(i["diagonals"]), hit)
                ]
                yield pa.RecordBatch.from_pylist(
                    [{"k1": row["k1"], "k2": row["k2"], "n_hit": int(hit.sum()), "hit_spans": spans(hit), "found": found}], schema=FOUND
                )

    checked = near.select("k1", "k2", "text").join(each, ["k1", "k2"]).mapInArrow(
        extend, "k1 long, k2 long, n_hit long, hit_spans array<struct<first:int,last:int>>, found array<string>"
    )
    checked = written(checked.where("n_hit > 0"), "hits")
    named = checked.select("k1", "k2", F.explode("found").alias("cls")).join(items.where("item_id is not null").select("cls", "item_id").distinct(), "cls")
    named = named.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = train.select("doc_id", "k1", "k2", "n_words").join(checked.drop("found"), ["k1", "k2"], "left").join(named, ["k1", "k2"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hit_spans", F.array().cast("array<struct<first:int,last:int>>")).alias("hit_spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "k1", "k2",
    )


FOUND = pa.schema(
    [
        ("k1", pa.int64()), ("k2", pa.int64()), ("n_hit", pa.int64()),
        ("hit_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("found", pa.list_(pa.string())),
    ]
)


FEW_BAD = 1_000_000  # contaminated documents whose keys go to every task (16 bytes each); with more, texts are shuffled to them


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, without a word inside a benchmark window."""
    bad = contamination(docs, benchmark).where("n_hit > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    bad = written(bad, "contaminated")
    bad = F.broadcast(bad) if bad.count() <= FEW_BAD else bad
    k1, k2 = _keys(docs)
    return docs.join(bad, (k1 == bad["_k1"]) & (k2 == bad["_k2"]), "left_anti")
