"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder of three Parquet tables, so any file system Spark knows
can hold it and a lost task leaves no half-written file:

- ``dictionary``: the dictionary's bytes and their sha256;
- ``blocks``: documents in ascending ``doc_id`` order, some hundred a row:
  their ids, token counts and the offset of each document's zstandard frame in
  ``payload`` (one frame a document, ids as 16-bit numbers if the vocabulary
  allows, else 32), the hash of the dictionary, first and last ``doc_id``, and
  the ids written earlier in the same part;
- ``parts``: the number of ids before each part.

One document is read by pruning to its block and decoding its frame alone.

Edge cases: a null text counts as empty (its ids are the end id alone); rows
with the same ``doc_id`` follow one another, ordered by text; null ids come
first; an empty table gives an empty store; other columns are not stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import partitions, slices
from cohortspark.llm.tokens import encoder, vocabulary

END_ID = 0
DICTIONARY_DOCS = 2_000  # documents the dictionary is trained on, about
DICTIONARY_CHARS = 8_192  # it serves short documents, so only those train it
DICTIONARY_BYTES = 65_536
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
BLOCKS = (
    "part int, before long, first_id long, last_id long, dictionary_hash string, width int, "
    "doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"
)


def _serialised(path: str, text: str | None, width: int) -> tuple[int, bytes]:
    ids = encoder(path).ids(text or "") + END_ID.to_bytes(4, "little")
    if width == 4:
        return len(ids) // 4, ids
    return len(ids) // 4, np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; their plain content if they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def train_dictionary(docs: DataFrame, path: str, width: int) -> bytes:
    """One task serialises a bounded hash sample of short documents and trains on it."""
    total = docs.count()
    share = min(1.0, DICTIONARY_DOCS / max(1, total))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("_text")).where(F.length("_text") <= DICTIONARY_CHARS)
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    rows = rows.select("_text").limit(2 * DICTIONARY_DOCS).coalesce(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [_serialised(path, t, width)[1] for b in slices(batches) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([_dictionary(samples)], pa.binary())})

    found = rows.mapInArrow(train, "dictionary binary").collect()  # one row of at most DICTIONARY_BYTES
    return bytes(found[0][0]) if found else b""


def _zdict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(docs: DataFrame, store: str, path: str | None = None) -> None:
    """Encode all rows of ``docs`` (doc_id, text) and write them to the folder ``store``."""
    spark, path = docs.sparkSession, path or vocabulary()
    width = 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4
    raw = train_dictionary(docs, path, width)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, raw)], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{store}/dictionary")
    sent = spark.sparkContext.broadcast(raw)  # at most DICTIONARY_BYTES

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zdict = _zdict(sent.value)
        press = zstandard.ZstdCompressor(level=3, dict_data=zdict) if zdict else zstandard.ZstdCompressor(level=3)
        part, before = TaskContext.get().partitionId(), 0
        ids, counts, frames, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            some = [i for i in ids if i is not None]
            row = {
                "part": part, "before": before, "first_id": min(some, default=None), "last_id": max(some, default=None),
                "dictionary_hash": digest, "width": width, "doc_ids": ids, "counts": counts,
                "offsets": np.cumsum([0, *map(len, frames)]).tolist(), "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, data = _serialised(path, text, width)
                ids.append(doc_id)
                counts.append(n)
                frames.append(press.compress(data))
                size += len(frames[-1])
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    before += sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield block()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    rows.mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{store}/blocks")
    # one row for each part of the write, so this window sees no more rows than there were tasks
    totals = spark.read.schema(BLOCKS).parquet(f"{store}/blocks").select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = totals.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).write.parquet(f"{store}/parts")


ARROW = pa.schema(
    [
        ("part", pa.int32()), ("before", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
        ("dictionary_hash", pa.string()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)


def read_tokens(spark: SparkSession, store: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of a store: doc_id, start (ids before it), n_tokens, ids (little-endian 32-bit, end id included).

    With ``doc_ids`` only blocks that may hold one are read and only those
    documents' frames are decoded.
    """
    digest, raw = spark.read.parquet(f"{store}/dictionary").select("dictionary_hash", "dictionary").head()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"the dictionary in {store} does not have its recorded hash")
    sent = spark.sparkContext.broadcast(bytes(raw))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    blocks = spark.read.schema(BLOCKS).parquet(f"{store}/blocks")
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(near)
    parts = spark.read.schema("part int, start long").parquet(f"{store}/parts")
    blocks = blocks.join(parts, "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zdict = _zdict(sent.value)
        press = zstandard.ZstdDecompressor(dict_data=zdict) if zdict else zstandard.ZstdDecompressor()
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                get = lambda name: row.column(name)[0].as_py()  # noqa: B023, E731
                if get("dictionary_hash") != digest:
                    raise ValueError("a block was written with another dictionary")
                payload, offsets, start = get("payload"), get("offsets"), get("start") + get("before")
                kind, out = f"<u{get('width')}", {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                for k, (doc_id, n) in enumerate(zip(get("doc_ids"), get("counts"))):
                    if wanted is None or doc_id in wanted:
                        data = np.frombuffer(press.decompress(payload[offsets[k] : offsets[k + 1]]), kind)
                        for name, v in zip(out, (doc_id, start, n, data.astype("<u4").tobytes())):
                            out[name].append(v)
                    start += n
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
