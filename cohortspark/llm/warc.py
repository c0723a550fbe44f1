"""WARC archives of gzip members: a writer and a splittable reader.

Writing: one gzip member per record. Spark's text sink writes the members'
bytes, which keeps its commit protocol and any file system it knows. That sink
ends each row with a separator of at least one byte; a member ends with its
size as four little-endian bytes, the last of which is zero below 16 MiB, so
that zero is left to the separator. A longer record is followed by an empty
member, which ends in a zero as well. The files are plain concatenated gzip
members, readable by any WARC tool.

Reading: Spark's line reader, with the three bytes that begin a gzip member as
its separator, deals byte ranges to tasks; a task owns the candidates that
start in its range and reads the last one to its end. A candidate counts as a
member if its gzip and WARC headers decode; else those three bytes came up
inside a member, and the candidate continues the one before. Where they came
up before the member's first bytes can be decoded (in its Huffman header), the
candidate is held until those that follow decide. Should either happen just
where a range ends, the loose pieces of neighbouring ranges are put together
in a second, tiny step. Bytes that belong to no whole record (a member that
does not decode, is cut off, or has lost its magic) are returned as rows of the
type ``damaged`` with their number as size, so nothing vanishes unseen.

Edge cases: a null html is an empty payload; a null url or page_id leaves its
header out; rows without a page_id are written as responses and never referred
to; rows that repeat both page_id and payload are all responses if theirs is
the largest id; an empty table gives an empty archive; other columns are not
written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import slices, utf8, written

MAGIC = b"\x1f\x8b\x08"
LEVEL = 3
SPACE = 0x6B1F5E0C9D2A4B73 << 64  # upper half of the record ids; the lower half is the page_id
DATE = "2024-01-01T00:00:00Z"
PROBE = 64  # bytes decoded to tell a member from a chance occurrence of the magic
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=SPACE | page_id & (1 << 64) - 1)}>"


def page_of(record: str | None) -> int | None:
    """The page_id in one of our record ids."""
    if not record:
        return None
    try:
        n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:  # another writer's id
        return None
    if n >> 64 << 64 != SPACE:
        return None
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def _field(value: str) -> str:
    """A header value without control characters (percent-encoded)."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record as a gzip member; a revisit carries the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest(payload))}>'}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = press.compress(record) + press.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_archive(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write every row of ``pages`` (page_id, url, html) as a record below ``path``.

    Of records with equal payloads of at least ``revisit_from`` bytes that with
    the largest page_id is the response, the others revisit it.
    """
    payload = utf8(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    often = rows.where(F.octet_length("payload") >= revisit_from).groupBy("same")
    often = often.agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "last")
    rows = rows.join(written(often, "repeated-payloads"), "same", "left")
    to = F.when(F.col("last") > F.col("page_id"), F.col("last"))
    rows = rows.select("page_id", "url", "payload", to.alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            made = [member(p, u, x.as_py(), r)[:-1] for p, u, x, r in zip(some[0].to_pylist(), some[1].to_pylist(), some[2], some[3].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    lines = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("compression", "none").text(path)


MEMBER, INSIDE, EMPTY, UNDECIDED = "member", "inside", "empty", "undecided"


def _judged(chunks: list[bytes]) -> tuple[str, int]:
    """What the first chunk begins: a WARC record, nothing (its magic came up inside a member) or an empty gzip member; and how many chunks tell.

    Undecided if the chunks end, without an error, before ``WARC/`` is decoded:
    the magic may also come up in a member's gzip or Huffman header.
    """
    press, out = zlib.decompressobj(31), b""
    for n, chunk in enumerate(chunks, 1):
        for part in (chunk[:4096], chunk[4096:]):
            try:
                out += press.decompress(part, PROBE)
            except zlib.error:
                return INSIDE, n
            if press.eof and not out:
                return EMPTY, n
            if press.eof or len(out) >= 5 or not b"WARC/".startswith(out):
                return (MEMBER if out.startswith(b"WARC/") else INSIDE), n
    return UNDECIDED, len(chunks)


def _parsed(raw: bytes) -> dict | None:
    """Fields of the record in a member, None if the member is not whole."""
    press = zlib.decompressobj(31)
    try:
        record = press.decompress(raw)
    except zlib.error:
        return None
    if not press.eof:
        return None
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", "0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, size = fields.get("warc-type"), len(payload)
    if kind == "revisit":
        sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes else 0
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "page_id": page_of(fields.get("warc-record-id")), "refers_to_page": page_of(fields.get("warc-refers-to")),
        "payload": None if kind == "revisit" else payload, "payload_bytes": size,
        "payload_digest": stated if kind == "revisit" else digest(payload), "stated_digest": stated, "behind": len(press.unused_data),
    }


def _rows(parsed: dict | None, raw: bytes) -> list[dict]:
    """Rows of the bytes of a member: its record, and what is damaged."""
    if parsed is None:
        return [{"record_type": DAMAGED, "payload_bytes": len(raw)}] if raw else []
    behind = parsed.pop("behind")
    return [parsed, {"record_type": DAMAGED, "payload_bytes": behind}] if behind else [parsed]


DAMAGED = "damaged"


RECORD = (
    "record_id string, record_type string, url string, refers_to string, page_id long, refers_to_page long, payload binary, "
    "payload_bytes long, payload_digest string, stated_digest string"
)
RECORDS = pa.schema(
    [(f.split()[0], {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[f.split()[1]]) for f in RECORD.split(", ")]
)
LOOSE = "file string, range long, at long, opens boolean, raw binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bool | None, bytes]]:
    """(file, range, place, whether it opens a member, bytes) of each candidate with all that continues it.

    Candidates that the end of their range leaves undecided come singly, with None.
    """
    here, held, opens, at, pending = None, [], False, 0, []

    def rest() -> Iterator[tuple[str, int, int, bool | None, bytes]]:
        pieces = [(opens, b"".join(held))] if held else []
        pieces += [(None, chunk) for chunk in pending]
        for n, piece in enumerate(pieces, at):
            yield *here, n, *piece

    for b in batches:
        for file, start, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = chunk.as_py()
            begins = (file, start) != here
            if begins:
                yield from rest()
                here, held, opens, at, pending = (file, start), [], False, 0, []
            if begins and start == 0:  # what stands before the first magic: nothing, in a sound file
                if raw:
                    yield file, start, -1, False, raw
                continue
            pending.append(MAGIC + raw)
            while pending:
                found, n = _judged(pending)
                if found == UNDECIDED:
                    break
                if found == MEMBER:
                    if held:
                        yield *here, at, opens, b"".join(held)
                        at += 1
                    held, opens = [], True
                n = 1 if found == INSIDE else n
                if found != EMPTY:
                    held += pending[:n]
                pending = pending[n:]
    yield from rest()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: ids, type, url, reference, payload (null for a revisit), its full size and digests."""
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("chunk"))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool]]:
        """Members, and whether another one follows in their range, so that they cannot go on in the next."""
        before = None
        for now in _members(batches):
            if before is not None:
                yield before, now[3] is True and before[:2] == now[:2]
            before = now
        if before is not None:
            yield before, False

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the last member of a range, or what is undecided there, can go on in the next one; only the first piece may be such a rest
        for row, alone in settled(batches):
            if not row[3] or not alone and _parsed(row[4]) is None:
                yield pa.RecordBatch.from_pydict(dict(zip(("file", "range", "at", "opens", "raw"), ([v] for v in row))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (_, _, _, opens, raw), alone in settled(batches):
            row = _parsed(raw) if opens else None
            if row is not None or opens and alone:
                held += _rows(row, raw)
                size += len(raw) if row is None else row["payload_bytes"]
                if len(held) >= 256 or size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(held, schema=RECORDS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=RECORDS)

    def joined(rows: pa.Table) -> pa.Table:
        """Put the loose pieces of a file together in order; what is no whole record then is damaged."""
        rows = rows.sort_by([("range", "ascending"), ("at", "ascending")])
        opens, raws = rows.column("opens").to_pylist(), rows.column("raw").to_pylist()
        held: list[list[bytes]] = []
        lost = b""  # before any member
        at = 0
        while at < len(raws):
            found, n = MEMBER if opens[at] else INSIDE, 1
            if opens[at] is None:  # the pieces up to the next member's start tell
                upto = next((k for k in range(at, len(raws)) if opens[k]), len(raws))
                found, n = _judged(raws[at:upto])
            if found == MEMBER:
                held.append(raws[at : at + n])
            elif found == EMPTY:
                pass
            else:
                n = 1
                if held:
                    held[-1].append(raws[at])
                else:
                    lost += raws[at]
            at += n
        found = _rows(None, lost) + [r for x in map(b"".join, held) for r in _rows(_parsed(x), x)]
        return pa.Table.from_pylist(found, schema=RECORDS)

    out = lines.mapInArrow(whole, RECORD)
    pieces = written(lines.mapInArrow(loose, LOOSE), "loose-pieces")
    if pieces.limit(1).count():
        out = out.unionByName(pieces.groupBy("file").applyInArrow(joined, RECORD))
    return out
