"""Chat formatting with loss masks aligned by offsets.

A conversation's turns are rendered into one text, which is encoded once with
character offsets; the sorted spans of the assistant's turns are intersected
with the tokens' spans by binary search. A token that touches an assistant
turn is under the loss; a token may reach beyond the turn, so the loss spans
are cut to it.

Template: ``<s>[INST] text [/INST]`` for a user's turn, ``<s>text</s>`` for
the assistant's, ``<s>[ROLE]role[/ROLE]text</s>`` for any other role. Control
strings inside a text or role, the vocabulary's end-of-text string among them,
get a backslash after their first character (one more if they have some), which
``unescape`` takes away.

A conversation of up to ``CHARS`` characters is one row, encoded at once. A
longer one is cut into segments, and its ids are still those of one encoding:
cuts are made only before a single space between two non-blanks, where the
pre-tokenizer always cuts, never at the border of turns. One whose turn numbers
span several times ``TURNS`` is dealt by turn number to several tasks, so that
no conversation has to fit one; what lies between the last such place of one
task's text and the first of the next one's is put together and encoded in a
second step. A segment lists the turns that begin in it; a turn's end may lie
in a later one. Only a text without such places is held as a whole.

Edge cases: a null text or role counts as empty; equal turns of a conversation
follow one another, ordered by role and text; null turns come first; rows
without a conv_id form one conversation without id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import partitions, written
from cohortspark.llm.tokens import vocabulary

TURNS = 1024
CHARS = 200_000
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\])|\|endoftext\|>)"
ESCAPE, UNESCAPE = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"(\\*)\\"))
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]|<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>|<s>(.*?)</s>", re.DOTALL)
CUT = re.compile(r"(?<=\S)(?= \S)")
WHOLE, HEAD, TAIL, THROUGH = range(4)  # what a row of the first step is: a segment, or text that a neighbouring task's text joins
FORMATTED = (
    "conv_id long, block long, piece int, n_turns long, formatted string, input_ids array<int>, loss_mask array<boolean>, "
    "turns array<struct<role:string,first:long,last:long>>, loss_spans array<struct<first:long,last:long>>"
)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted text, and where in it each turn's own text stands."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "user":
            before, after = "<s>[INST] ", " [/INST]"
        elif role == "assistant":
            before, after = "<s>", "</s>"
        else:
            before, after = f"<s>[ROLE]{escape(role)}[/ROLE]", "</s>"
        parts += [before, body, after]
        spans.append({"role": role, "first": at + len(before), "last": at + len(before) + len(body)})
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def turn_of(m: re.Match) -> tuple[str, str]:
    """Role and text of a match of ``TURN``."""
    user, role, other, assistant = m.groups()
    if user is not None:
        return "user", unescape(user)
    return (unescape(role), unescape(other)) if role is not None else ("assistant", unescape(assistant))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    return map(turn_of, TURN.finditer(formatted))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def masked(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """Tokens that touch one of the sorted spans, and the characters of the spans under them."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool), []
    first, last = offsets[:, 0], offsets[:, 1]
    near = np.searchsorted(spans[:, 1], first, side="right")  # the first span that ends after the token starts
    there = np.minimum(near, len(spans) - 1)
    mask = (near < len(spans)) & (spans[there, 0] < last)
    edge = np.zeros(int(max(last.max(), spans.max())) + 2, np.int64)
    np.add.at(edge, first[mask], 1)
    np.add.at(edge, last[mask], -1)
    under = np.zeros(len(edge), np.int64)
    np.add.at(under, spans[:, 0], 1)
    np.add.at(under, spans[:, 1], -1)
    both = (edge.cumsum() > 0) & (under.cumsum() > 0)
    at = np.flatnonzero(both[1:] != both[:-1]) + 1
    at = np.concatenate([[0], at]) if both[0] else at
    return mask, [{"first": int(a), "last": int(b)} for a, b in zip(at[::2], at[1::2])]


def last_cut(text: str) -> int:
    """The last place where the text may be cut, 0 if there is none."""
    at = len(text)
    while (at := text.rfind(" ", 1, max(1, at))) > 0:
        if not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace():
            return at
    return 0


class _Text:
    """Rendered turns waiting to be encoded: text, turns that begin in it, and the assistant's own spans."""

    def __init__(self):
        self.parts: list[str] = []
        self.size, self.turns, self.own = 0, [], []

    def add(self, text: str, turns: list[dict], own: list[tuple[int, int]]) -> None:
        self.parts.append(text)
        self.turns += [t | {"first": t["first"] + self.size, "last": t["last"] + self.size} for t in turns]
        self.own += [(a + self.size, b + self.size) for a, b in own]
        self.size += len(text)

    def turn(self, role: str, body: str) -> None:
        text, spans = render([(role, body)])
        self.add(text, spans, [(s["first"], s["last"]) for s in spans if role == "assistant" and s["last"] > s["first"]])

    def text(self) -> str:
        self.parts = ["".join(self.parts)]
        return self.parts[0]

    def take(self, cut: int) -> "_Text":
        """The text before ``cut``, which goes; spans that reach over it are cut."""
        text, out = self.text(), _Text()
        out.parts, out.size = [text[:cut]], cut
        out.turns = [t for t in self.turns if t["first"] < cut]
        out.own = [(a, min(b, cut)) for a, b in self.own if a < cut]
        self.parts, self.size = [text[cut:]], len(text) - cut
        self.turns = [t | {"first": t["first"] - cut, "last": t["last"] - cut} for t in self.turns if t["first"] >= cut]
        self.own = [(max(a, cut) - cut, b - cut) for a, b in self.own if b > cut]
        return out

    def row(self, conv, block: int, piece: int, path: str | None) -> dict:
        """A segment, encoded, or without ``path`` a part that waits for its neighbour."""
        row = {"conv_id": conv, "block": block, "piece": piece, "n_turns": len(self.turns), "formatted": self.text(), "turns": self.turns}
        own = np.array(self.own, np.int64).reshape(-1, 2)
        if path is None:
            return row | {"input_ids": None, "loss_mask": None, "loss_spans": [{"first": int(a), "last": int(b)} for a, b in own]}
        coded = tokenizer(path).encode(self.text(), add_special_tokens=False)
        mask, loss = masked(np.array(coded.offsets, np.int64).reshape(-1, 2), own)
        return row | {"input_ids": coded.ids, "loss_mask": mask, "loss_spans": loss}


def format_conversations(rows: DataFrame, path: str | None = None, turns: int | None = None, chars: int | None = None) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) to formatted segments with ids, loss mask and spans."""
    path, spark, turns, chars = path or vocabulary(), rows.sparkSession, turns or TURNS, chars or CHARS
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    block = F.coalesce(F.floor(turn / turns), F.lit(-(2**53)))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), block.cast("long").alias("block"), turn.alias("turn"), text("role").alias("role"), text("text").alias("text"))
    spans = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    spans = written(spans, "long-conversations")
    long = not spans.isEmpty()
    if long:
        rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
        rows = rows.withColumns({"low": F.coalesce("low", "block"), "high": F.coalesce("high", "block")})
    else:
        rows = rows.withColumns({"low": F.col("block"), "high": F.col("block")})
    rows = rows.repartition(partitions(spark), "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def batch(row: dict, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([row | {"part": part}], schema=PARTS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, piece, headed = None, _Text(), 0, True

        def head() -> Iterator[pa.RecordBatch]:
            nonlocal headed, piece
            if not headed and (place := CUT.search(held.text())):
                yield batch(held.take(place.start()).row(*key[:2], 0, None), HEAD)
                headed, piece = True, 1

        def end() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            yield from head()
            if not headed:  # no cut in all of the block
                yield batch(held.row(*key[:2], 0, None), THROUGH)
                return
            if key[1] < key[3]:
                cut = last_cut(held.text())
                if cut:
                    yield batch(held.take(cut).row(*key[:2], piece, path), WHOLE)
                yield batch(held.row(*key[:2], LATER - 1, None), TAIL)
            else:
                yield batch(held.row(*key[:2], piece, path), WHOLE)

        for b in batches:
            for *here, role, body in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "low", "high", "role", "text"))):
                if here != key:
                    yield from end()
                    key, held, piece, headed = here, _Text(), 0, here[1] == here[2]
                held.turn(role, body)
                if held.size > chars:
                    yield from head()
                    cut = last_cut(held.text()) if headed else 0
                    if cut:
                        yield batch(held.take(cut).row(*key[:2], piece, path), WHOLE)
                        piece += 1
        yield from end()

    made = rows.mapInArrow(make, FORMATTED + ", part int")
    if not long:
        return made.drop("part")
    made = written(made, "segments")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, _Text()
        for b in batches:
            for r in b.to_pylist():
                if at is None or at[0] != r["conv_id"]:
                    if held.size:
                        yield pa.RecordBatch.from_pylist([held.row(*at, LATER, path)], schema=SCHEMA)
                    held, at = _Text(), None
                at = at or (r["conv_id"], r["block"])
                held.add(r["formatted"], r["turns"], [(s["first"], s["last"]) for s in r["loss_spans"]])
                if r["part"] == HEAD:
                    yield pa.RecordBatch.from_pylist([held.row(*at, LATER, path)], schema=SCHEMA)
                    held, at = _Text(), (r["conv_id"], r["block"])
        if held.size:
            yield pa.RecordBatch.from_pylist([held.row(*at, LATER, path)], schema=SCHEMA)

    loose = made.where(F.col("part") != WHOLE).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "block", "piece")
    return made.where(F.col("part") == WHOLE).drop("part").union(loose.mapInArrow(join, FORMATTED))


LATER = 1 << 30  # after all pieces of a block
SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("block", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
        ("turns", pa.list_(pa.struct([("role", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
        ("loss_spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
)


PARTS = SCHEMA.append(pa.field("part", pa.int32()))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from its segments: turn and loss digests and sizes; a stream of any length in little memory."""
    rows = formatted.select("conv_id", "block", "piece", "formatted", "loss_spans")
    rows = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block", "piece")
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, open_ = None, None, [], ""

        def closed():
            return key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for b in batches:
            for conv, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                if (conv,) != key:
                    if key:
                        out.append(closed())
                    key, state, open_ = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                open_ += text  # a turn may go on in the next segment
                whole = 0
                for m in TURN.finditer(open_):
                    role, body = turn_of(m)
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    whole = m.end()
                open_ = open_[whole:]
                for s in loss:
                    body = unescape(text[s["first"] : s["last"]])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(out) > 1000:
                yield batch()
                out = []
        if key:
            out.append(closed())
            yield batch()

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
