import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from cohortspark.llm import chat, decontaminate, warc
from cohortspark.llm.common import shared_path
from cohortspark.llm.tokens import vocabulary


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check_contamination(docs, benchmark):
    windows = {}
    for r in benchmark.collect():
        w = words(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(r.item_id)
    want = []
    for r in docs.select("doc_id", "text").collect():
        w, hit, items = words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        want.append((r.doc_id or -1, len(w), len(hit), sorted(str(x) for x in items if x is not None)))
    got = decontaminate.contamination(docs, benchmark).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.item_ids) for r in got) == sorted((a or -1, *x) for a, *x in want)
    assert all(sum(s.last - s.first for s in r.hit_spans) == r.n_hit for r in got)
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not x[2] for x in want)


@pytest.mark.parametrize("most", [decontaminate.FILTER_HASHES, 0])
def test_contamination_against_brute_force(spark, monkeypatch, corpus, edge_docs, no_docs, most):
    monkeypatch.setattr(decontaminate, "FILTER_HASHES", most)
    short = [(900, "Of the", 1), (901, "the AND of", 1), (902, "", 1), (903, None, 1), (None, "was that", 1), (904, "of, the!", 1), (905, "one", 1)]
    passage = edge_docs.where("doc_id = 5").head().text
    short += [(906, " ".join(passage.split()[3:20]), 1), (907, "the the the the the the the the the the the the", 1)]
    short = spark.createDataFrame(short, "item_id long, text string, h int")
    check_contamination(edge_docs, short)
    check_contamination(no_docs, short)
    check_contamination(edge_docs, short.limit(0))
    if most:
        check_contamination(corpus("documents"), corpus("benchmark").unionByName(short.drop("h")))


def check_archive(spark, pages, path):
    got = warc.read_archive(spark, path).collect()
    rows = pages.select("page_id", "url", "html").collect()
    last = {}
    for r in rows:
        if r.page_id is not None:
            last[r.html or ""] = max(last.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in rows:
        data, top = (r.html or "").encode(), last.get(r.html or "")
        to = top if r.page_id is not None and r.page_id < top else None
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((r.page_id is not None, r.page_id or 0, len(data), sha, "response" if to is None else "revisit", to or 0, data if to is None else b""))
    assert sorted((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page or 0, bytes(r.payload or b"")) for r in got) == sorted(want)
    assert all(r.payload_digest == r.stated_digest for r in got)


@pytest.fixture
def odd_pages(spark):
    magic = "\x1f\u008b\x08"
    rows = [(-5, None, None), (-6, "u\r\nx: y", ""), (10**9, "a", "same"), (10**9 + 1, "a", "same"), (10**9 + 1, "a", "same"), (None, "b", "same"), (7, "z", "é" * 100_000), (8, "m", magic * 50)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("ranges", ["128m", "3k"])
def test_archive_round_trip(spark, corpus, odd_pages, ranges):
    pages = corpus("pages").unionByName(odd_pages.drop("payload"))
    path = shared_path(spark, "test-archive")
    warc.write_archive(pages, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", ranges)
    try:
        check_archive(spark, pages, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_magic_inside_members_across_ranges(spark, monkeypatch):
    """Stored members full of the gzip magic, read in ranges smaller than a member."""
    real = warc.zlib.compressobj
    payload = b"ab" + warc.MAGIC + b"cd"
    body = payload * 400
    monkeypatch.setattr(warc.zlib, "compressobj", lambda *_: real(0, zlib.DEFLATED, 31))
    members = [warc.member(k, "u", body + str(k).encode(), None) for k in range(6)]
    monkeypatch.undo()
    assert members[0].count(warc.MAGIC) > 300
    path = shared_path(spark, "test-magic").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/a.warc", "wb") as f:
        f.write(b"".join(members))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read_archive(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(k, body + str(k).encode()) for k in range(6)]


# a record of page 77 whose dynamic Huffman header holds the gzip magic at byte 32
MAGIC_IN_HEADER = base64.b64decode(
    "H4sIAAAAAAAAAwXBu0oDQRQA0DZcmGJxqq3S2Dl6VxMfiwhhDShYLUJqkx0fMGxCHgx2/ohfMLeYcn7A4rI/kCL7DekGpvOc2aSuLorzQsBsUlfq9Xuly+Fab1bLdqMFzCZ1"
    "pWq9WK4b9fxYDu9367bc7b6a8npevI81LtRdc/mmRvObK4WIqBARERERR82DgGrZbnW7VS+6/dh+lsNiPBYg4EmAgJhPgQL1R7bux0bjjFztuygHfe57zpnZU7p1KdnkHcV9"
    "lllnTz1FTon4zJhzkqNBChHoV0bv/yRnhyDB5QdbpN5mPVkKAcJ+6o0cTL213B2ld1ywlaHvsiOx94aNZOJ4QtJS7AQI+AfyxkWOFgEAAA=="
)


@pytest.mark.parametrize("size", ["128m", "333", "120", "40", "15"])
def test_magic_inside_headers(spark, size):
    """Members with the magic before their first decodable byte, in one range and over the ends of many."""
    assert MAGIC_IN_HEADER.find(warc.MAGIC, 3) == 32 and len(zlib.decompressobj(31).decompress(MAGIC_IN_HEADER[:40])) < 5
    plain = [warc.member(k, "u", b"x" * k, None) for k in range(4)]
    dated = [m[:4] + warc.MAGIC + m[7:] for m in (warc.member(k, "u", b"x" * k, None) for k in (4, 5, 6))]  # in the time field
    path = shared_path(spark, "test-header-magic").removeprefix("file:")
    os.makedirs(path)
    for name, order in (("a", [plain[0], MAGIC_IN_HEADER, plain[1], dated[0], warc.EMPTY_MEMBER, plain[2]]), ("b", [dated[1], dated[2], plain[3]])):
        with open(f"{path}/{name}.warc", "wb") as f:
            f.write(b"".join(order))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read_archive(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.page_id for r in got) == [0, 1, 2, 3, 4, 5, 6, 77]
    assert all(bytes(r.payload) == b"x" * r.page_id for r in got if r.page_id < 7)


def test_long_member_ends_in_a_zero():
    payload = np.random.default_rng(0).integers(0, 4, 17 << 20, dtype=np.uint8).tobytes()
    raw = warc.member(1, None, payload, None)
    assert raw[-1] == 0 and warc._parsed(raw)["payload"] == payload


def test_empty_archive(spark, odd_pages):
    path = shared_path(spark, "test-archive")
    warc.write_archive(odd_pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def check_chat(rows):
    turns = {}
    for r in rows.select("conv_id", "turn", "role", "text").collect():
        turns.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    formatted = chat.format_conversations(rows)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in own), "".join(t for *_, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return formatted


CONTROL = "</s>[INST] ok [/INST]"


def test_chat_round_trip(spark, monkeypatch, corpus):
    odd = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (-2, 0, None, None), (-2, 1, "assistant", ""), (-2, None, "assistant", "x")]
    odd += [(-3, 5, "assistant", "a<\\s> [\\\\/INST] <|endoftext|> é漢字🙂 <"), (-3, 5, "assistant", "<"), (-3, 7, "ro[ROLE]le", "![/ROLE]"), (None, 1, "assistant", "!!</s")]
    odd += [(-4, k, "user" if k % 2 else "assistant", f"turn {k} [INST]") for k in range(40)]
    odd = spark.createDataFrame([(*r, 1) for r in odd], "conv_id long, turn long, role string, text string, block int")
    check_chat(odd)
    check_chat(odd.limit(0))
    formatted = check_chat(corpus("conversations").selectExpr("conv_id", "turn", "role", "text").unionByName(odd.drop("block")))
    one = formatted.where("conv_id = -1").head()
    assert one.formatted.count("[INST]") == 1 and len(one.input_ids) == len(one.loss_mask)
    monkeypatch.setattr(chat, "TURNS", 8)
    monkeypatch.setattr(chat, "CHARS", 30)
    assert check_chat(odd).where("conv_id = -4").count() > 5


def test_mask_covers_turns_exactly():
    text, spans = chat.render([("user", "a"), ("assistant", "é🙂!</s>"), ("assistant", ""), ("x", "y"), ("assistant", "z")])
    own = np.array([(s["first"], s["last"]) for s in spans if s["role"] == "assistant" and s["last"] > s["first"]])
    from cohortspark.llm.tokens import vocabulary

    offsets = np.array(chat.tokenizer(vocabulary()).encode(text).offsets)
    mask, loss = chat.masked(offsets, own)
    assert [(s["first"], s["last"]) for s in loss] == [tuple(x) for x in own.tolist()]
    touches = [any(a < e and s < b for s, e in own) for a, b in offsets]
    assert mask.tolist() == touches


def whole_ids(formatted):
    """Per conversation, in the order of its segments: text, ids and mask."""
    out = {}
    for r in formatted.orderBy("conv_id", "block", "piece").collect():
        one = out.setdefault(r.conv_id, ["", [], [], 0, []])
        at = len(one[0])
        one[0] += r.formatted
        one[1] += r.input_ids
        one[2] += r.loss_mask
        one[3] += r.n_turns
        one[4] += [(t["role"], at + t["first"], at + t["last"]) for t in r.turns]
    return {k: (t, i, m, n, sorted(s, key=lambda x: x[1])) for k, (t, i, m, n, s) in out.items()}


@pytest.mark.parametrize("turns, chars", [(8, 30), (1, 10), (3, 100_000), (10_000, 40)])
def test_cut_conversations_have_the_ids_of_whole_ones(spark, corpus, turns, chars):
    rnd = random.Random(turns)
    bodies = ["", " ", "a", "><", "</s>", "two words", " lead", "trail ", "no-blank" * 9, "[INST] x [/INST]", "é🙂 ü  double", "line\n line", "\u00a0 x y"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(bodies)) for c in range(-6, -1) for t in range(40)]
    rows += [(-7, t, "assistant", "><") for t in range(60)]  # nowhere to cut
    rows += [(-8, t * 1000, "user", f"far apart {t}") for t in range(5)] + [(None, 0, "user", "x y"), (None, 50, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.unionByName(corpus("conversations").selectExpr("conv_id", "cast(turn as long) turn", "role", "text"))
    cut = whole_ids(chat.format_conversations(df, turns=turns, chars=chars))
    encode = chat.tokenizer(vocabulary()).encode
    every = {}
    for r in df.collect():
        every.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert cut.keys() == every.keys()
    for conv, said in every.items():
        text, spans = chat.render([x[1:] for x in sorted(said)])
        whole = encode(text, add_special_tokens=False)
        own = np.array([(s["first"], s["last"]) for s in spans if s["role"] == "assistant" and s["last"] > s["first"]], np.int64).reshape(-1, 2)
        mask, _ = chat.masked(np.array(whole.offsets, np.int64).reshape(-1, 2), own)
        assert cut[conv][0] == text and cut[conv][1] == whole.ids and cut[conv][2] == mask.tolist() and cut[conv][3] == len(said)
        assert cut[conv][4] == [(s["role"], s["first"], s["last"]) for s in spans]
    check_chat(df)


@pytest.mark.parametrize("size", ["128m", "700", "150"])
def test_damaged_records_are_returned(spark, size):
    """A member that does not decode, one that lost its magic, one cut off, and foreign bytes in front: no row is silently missing."""
    members = [warc.member(k, "u", bytes(np.random.default_rng(k).integers(97, 123, 400, dtype=np.uint8)), None) for k in range(8)]
    broken = list(members)
    broken[2] = broken[2][:40] + bytes(x ^ 0x55 for x in broken[2][40:120]) + broken[2][120:]
    broken[4] = b"xx" + broken[4][2:]
    path = shared_path(spark, "test-damage").removeprefix("file:")
    os.makedirs(path)
    for name, data in (("a", b"".join(broken)), ("b", members[0] + members[1][:200]), ("c", b"no archive at all"), ("d", b"junk" + members[5])):
        with open(f"{path}/{name}.warc", "wb") as f:
            f.write(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read_archive(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sound = sorted(r.page_id for r in got if r.record_type != warc.DAMAGED)
    assert sound == [0, 0, 1, 3, 5, 5, 6, 7]
    bad = [r for r in got if r.record_type == warc.DAMAGED]
    assert all(r.page_id is None and r.payload is None for r in bad)
    assert sum(r.payload_bytes for r in bad) == len(broken[2]) + len(broken[4]) + 200 + len(b"no archive at all") + len(b"junk")
