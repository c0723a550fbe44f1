"""Substring dedup, spelling variants and hard negatives against plain statements of their results."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import hard_negatives as HN
from cohortspark.llm import queries as Q
from cohortspark.llm import spelling as SP
from cohortspark.llm import substring_dedup as SD

DOCS = "doc_id long, text string"


# ---------------------------------------------------------------------------
# Substring dedup


def plain_removal(rows, window):
    """Per row (doc_id, n_words, n_removed, kept digest); a null id is larger than all."""
    rows = [(d, (t or "").encode().split()) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, w in rows:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < key(d):
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df, window=13):
    got = SD.remove_repeats(df, window).select("doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans").collect()
    for r in got:
        assert sum(s["last"] - s["first"] for s in r["removed_spans"]) == r["n_removed"]
    return sorted((tuple(r)[:4] for r in got), key=repr)


@pytest.mark.parametrize("window", [1, 3, 6, 13])
def test_repeats_against_plain_statement(spark, window):
    rnd = random.Random(window)
    words = ["a", "b", "c", "Ä", "d."] if window > 3 else [f"w{i}" for i in range(40)]
    rows = []
    for d in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randrange(0, 40))]
        if rows and rnd.random() < 0.6:  # passages of other texts, across their ends too
            other = rnd.choice(rows)[1].split()
            cut = rnd.randrange(len(other) + 1)
            text[len(text) // 2 : len(text) // 2] = other[cut : cut + rnd.randrange(0, 30)]
        rows.append((rnd.randrange(50), " ".join(text)))
    df = spark.createDataFrame(rows, DOCS)
    assert removed(df, window) == plain_removal(rows, window)


def test_repeats_edge_tables(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert removed(edge_docs) == plain_removal(rows, 13)
    assert removed(no_docs) == []


def test_repeats_of_many_documents_and_small_slices(spark, monkeypatch):
    """One passage in every document, and slices so small that each holds few texts."""
    monkeypatch.setattr(SD, "SLICE_BYTES", 2000)
    shared = " ".join(f"s{i}" for i in range(14))
    rows = [(i, f"x{i} " * (i % 5) + shared + f" y{i}" * (i % 3)) for i in range(120)] + [(500 + i, f"x1 {shared} y1") for i in range(40)]
    assert removed(spark.createDataFrame(rows, DOCS)) == plain_removal(rows, 13)


def packets_of(codes):
    """One range's packets, one of each slice."""
    packed = [np.sort(np.asarray(c, "<u4")).tobytes() for c in codes]
    return pa.table({"range": pa.array([5] * len(codes), pa.int32()), "slice": pa.array(range(len(codes)), pa.int32()), "packed": pa.array(packed, pa.binary())})


def test_repeated_codes_of_a_range():
    rnd = random.Random(7)
    codes = [[rnd.choice([0, 1, 2**32 - 1, *range(100, 500)]) for _ in range(rnd.randrange(1, 30))] for _ in range(25)] + [[7], [8, 8], [2**31]]
    times = Counter(c for packet in codes for c in packet)
    plain = {k: sorted(5 << 32 | c for c in {*packet} if times[c] > 1) for k, packet in enumerate(codes)}
    got = SD._repeated(packets_of(codes))
    assert {k: sorted(np.frombuffer(x, "<u8").tolist()) for k, x in zip(got["slice"].to_pylist(), got["packed"].to_pylist())} == {k: v for k, v in plain.items() if v}


def test_repeated_codes_cost_no_more_in_more_packets():
    """As many codes in 400 packets as in four: with all of the range's codes sorted for each packet, it took 120 times as long."""
    every = np.random.default_rng(3).integers(0, 300_000, 200_000)
    cost = {}
    for count in (4, 400):
        rows, took = packets_of(np.array_split(every, count)), []
        for _ in range(3):
            began = time.process_time()
            SD._repeated(rows)
            took.append(time.process_time() - began)
        cost[count] = min(took)
    assert cost[400] < 8 * cost[4] + 0.05


def test_lengths_double():
    assert SD.lengths(13) == [4, 7, 13] and SD.lengths(50) == [4, 7, 13, 25, 50] and SD.lengths(3) == [3]


def test_no_candidate_ends_early(spark):
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(30))) for i in range(20)]
    assert all(r[2] == 0 for r in removed(spark.createDataFrame(rows, DOCS)))


# ---------------------------------------------------------------------------
# Spelling variants


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts):
    out = []
    best = {}
    for w, n in counts.items():
        mates = sorted(((-m, v) for v, m in counts.items() if v != w and near(v, w)))
        form = mates[0][1] if mates and -mates[0][0] >= 2 * n else None
        best[w] = form
        out.append([w, n, len(mates), form, counts[form] if form else None])
    for row in out:
        at = row[0]
        while best[at]:
            at = best[at]
        row.append(at)
    return sorted(map(tuple, out))


def variants(df):
    got = SP.spelling_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()
    return sorted(map(tuple, got))


def test_variants_against_all_pairs(spark):
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randrange(5, 9))) for _ in range(250)}
    words |= {"x" * 40, "x" * 41, "x" * 39 + "y", "aaaaa", "aaaaaa", "aaaaaaa", "×÷×÷×", "ÿÿÿÿÿ", "ÿÿÿÿÀ"}
    counts = {w: rnd.choice([3, 4, 7, 20, 20, 100, 900]) for w in words}
    assert variants(spark.createDataFrame(list(counts.items()), "word string, n long")) == plain_variants(counts)


def test_variants_in_several_rounds(spark, monkeypatch):
    """Filters of several segments, a few to a round: each edit is asked about once."""
    monkeypatch.setattr(SP, "SEGMENT", 2)
    monkeypatch.setattr(SP, "ROUND_SEGMENTS", 3)
    rnd = random.Random(2)
    counts = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 8))): rnd.randrange(3, 50) for _ in range(120)}
    assert variants(spark.createDataFrame(list(counts.items()), "word string, n long")) == plain_variants(counts)


def test_chains_and_ties(spark):
    counts = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdx": 6, "zzzzz": 5, "zzzzy": 5}
    got = {r[0]: r for r in variants(spark.createDataFrame(list(counts.items()), "word string, n long"))}
    assert got["abcde"] == ("abcde", 3, 2, "abcdef", 6, "abcdefgh")  # of equal counts the smaller word
    assert got["zzzzz"][3:] == (None, None, "zzzzz")


def test_word_counts(spark, edge_docs, no_docs):
    def plain(rows):
        out = {}
        for d, t in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
                w = w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]
                out[w] = out.get(w, 0) + 1
        return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}

    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert {r["word"]: r["n"] for r in SP.word_counts(edge_docs, 97).collect()} == plain(rows)
    odd = [(i, "ÀÉÎõü Straße×÷ naïveté Őabcdef " + "Q" * 5000) for i in range(30)] + [(None, "naïveté"), (3, None), (4, "")]
    assert {r["word"]: r["n"] for r in SP.word_counts(spark.createDataFrame(odd, DOCS), 97).collect()} == plain(odd)
    empty = SP.word_counts(no_docs, 97)
    assert empty.count() == 0 and variants(empty) == []


def test_spelling_finds_planted_errors(spark):
    """The letters that the extraction deletes: most such words lead back to the word."""
    words = Q.op12_spelling(spark, "/root/testdata/sf0.001")
    assert words.where("form is not null and not (form_n >= 2 * n and root is not null)").count() == 0


# ---------------------------------------------------------------------------
# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, row string, score double"


def plain_negatives(rows, anchors, k=5):
    whole = [(i, v, lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], lab) for i, v, lab in whole]
    out = []
    for a, (i, v, lab) in enumerate(whole):
        if not anchors(i):
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), j if j is not None else 1 << 62, b, other) for b, (j, w, other) in enumerate(whole) if b != a and len(w) == len(v)
        ]
        scored.sort()
        for s, j, _, _ in [x for x in scored if x[3] == lab][:k]:
            fits = [x for x in scored if x[3] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, None if j == 1 << 62 else j, r + 1, None if x[1] == 1 << 62 else x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, rows, anchors, **how):
    df = spark.createDataFrame([(*r, "r", 0.0) for r in rows], VECTORS).repartition(3)
    return sorted((tuple(r) for r in HN.mine(df, anchors, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 512, "sample": 20}])
def test_negatives_against_all_pairs(spark, monkeypatch, how):
    monkeypatch.setattr(HN, "MEMBERS", 4)
    monkeypatch.setattr(HN, "STEP", 7)
    monkeypatch.setattr(HN, "SHARD", 50)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 8))
    rows = []
    for i in range(300):
        v = centres[rng.integers(4)] + 0.7 * rng.standard_normal(8)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    rows += [(400 + i, rows[i][1], (rows[i][2] + 1) % 3) for i in range(40)]  # equal vectors, other labels: ties
    got = mined(spark, rows, F.col("vec_id") % 10 == 0, **how)
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_negatives_edge_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 2),
        (6, [float("inf"), 0.0], 2), (7, [1.0, 0.0], None), (8, [0.0, 0.0], 2), (9, [0.0, 0.0], 1), (10, [1.0], 2), (20, [], 1), (11, [], 1), (12, [], 2),
        (2, [0.9, 0.0], 2), (None, [0.95, 0.0], 2), (30, [-1.0, 0.0], 1), (31, [0.9, 0.001], 2), (40, [30000.0, 30000.0], 3), (41, [20000.0, 30000.0], 3),
    ]
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    assert got == plain_negatives(rows, lambda i: i is not None and i % 10 == 0)
    assert mined(spark, [], F.col("vec_id") % 10 == 0) == []


def test_exact_scores_beyond_doubles():
    a = np.array([[3_000_000_019, 1]], np.int64)
    assert HN._scores(a, a)[0, 0] == 3_000_000_019**2 + 1


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.integers(-50, 50, (200, 6))
    for part in HN.clusters(v[:80], np.array(["x"] * 80, object)):
        bound = part.bounds(HN._unit(v), np.linalg.norm(v, axis=1))
        for m in part.members:
            assert (v @ v[m] <= np.linalg.norm(v[m]) * bound + 1e-6).all()
