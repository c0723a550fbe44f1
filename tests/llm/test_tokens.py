import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortspark.llm import packing, token_store
from cohortspark.llm.common import shared_path
from cohortspark.llm.tokens import Encoder, encoder, vocabulary

PARTS = [" ", "  ", "\n", "\r", "\t", " ", "\x1c", "\x85", "　", "a", "B", "é", "ß", "µ", "1", ".", ",", "!", "'s", "'", "<|endoftext|>", "<", "|", "漢", "🙂", "́", "²", "word", "×", "-", "​"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()


def test_units_give_the_ids_of_the_whole_text(plain):
    rnd, e = random.Random(5), encoder(vocabulary())
    for k in range(20_000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14)))
        if k % 2:
            text = " ".join(w for w in text.split(" ") if w)
        assert e.ids(text) + b"\0\0\0\0" == plain(text), repr(text)


def check_store(spark, docs, plain):
    store = shared_path(spark, "test-store")
    token_store.write_tokens(docs, store)
    got = sorted(token_store.read_tokens(spark, store).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, plain(r.text)) for r in docs.select("doc_id", "text").collect()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    return store


def test_store_round_trip(spark, corpus, edge_docs, no_docs, plain):
    store = check_store(spark, corpus("documents"), plain)
    some = token_store.read_tokens(spark, store, [3, 150, 10**9])
    assert sorted(r.doc_id for r in some.collect()) == [3, 150]
    check_store(spark, edge_docs, plain)
    check_store(spark, no_docs, plain)


def test_store_refuses_another_dictionary(spark, corpus):
    store = shared_path(spark, "test-store")
    token_store.write_tokens(corpus("documents").limit(30), store)
    spark.createDataFrame([("0" * 64, b"x")], "dictionary_hash string, dictionary binary").write.mode("overwrite").parquet(f"{store}/dictionary")
    with pytest.raises(ValueError):
        token_store.read_tokens(spark, store)


def check_plan(histogram, capacity, groups):
    runs, sequences = packing.plan(histogram, capacity, groups)
    ranks, bins = {}, {}
    for length, rank, n, first, each, base in runs:
        for k in range(n):
            ranks.setdefault(length, []).append(rank + k)
            bins.setdefault(first + k // each, []).append((base + k % each * length, length))
    assert {x: sorted(v) for x, v in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == sequences
    return sequences


def test_plan_places_every_piece_once():
    rnd = random.Random(2)
    for _ in range(60):
        capacity = rnd.choice([8, 64, 2048])
        histogram = {}
        for _ in range(rnd.randrange(1, 40)):
            histogram[rnd.randint(1, capacity)] = rnd.choice([1, 2, 7, 90])
        check_plan(histogram, capacity, rnd.choice([1, 5, 96]))


def test_plan_is_near_the_lower_bound():
    rnd = random.Random(4)
    histogram = {}
    for _ in range(20_000):
        n = min(2048, int(rnd.lognormvariate(6, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    least = -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert check_plan(histogram, 2048, 96) <= 1.01 * least


def check_pack(docs, plain):
    got, cut, seen = packing.pack(docs).collect(), {}, {}
    for r in got:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
        cut.setdefault((r.doc_id, r.piece), []).append((r.start, bytes(r.ids)))
        assert r.length == len(r.ids) // 4 <= 2048 and (r.piece == 0 or r.length == 2048)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = plain(r.text)
        for piece, (start, n) in enumerate(packing.cut(len(ids) // 4, 2048)):
            want.setdefault((r.doc_id, piece), []).append((start, ids[4 * start : 4 * (start + n)]))
    assert {k: sorted(v) for k, v in cut.items()} == {k: sorted(v) for k, v in want.items()}
    for placed in seen.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048


def test_pack(corpus, edge_docs, no_docs, plain):
    for docs in (corpus("documents"), edge_docs, no_docs):
        check_pack(docs, plain)


def test_cuts_of_documents():
    for capacity in (1, 3, 8):
        sizes = [1, 2, 3, 8, 7, 9, 16, 17, 1, 24]
        of, piece, start, length = packing.cuts(np.array(sizes), capacity)
        at = 0
        for d, n in enumerate(sizes):
            first = n % capacity or capacity
            want = [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]
            got = list(zip(start[at : at + len(want)].tolist(), length[at : at + len(want)].tolist()))
            assert got == want == packing.cut(n, capacity) and (of[at : at + len(want)] == d).all()
            assert piece[at : at + len(want)].tolist() == list(range(len(want)))
            at += len(want)
        assert at == len(of)


@pytest.mark.parametrize("cached", [2, 10, 1000])
def test_a_small_cache_changes_no_id(corpus, cached):
    """Units that went are encoded anew: the ids are those of the whole text."""
    e = Encoder(vocabulary(), cached)
    for r in corpus("documents").limit(60).collect():
        text = (r.text or "")[:3000]
        whole = np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert e.ids(text) == whole
        assert len(e._units) <= cached + 1
