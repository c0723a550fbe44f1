import random
import re

import numpy as np
import pytest
import xxhash

from cohortspark.llm import embedding_dedup, simhash
from cohortspark.llm.components import components, forest


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels_of(nodes, pairs):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def check_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = labels_of(range(len(rows)), pairs)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root[i]] = min(least.get(root[i], r.doc_id), r.doc_id)
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    want = sorted(((r.doc_id, f, least.get(root[i])) for i, (r, f) in enumerate(zip(rows, fps))), key=key)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(docs).collect()), key=key)
    assert got == want


def test_simhash_against_brute_force(corpus, edge_docs, no_docs):
    for docs in (corpus("documents"), edge_docs, no_docs):
        check_groups(docs)


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text.decode())


@pytest.mark.parametrize("asked", [8, 0.2])
def test_tree_finds_every_pair(spark, monkeypatch, asked):
    monkeypatch.setattr(simhash, "ASKED", asked)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1500).astype(np.uint64)
    bit = np.uint64(1) << np.arange(60, dtype=np.uint64)
    # neighbours, and a crowd around one point that no vantage point splits well
    x = np.unique(np.concatenate([base, base[:60] ^ bit, base[0] ^ bit, base[0] ^ bit ^ bit[::-1]]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    other = a != b
    nodes, roots = forest(x[a[other]].view(np.int64), x[b[other]].view(np.int64))
    if asked < 1:
        assert max(simhash.Tree(x, len(x), 64).blocks) > 1
    for shard in (64, 100_000):
        got = {r.node: r.component for r in simhash.similar(df, 3, shard, 400).collect()}
        assert got == dict(zip(nodes.tolist(), roots.tolist()))


def test_keep_first(spark, edge_docs):
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = {r.component_id for r in simhash.simhash_groups(edge_docs).collect() if r.component_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(named)
    # of the rows without id, the blank one is a copy of named blank ones
    assert ids.count(None) == 1


def test_keep_first_takes_one_row_of_each_group(spark):
    """Rows that share an id, or have none, are rows of their own: groups decide."""
    unlike = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    near = unlike[4].replace("e7 ", "e7x ")
    rows = [(1, unlike[0]), (1, unlike[1]), (2, unlike[2]), (None, unlike[3]), (None, unlike[3]), (9, unlike[4]), (None, unlike[4]), (None, near), (5, unlike[5]), (5, unlike[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = dict(zip([r[1] for r in rows], map(lambda r: simhash.fingerprint(r[1].encode()), rows)))
    kept = sorted(simhash.keep_first(docs, bits=12).collect(), key=repr)
    want = [(1, unlike[0]), (1, unlike[1]), (2, unlike[2]), (5, unlike[5]), (9, unlike[4]), (None, unlike[3])]
    assert int(fps[near] ^ fps[unlike[4]]).bit_count() <= 12
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(250)] + [(7, 7)]
    want = labels_of({n for e in edges for n in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, least=0.9):
    ok = [r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding) for r in rows]
    pairs = []
    for i, a in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and len(a.embedding) == len(rows[j].embedding):
                x, y = np.array(a.embedding, float), np.array(rows[j].embedding, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    pairs.append((i, j))
    return pairs


def test_embeddings_against_brute_force(spark, corpus):
    table = corpus("embeddings")
    vectors = table.unionByName(table.where("vec_id < 3").selectExpr("vec_id + 100000 as vec_id", "embedding", "label"))
    rows = vectors.collect()
    pairs = brute_links(rows)
    root = labels_of(sorted(r.vec_id for r in rows), [(rows[i].vec_id, rows[j].vec_id) for i, j in pairs])
    links = dict.fromkeys((r.vec_id for r in rows), 0)
    for i, j in pairs:
        links[rows[i].vec_id] += 1
        links[rows[j].vec_id] += 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors).collect()}
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and all(r.n_links <= links[i] for i, r in got.items())
    assert found >= 0.99 * sum(links.values())
    if found == sum(links.values()):
        assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("block", [512, 8])
def test_embedding_blocks(spark, monkeypatch, block):
    """A crowd of near copies in filters that are dealt into blocks: every link is found once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + 0.05 * rng.standard_normal(24)).tolist()) for i in range(60)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {59} and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("dimension,total", [(64, 2000), (64, 100_000), (16, 100_000), (64, 1_000_000)])
def test_filters_recall(dimension, total):
    """Pairs at the least cosine, other than those the filters were fitted on, share a filter at any row count."""
    cut, size = embedding_dedup.family(total, dimension, 0.9)
    assert embedding_dedup.missed(dimension, 0.9, cut, size, 2000, seed=99) <= 0.003
    assert embedding_dedup.missed(dimension, 0.97, cut, size, 2000, seed=98) <= 0.001
    x = embedding_dedup.unit(np.random.default_rng(5).standard_normal((300, dimension)))
    rotation, made = embedding_dedup.codes(dimension, size)
    if total <= 100_000:  # list decoding against all directions
        want = [[] for _ in x]
        for k, (places, one, two) in enumerate(made):
            turned = (x @ rotation)[:, places]
            sums = (turned[:, : one.shape[1]] @ one.T)[:, :, None] + (turned[:, one.shape[1] :] @ two.T)[:, None, :]
            for row, found in enumerate(sums >= cut * np.sqrt(2)):
                want[row] += (k * size * size + np.flatnonzero(found)).tolist()
        assert [f.tolist() for f in embedding_dedup.decoded(x, cut, size)] == want
        held = np.mean([len(w) for w in want]) / (embedding_dedup.CODES * size * size) * total
        assert 20 < held < 100  # about BUCKET


@pytest.mark.parametrize("block", [512, 16])
def test_links_of_a_crowd_are_written_as_counts_and_forests(spark, monkeypatch, block):
    """What a crowd of near copies leaves grows with its vectors, not with their pairs."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, 1 + i % 3, (np.ones(24) + 0.05 * rng.standard_normal(24)).tolist()) for i in range(100)]
    found = embedding_dedup.links(spark.createDataFrame(rows, "node long, copies long, v array<double>")).collect()
    total = {}
    for r in found:
        if r.n:
            assert r.b is None
            total[r.a] = total.get(r.a, 0) + r.n
    copies = sum(r[1] for r in rows)
    assert total == {i: copies - c for i, c, _ in rows}
    assert len(found) < 5000 and (block < 100 or len(found) <= 200)


def test_embedding_edge_cases(spark):
    inf = float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, inf], [1.0, float("nan")], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [3.0], [1e300, 2e300]]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in (6, 7, 8, 10)] == [(3, 6, True), (3, 6, False), (3, 6, False), (3, 6, False)]
    assert all(got[i] == (0, i, True) for i in (0, 1, 2, 3, 4, 5, 9))
    assert got[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
