import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import ftrl, langid, quality, toxicity


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    pos, neg = y.sum(), (~y).sum()
    return (order[y].sum() - pos * (pos + 1) / 2) / (pos * neg)


@pytest.mark.parametrize("module, label, scores, mod, rest, least", [(quality, "quality", quality.quality_scores, 4, 2, 0.97), (toxicity, "toxic", toxicity.toxicity_scores, 5, 0, 0.9)])
def test_held_out_rank(spark, module, label, scores, mod, rest, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = scores(docs, module.train(docs, labels))
    p = got.join(labels, "doc_id").toPandas()
    assert (p["held_out"] == [zlib.crc32(str(i).encode()) % mod == rest for i in p["doc_id"]]).all()
    assert p["score"].between(0, 1).all()
    held = p[p["held_out"]]
    assert auc(held["score"].to_numpy(), held[label].to_numpy() == 1) > least


def test_learner_equals_the_plain_update():
    s = ftrl.Settings(bits=4, alpha=0.3, beta=1.0, l1=0.05, l2=0.2, passes=2)
    rows = [(np.array([0, 3, 16]), 1.0, 1.0), (np.array([3, 5, 16]), 1.0, 0.0), (np.array([0, 16]), 1.0, 1.0)]
    learner = ftrl.Learner(s)
    learner.passes(rows)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else (np.sign(z[i]) * s.l1 - z[i]) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(2):
        for idx, _, y in rows:
            w = {i: weight(i) for i in idx}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in idx:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
                n[i] += g * g
    idx, w = learner.sparse()
    assert idx.tolist() == [i for i in range(17) if weight(i)]
    assert w == pytest.approx([weight(i) for i in idx])


def test_repeated_words_share_a_feature():
    f = ftrl.Features(ftrl.Settings(counts=True))
    a, b = (dict(zip(*f.row(t))) for t in ("er er er er", "was was was was"))
    shared = set(a) & set(b) - {2**18}
    assert len(shared) == 1 and a[shared.pop()] > 0.5


@pytest.mark.parametrize("module, label, scores, keep", [(quality, "quality", quality.quality_scores, quality.keep_good), (toxicity, "toxic", toxicity.toxicity_scores, toxicity.drop_toxic)])
def test_edge_cases(spark, edge_docs, no_docs, module, label, scores, keep):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(10)] * 2 + [(3, None, "x"), (None, 1, "x")], f"doc_id long, {label} int, score string")
    weights = module.train(edge_docs, labels)
    got = scores(edge_docs, weights).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert not [r for r in got if r.doc_id is None and r.held_out]
    assert keep(edge_docs, weights).columns == edge_docs.columns
    none = module.train(edge_docs, labels.limit(0))
    assert {r.score for r in scores(edge_docs, none).collect()} == {0.5}
    assert scores(no_docs, module.train(no_docs, labels)).count() == 0


def test_language(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    got = langid.language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    edge = langid.language(edge_docs, model).collect()
    text = {r.doc_id: r.text for r in edge_docs.where("doc_id is not null").collect()}
    for r in edge:
        if r.doc_id is not None:
            letters = text[r.doc_id] is not None and any(c.isalpha() for c in text[r.doc_id])
            assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
            assert letters or r.score == 0
    assert len(edge) == edge_docs.count()
    assert {r.lang_pred for r in langid.language(edge_docs, langid.fit(no_docs, F.lit(True))).collect()} == {"und"}
    assert langid.language(no_docs, model).count() == 0


def test_ngram_counts_across_chunks(monkeypatch):
    text = "Ein Wort und noch eins " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 17)
    assert (langid.counts(text) == whole).all()


def test_languages_equal_a_plain_nearest_centroid(spark, corpus):
    """Prediction, score and rejection restated from the fitted centroids."""
    docs = corpus("documents")
    model = langid.fit(docs, F.lit(True))
    for r in langid.language(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        tf = np.log1p(langid.counts(r.text)) * model.idf
        cosine = [float(tf @ c / np.linalg.norm(tf) / np.linalg.norm(c)) for c in model.centroids]
        best = int(np.argmax(cosine))
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(cosine[best], abs=1e-4)
        if abs(1 - cosine[best] - model.farthest[best]) > 1e-4:
            assert r.rejected == (1 - cosine[best] > model.farthest[best])


@pytest.mark.parametrize("left_out", ["fr", "de", "es", "en"])
def test_texts_of_an_unlearnt_language_are_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = langid.fit(docs, F.col("lang") != left_out)
    assert left_out not in model.languages
    got = langid.language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    far = got["lang"] == left_out
    assert got[far]["rejected"].mean() > 0.8 and got[~far]["rejected"].mean() < 0.05


def plain_features(text, s):
    """Feature index → value, word by word: n-grams, skip-grams, a mark for a word said twice, and the constant."""
    mix, full = 0x9E3779B97F4A7C15, 1 << 64
    h = [xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    raw = list(h)
    raw += [2 for a, b in zip(h, h[1:]) if a == b]
    raw += [(a * mix + b) % full for a, b in zip(h, h[1:])]  # both settings use n-grams of up to two words
    for gap in range(1, s.skips + 1):
        raw += [(a * mix + b + gap) % full for a, b in zip(h, h[gap + 1 :])]
    times = {}
    for x in raw:
        k = (x * mix % full) >> (64 - s.bits)
        times[k] = times.get(k, 0) + 1
    size = math.sqrt(sum(t * t for t in times.values())) or 1.0
    out = {k: t / size if s.counts else 1.0 for k, t in times.items()}
    out[1 << s.bits] = 1.0
    return out


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_equal_a_plain_product(spark, corpus, module):
    """A text's score: the logistic of the sum over its features, with the trained weights, and the bias."""
    docs, labels = corpus("documents"), corpus("labels")
    weights = module.train(docs, labels)
    w = dict(zip(weights[0].tolist(), weights[1].tolist()))
    scores = module.quality_scores if module is quality else module.toxicity_scores
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scores(docs, weights).collect():
        total = sum(v * w.get(i, 0.0) for i, v in plain_features(texts[r.doc_id], module.SETTINGS).items())
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -35, 35))), abs=1e-6)
