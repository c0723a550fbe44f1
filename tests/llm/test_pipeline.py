import math
import re

import numpy as np

import corpus_pipeline
from cohortspark.llm import decontaminate, ftrl, quality, simhash, toxicity
from cohortspark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    good = {r.doc_id for r in quality.quality_scores(docs, quality.train(docs, labels)).where("score >= 0.7").collect()}
    now = corpus_pipeline.quality_stage(spark, docs, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == good
    clean = {r.doc_id for r in toxicity.toxicity_scores(now, toxicity.train(docs, labels)).where("score < 0.5").collect()}
    now = corpus_pipeline.toxicity_stage(spark, now, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == clean
    first = {r.component_id for r in simhash.simhash_groups(now).collect()}
    now = corpus_pipeline.dedup_stage(spark, now, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == first
    free = {r.doc_id for r in decontaminate.contamination(now, table(spark, SF, "benchmark")).where("n_hit = 0").collect()}
    now = corpus_pipeline.decontamination_stage(spark, now, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == free
    packed = corpus_pipeline.packing_stage(spark, now, SF)
    assert {r.doc_id for r in packed.collect()} == free
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == free


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_text(kept_texts):
    """Which rows stay, if rows are judged by their text alone."""
    return lambda rows: [r for r in rows if (r[1] or "") in kept_texts]


def scored(spark, module, weights, texts, above):
    """Texts whose score, from the features and weights one by one, is on the kept side."""
    features = ftrl.Features(module.SETTINGS)
    w = dict(zip(weights[0].tolist(), weights[1].tolist()))
    out = set()
    for t in texts:
        idx, value = features.row(t)
        total = sum(w.get(i, 0.0) * v for i, v in zip(idx.tolist(), np.broadcast_to(value, len(idx)).tolist()))
        score = 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))
        if (score >= corpus_pipeline.quality.KEEP_FROM) if above else (score < toxicity.TOXIC_FROM):
            out.add(t)
    return out


def first_of_groups(rows):
    """One row of each group of SimHash neighbours, by (no id, id, hash of id and text)."""
    fps = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:  # to the end of every chain
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= simhash.MOST_BITS:
                    group[i] = group[j] = min(group[i], group[j])
    out = {}
    for r, g in zip(rows, group):
        out.setdefault(g, []).append(r)
    return [sorted(g, key=lambda r: (r[0] is None, r[0] or 0))[0][:2] for g in out.values()]


def free_of(benchmark, rows):
    windows = set()
    for text in benchmark:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            out.append(r)
    return out


def test_stages_on_an_edge_table(spark, edge_docs):
    """Every stage on nulls, empty and very long texts, repeated rows and clashing names, against a plain statement of it."""
    benchmark = [r.text for r in table(spark, SF, "benchmark").collect()]
    passage = " ".join(next(t for t in benchmark if len((t or "").split()) > 12).split())
    docs = edge_docs.unionByName(edge_docs.sparkSession.createDataFrame([(77, f"before {passage} after", *[None] * 10), (77, "unlike the other one", *[None] * 10)], edge_docs.schema))
    base, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = rows_of(docs)
    texts = {r[1] or "" for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    for name, module, above in (("quality", quality, True), ("toxicity", toxicity, False)):
        kept = scored(spark, module, module.train(base, labels), texts, above)
        got = stages[name](spark, docs, SF)
        assert got.columns == docs.columns and rows_of(got) == by_text(kept)(rows)
    got = stages["simhash_dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    have, want = [r[:2] for r in rows_of(got)], first_of_groups(rows)
    assert len(have) == len(want) and {h[0] for h in have} == {w[0] for w in want} and all(r in rows for r in rows_of(got))
    got = stages["decontamination"](spark, docs, SF)
    assert got.columns == docs.columns and rows_of(got) == free_of(benchmark, rows) and len(rows_of(got)) < len(rows)
    packed = stages["packing"](spark, docs, SF).collect()
    whole = {}
    for r in packed:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in whole.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert sorted((r.doc_id for r in packed if r.piece == 0), key=repr) == sorted((r[0] for r in rows), key=repr)


def test_stages_on_an_empty_table(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, no_docs, SF)
        assert got.count() == 0 and (name == "packing" or got.columns == no_docs.columns)


def test_queries_are_registered(spark):
    from __spark_entry__ import queries

    names = set(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    rows = {n: queries()[n](spark, SF).count() for n in sorted(names) if n.startswith("op")}
    docs = table(spark, SF, "documents").count()
    assert all(rows[n] == docs for n in rows if n.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op7", "op11"))
