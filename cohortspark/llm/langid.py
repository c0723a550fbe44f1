"""Language identification: cosine to several clustered centroids per language.

Texts become hashed character n-gram counts, weighted by how rare each n-gram
is and scaled to length one. For every language spherical k-means clusters a
bounded sample of its labelled texts; a text takes the language of the nearest
centroid, and is rejected if it is farther from it than ``QUANTILE`` of the
texts that the centroid was fitted on, by more than a ``MARGIN``.

Edge cases: a null text or one without a letter is ``und`` with score 0; a
text that shares no n-gram with any centroid takes the first language and is
rejected; of equal cosines the first centroid's language is taken (by name);
very long texts are counted whole; every row is predicted, repeated or not; without labelled texts all
rows are ``und``; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import remainder, slices, written

BITS = 13
ORDERS = (1, 2, 3)
HELD_OUT = (4, 2)
CENTROIDS, ROUNDS = 4, 8
PER_LANGUAGE = 1_500  # texts a language's centroids are fitted on, about
QUANTILE, MARGIN = 0.99, 0.02  # share of a centroid's own texts within its distance (one minus cosine); room beyond it
MODEL_BYTES = 256_000_000  # bound of the broadcast: languages x centroids x 2**BITS x 4 bytes
BROADCAST_ROWS = 100_000
CHUNK = 1 << 20  # characters counted at once
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the text's words: letters lower-cased, all else a single blank."""
    out = np.zeros(2**BITS)
    text = f" {' '.join(LETTERS.findall(text.lower()))} "
    for at in range(0, len(text), CHUNK):
        # two characters more, so that n-grams across the cut are counted
        c = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in ORDERS:
            g = np.zeros(max(0, min(CHUNK, len(c) - n + 1)), np.uint32)
            for i in range(n):
                g = (g ^ c[i : i + len(g)]) * np.uint32(0x9E3779B1)
                g ^= g >> np.uint32(15)
            out += np.bincount((g + np.uint32(n)) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS), minlength=2**BITS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    farthest: np.ndarray  # distance of each centroid beyond which a text is rejected

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, whether it is too far from every centroid."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        vector = unit((np.log1p(counts(text)) * self.idf).astype(np.float32))
        cosine = self.centroids @ vector
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[best], score, bool(1 - score > self.farthest[best])


def clustered(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from rows spread over the order given; only centroids with members are kept in a round."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == j].sum(axis=0) for j in range(len(c))]))
        c = c[np.abs(c).sum(axis=1) > 0]
    return c


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """From the rows of ``docs`` that ``learn`` selects, by their text and lang."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = docs.where(learn).select(F.xxhash64("doc_id", F.lit(5)).alias("o"), text.alias("text"), lang.alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    share = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    if share.count() <= BROADCAST_ROWS:  # a row for each language
        share = F.broadcast(share)
    rows = rows.join(share, "lang").where(F.pmod("o", F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * per_language))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for lang, o, text in zip(b.column("lang").to_pylist(), b.column("o").to_pylist(), b.column("text").to_pylist()):
                if has_letter(text):
                    tf = np.log1p(counts(text)).astype(np.float32)
                    at = np.flatnonzero(tf)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [lang], "o": [o], "at": pa.array([at], pa.list_(pa.int32())), "tf": pa.array([tf[at]], pa.list_(pa.float32()))}
                    )

    some = written(rows.mapInArrow(vectors, "lang string, o long, at array<int>, tf array<float>"), "language-vectors")
    seen = some.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).collect()  # at most 2**BITS rows
    total = some.count()
    idf = np.full(2**BITS, np.log(1 + total), np.float32)
    for r in seen:
        idf[r["at"]] = np.log((1 + total) / (1 + r["df"])) + 0.1

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), 2**BITS), np.float32)
        for i, (at, tf) in enumerate(zip(group["at"], group["tf"])):
            x[i, at] = tf
        # most texts are one of a cluster each; the order of the hash spreads the starts
        x = unit(x[np.argsort(group["o"].to_numpy(), kind="stable")] * idf)
        c = clustered(x, CENTROIDS, ROUNDS)
        cosine = x @ c.T
        own = cosine.argmax(axis=1)
        # a centroid that ends without a text of its own accepts what its language's others do
        of = [1 - cosine[own == j, j] if (own == j).any() else 1 - cosine.max(axis=1) for j in range(len(c))]
        farthest = [float(np.quantile(d, QUANTILE)) + MARGIN for d in of]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [v.tobytes() for v in c], "farthest": farthest})

    languages = some.select("lang").distinct().count()
    if languages * CENTROIDS * 2**BITS * 4 > MODEL_BYTES:
        raise ValueError(f"{languages} languages are too many for a broadcast model")
    # a group has about per_language rows, each of the length of a vector at most
    found = some.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, farthest double").orderBy("lang", "centroid").collect()
    vecs = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]) if found else np.zeros((0, 2**BITS), np.float32)
    return Model([r["lang"] for r in found], vecs, idf, np.array([r["farthest"] for r in found]))


def language(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (cosine), rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            rows = [sent.value.nearest(t) for some in slices([texts]) for t in some.to_pylist()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(cols, names=["lang_pred", "score", "rejected"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.*")
