"""Document quality by a vote of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.labelled import training_sample
from findlake.llm.shared import PARTS, emit_slices, sum_slices
from findlake.llm.words import Words, chunks

#: Features of a text: trigrams of character kinds, hashed words, and binned measures of repetition and length.
KINDS, WORD_CELLS, BINS = 16, 8192, 16
SHAPES = KINDS**3
SIZE = SHAPES + WORD_CELLS + 4 * BINS
#: Texts whose features are held at once, 25 MB.
SLICE = 512

_KIND = np.full(256, 6, np.uint8)  # other punctuation
_KIND[[*range(ord("a"), ord("z") + 1)]] = 0
_KIND[[*range(ord("A"), ord("Z") + 1)]] = 1
_KIND[[*range(ord("0"), ord("9") + 1)]] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
_KIND[128:] = 5
for _k, _c in enumerate("!*$%&#|.,"):
    _KIND[ord(_c)] = 7 + _k


def features(texts: list[str]) -> np.ndarray:
    """(texts, SIZE) counts; the binned measures count as several, so that they weigh beside the many others."""
    n = len(texts)
    raws = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(raws) + b"\n\n\n", np.uint8)
    kind = _KIND[raw].astype(np.int64)
    size = np.array([len(r) for r in raws])
    start = np.cumsum(size + 1) - size - 1
    shape = kind[:-2] * KINDS * KINDS + kind[1:-1] * KINDS + kind[2:]
    keep = np.maximum(size - 2, 0)
    owner = np.repeat(np.arange(n), keep)
    at = np.repeat(start, keep) + np.arange(len(owner)) - np.repeat(np.cumsum(keep) - keep, keep)
    w = Words(texts)
    words = np.diff(w.doc)
    of = np.repeat(np.arange(n), words)
    cell = SHAPES + (w.hashes >> np.uint64(51)).astype(np.int64)
    both = np.concatenate([owner * SIZE + shape[at], of * SIZE + cell])
    x = np.bincount(both, minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)
    distinct = np.zeros(n)
    if len(of):
        key = np.sort((of.astype(np.uint64) << np.uint64(44)) | (w.hashes >> np.uint64(20)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        distinct = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=n)
    lines = [r.split(b"\n") for r in raws]
    measures = (
        distinct / np.maximum(words, 1),
        np.array([len(set(p)) / len(p) for p in lines]),
        np.log2(1 + words) / 16,
        np.minimum(1, np.array([len(r) for r in raws]) / np.maximum(words, 1) / 24),
    )
    for k, m in enumerate(measures):
        x[np.arange(n), SHAPES + WORD_CELLS + k * BINS + np.clip((np.asarray(m) * BINS).astype(int), 0, BINS - 1)] = 8
    return x


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Of every feature the number of documents that have it, over all documents; the last entry is their number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for _, texts in chunks(batch["text"].tolist()):
                for i in range(0, len(texts), SLICE):
                    total[:SIZE] += (features(texts[i : i + SLICE]) > 0).sum(axis=0)
                total[SIZE] += len(texts)
        yield emit_slices(total)

    return sum_slices(docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, PARTS), "int64", SIZE + 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k columns with the largest values of each row; of equal ones the first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    tied = np.flatnonzero((cosine >= last[:, None]).sum(axis=1) > k)
    near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
    return near


class Voters:
    """Labelled documents in a latent space of TF-IDF features, found by randomised SVD."""

    def __init__(self, texts: list[str], labels: list[int], weights: list[float], df: np.ndarray, rank: int, neighbours: int, seed: int = 5) -> None:
        self.idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.1)
        self.y, self.by, self.k = np.array(labels, np.float64), np.array(weights), neighbours
        total = float(self.by.sum())
        self.prior = float((self.y * self.by).sum() / total) if total else 0.5
        if not texts:
            return
        a = np.concatenate([self.weigh(some[i : i + SLICE]) for _, some in chunks(texts) for i in range(0, len(some), SLICE)])
        rng = np.random.default_rng(seed)
        width = min(rank + 16, *a.shape)
        q = np.linalg.qr(a @ rng.standard_normal((a.shape[1], width), dtype=np.float32))[0]
        for _ in range(2):
            q = np.linalg.qr(a @ (a.T @ q))[0]
        _, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
        good = s[:rank] > max(float(s[0]), 1e-6) * 1e-4
        self.v = np.ascontiguousarray(vt[:rank][good].T)
        self.held = self.latent(a)

    def weigh(self, texts: list[str]) -> np.ndarray:
        x = np.log1p(features(texts)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.v
        return z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.y):
            return out
        k = min(self.k, len(self.y))
        for first, some in chunks(texts):
            for i in range(0, len(some), SLICE):
                cosine = self.latent(self.weigh(some[i : i + SLICE])) @ self.held.T
                near = nearest(cosine, k)
                # a sampled neighbour counts for all the labelled documents of its class that it stands for
                w = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 8 * self.by[near]
                out[first + i : first + i + len(near)] = (w * self.y[near]).sum(axis=1) / w.sum(axis=1)
        return out


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1500, rank: int = 48, neighbours: int = 15) -> DataFrame:
    """(doc_id, score): for every row of docs the share of label 1 (labels: doc_id, quality) among its nearest labelled
    documents, weighted by similarity.

    Features are weighted by their inverse document frequency over all documents. At most `per_class` documents of each
    label for which `learn` holds are projected to a latent space and broadcast; every document's cosine with all of
    them is computed exactly, in blocks. Only the text is an input.

    Of neighbours that are equally near, those with the smaller doc_id vote. Null and empty texts are compared like others (by their measures). If there is no labelled document every score is
    0.5. Repeated rows each come out. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voters = spark.sparkContext.broadcast(Voters(*training_sample(docs, labels, "quality", learn, per_class), document_frequencies(rows), rank, neighbours))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": voters.value.scores(batch["text"].tolist())})

    return rows.mapInPandas(run, "doc_id long, score double")
