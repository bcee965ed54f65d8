"""Toxicity by a bidirectional gated recurrent network with attention, over words and their characters."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.labelled import training_rows
from findlake.llm.shared import give_back
from findlake.llm.words import Words, chunks, mix

#: Words of a window and of a step, hidden units, width of a word's and of its characters' vector, cells of character trigrams.
WINDOW, STEP, HIDDEN, WIDTH, GRAMS = 64, 48, 8, 8, 2048
#: Lengths in bytes of the beginnings of a word that are inputs too, and the cells to which they are hashed (0: none).
PREFIXES, PREFIX_CELLS = (4, 5, 6, 7, 8), 1 << 14
#: Words that get a vector of their own are in at least so many training documents.
MIN_DOCS = 3
#: One of so many shares of the labelled texts is kept back from a network; it is tried on them after so many steps each.
HELD_BACK, TRIED = 5, 30

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Inputs:
    """Distinct words of a chunk of texts, their character trigrams, and the windows of all texts as word numbers."""

    def __init__(self, texts: list[str], vocabulary: np.ndarray) -> None:
        w = Words(texts)
        distinct, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.n = len(distinct)
        at = np.minimum(np.searchsorted(vocabulary, distinct), max(len(vocabulary) - 1, 0))
        self.known = np.where(vocabulary[at] == distinct, at + 1, 0) if len(vocabulary) else np.zeros(self.n, np.int64)
        raw = np.frombuffer(w.data, np.uint8)
        begin, size = w.start[first], w.end[first] - w.start[first]
        owner = np.repeat(np.arange(self.n), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        here = np.repeat(begin, size) + place
        code = raw[here].astype(np.uint64)
        before = np.where(place > 0, raw[np.maximum(here - 1, 0)], 1).astype(np.uint64)
        after = np.where(place < size[owner] - 1, raw[np.minimum(here + 1, len(raw) - 1)], 2).astype(np.uint64)
        self.gram = (mix(before << np.uint64(16) | code << np.uint64(8) | after) >> np.uint64(53)).astype(np.int64)
        self.gram_first, self.gram_size = np.cumsum(size) - size, size
        rolled = np.concatenate([[np.uint64(0)], np.cumsum(mix(code << np.uint64(8) | np.minimum(place, 255).astype(np.uint64)), dtype=np.uint64)])
        self.prefix = np.zeros((self.n, len(PREFIXES)), np.int64)
        for k, length in enumerate(PREFIXES):
            long = np.flatnonzero(size >= length)
            h = mix(rolled[self.gram_first[long] + length] - rolled[self.gram_first[long]] + np.uint64(length))
            self.prefix[long, k] = (h % np.uint64(PREFIX_CELLS - 1)).astype(np.int64) + 1
        n = np.diff(w.doc)
        count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), count)
        start = w.doc[self.doc] + (np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)) * STEP
        places = start[:, None] + np.arange(WINDOW)
        self.mask = places < w.doc[self.doc + 1][:, None]
        self.windows = inverse[np.minimum(places, max(len(inverse) - 1, 0))] if len(inverse) else np.zeros((0, WINDOW), np.int64)


def _word_vectors(p: Params, x: Inputs) -> np.ndarray:
    """(words, 2 * WIDTH): a word's own vector beside that of its characters, the mean over trigrams and the sum over beginnings."""
    if not x.n:
        return np.zeros((0, 2 * WIDTH), np.float32)
    chars = np.add.reduceat(p["gram"][x.gram], x.gram_first, axis=0) / x.gram_size[:, None].astype(np.float32)
    chars += p["prefix"][x.prefix].sum(axis=1)
    return np.concatenate([p["word"][x.known], chars], axis=1)


def _gru(p: Params, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, rows, HIDDEN) over inputs already projected to gates (time, rows, 3 * HIDDEN); d: 'f' forward, 'b' backward."""
    steps, rows, _ = gates.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    out = np.empty((steps, rows, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        u = h @ p["u" + d]
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, n, u[:, 2 * HIDDEN :], m))
        h = np.where(m, new, h)
        out[t] = h
    return out


def _attend(p: Params, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    e = np.tanh(states @ p["wa"])
    score = np.where(mask, e @ p["va"], -1e9)
    a = np.exp(score - score.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tr,trh->rh", a, states)
    return pooled @ p["wo"] + p["bo"], a, e, pooled


def window_logits(p: Params, x: Inputs, block: int = 1024) -> np.ndarray:
    vectors = _word_vectors(p, x)
    ready = {d: (vectors @ p["w" + d] + p["b" + d]).astype(np.float32) for d in "fb"}
    out = np.empty(len(x.windows), np.float32)
    for i in range(0, len(out), block):
        at, mask = x.windows[i : i + block].T, x.mask[i : i + block].T
        states = np.concatenate([_gru(p, d, ready[d][at], mask) for d in "fb"], axis=2)
        out[i : i + block] = _attend(p, states, mask)[0]
    return out


def _gradients(p: Params, x: Inputs, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Params:
    at, mask = x.windows[rows].T, x.mask[rows].T
    used, inner = np.unique(at, return_inverse=True)
    inner = inner.reshape(at.shape)
    size = x.gram_size[used]
    owner = np.repeat(np.arange(len(used)), size)
    grams = x.gram[np.repeat(x.gram_first[used], size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)]
    chars = np.zeros((len(used), WIDTH), np.float32)
    np.add.at(chars, owner, p["gram"][grams])
    chars = chars / size[:, None].astype(np.float32) + p["prefix"][x.prefix[used]].sum(axis=1)
    vectors = np.concatenate([p["word"][x.known[used]], chars], axis=1)
    held: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_gru(p, d, (vectors @ p["w" + d] + p["b" + d])[inner], mask, held[d]) for d in "fb"], axis=2)
    logit, a, e, pooled = _attend(p, states, mask)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dl = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
    g["wo"], g["bo"] = pooled.T @ dl, dl.sum()
    dp = dl[:, None] * p["wo"]
    ds = a[:, :, None] * dp[None]
    da = np.einsum("trh,rh->tr", states, dp)
    dscore = a * (da - (a * da).sum(axis=0))
    g["va"] = np.einsum("tr,trk->k", dscore, e)
    de = dscore[:, :, None] * p["va"] * (1 - e * e)
    g["wa"] = np.einsum("trh,trk->hk", states, de)
    ds += de @ p["wa"].T
    dv = np.zeros_like(vectors)
    for k, d in enumerate("fb"):
        part = ds[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        dh = np.zeros((at.shape[1], HIDDEN), np.float32)
        dgates = np.zeros((*at.shape, 3 * HIDDEN), np.float32)
        for t, h, z, r, n, un, m in reversed(held[d]):
            dh = dh + part[t]
            dnew = np.where(m, dh, 0)
            dn = dnew * (1 - z) * (1 - n * n)
            dzr = np.concatenate([dnew * (h - n) * z * (1 - z), dn * un * r * (1 - r)], axis=1)
            du = np.concatenate([dzr, dn * r], axis=1)
            g["u" + d] += h.T @ du
            dgates[t] = np.concatenate([dzr, dn], axis=1)
            dh = np.where(m, dnew * z + du @ p["u" + d].T, dh)
        flat = np.zeros((len(used), 3 * HIDDEN), np.float32)
        np.add.at(flat, inner.reshape(-1), dgates.reshape(-1, 3 * HIDDEN))
        g["w" + d], g["b" + d] = vectors.T @ flat, flat.sum(axis=0)
        dv += flat @ p["w" + d].T
    np.add.at(g["word"], x.known[used], dv[:, :WIDTH])
    np.add.at(g["prefix"], x.prefix[used].reshape(-1), np.repeat(dv[:, WIDTH:], len(PREFIXES), axis=0))
    g["word"][0] = g["prefix"][0] = 0
    np.add.at(g["gram"], grams, (dv[:, WIDTH:] / size[:, None])[owner])
    return g


def _pooled(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(texts, 3): the largest and the mean logit of a text's windows, and 1 if it has any."""
    out = np.zeros((n, 3))
    if len(logits):
        held, first = np.unique(doc, return_index=True)
        count = np.diff(np.append(first, len(doc)))
        out[held, 0] = np.maximum.reduceat(logits, first)
        out[held, 1] = np.add.reduceat(logits, first) / count
        out[held, 2] = 1
    return out


def _logistic(f: np.ndarray, y: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of y on f, by Newton steps."""
    beta = np.zeros(f.shape[1])
    for _ in range(50):
        q = _sigmoid(f @ beta)
        h = (f * (by * q * (1 - q))[:, None]).T @ f + np.eye(f.shape[1]) * 1e-2 * by.mean()
        beta += np.linalg.solve(h, f.T @ (by * (y - q)) - 1e-2 * by.mean() * beta)
    return beta


def _loss(f: np.ndarray, y: np.ndarray, by: np.ndarray, beta: np.ndarray) -> float:
    q = np.clip(_sigmoid(f @ beta), 1e-6, 1 - 1e-6)
    return float(-(by * np.where(y == 1, np.log(q), np.log(1 - q))).sum() / by.sum())


class Model:
    """Networks trained on whole labelled texts; scores whole texts by all their overlapping windows.

    `networks` networks of different beginnings are trained, each on other texts: one share of HELD_BACK of each class
    after the other is kept from the training of one of them. On these texts the steps are chosen after which it stops,
    and the logistic function of its windows' logits is fitted to them, as a network is too sure of texts that it has
    seen. A score is that of the mean of their logits. With `only`, the network of that number alone is trained.
    """

    def __init__(self, texts: list[str], labels: list[int], weights: list[float], steps: int = 240, batch: int = 128, seed: int = 11, networks: int = 2, only: int | None = None) -> None:
        rng = np.random.default_rng(seed)
        y, by = np.array(labels, np.float32), np.array(weights)
        total = float(by.sum())
        self.prior = float((y * by).sum() / total) if total else 0.5
        self.vocabulary, self.networks = np.zeros(0, np.uint64), []
        if len(set(labels)) < 2:
            return
        counts: dict[int, int] = {}
        for _, some in chunks(texts):
            w = Words(some)
            for i in range(len(some)):
                for h in np.unique(w.hashes[int(w.doc[i]) : int(w.doc[i + 1])]).tolist():
                    counts[h] = counts.get(h, 0) + 1
        self.vocabulary = np.sort(np.array([h for h, n in counts.items() if n >= MIN_DOCS], np.uint64))
        share = np.empty(len(texts), np.int64)  # each class is dealt in HELD_BACK shares
        for value in (0, 1):
            of = np.flatnonzero(y == value)
            share[rng.permutation(of)] = np.arange(len(of)) % HELD_BACK
        for k in range(networks) if only is None else (only,):
            self._train(texts, y, by, share == k % HELD_BACK, steps, batch, np.random.default_rng((seed, k)))

    def _train(self, texts: list[str], y: np.ndarray, by: np.ndarray, apart: np.ndarray, steps: int, batch: int, rng: np.random.Generator) -> None:
        if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
            apart = np.zeros(len(y), bool)  # too few texts to keep any back
        shuffled = rng.permutation(np.flatnonzero(~apart))
        # all windows of all texts, in chunks of texts in random order
        held = []
        for first, some in chunks([texts[i] for i in shuffled]):
            x = Inputs(some, self.vocabulary)
            label = y[shuffled[first + x.doc]]
            held.append((x, label, np.flatnonzero(label == 1), np.flatnonzero(label == 0)))
        held = [h for h in held if len(h[2]) and len(h[3])]
        if not held:
            return
        sizes = np.array([len(h[1]) for h in held], float)
        draw = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        p: Params = {"word": draw(len(self.vocabulary) + 1, WIDTH, scale=0.1), "gram": draw(GRAMS, WIDTH, scale=0.1), "prefix": draw(PREFIX_CELLS, WIDTH, scale=0.05), "wa": draw(2 * HIDDEN, HIDDEN), "va": draw(HIDDEN), "wo": draw(2 * HIDDEN), "bo": np.float32(0)}
        p["word"][0] = p["prefix"][0] = 0
        for d in "fb":
            p |= {"w" + d: draw(2 * WIDTH, 3 * HIDDEN), "u" + d: draw(HIDDEN, 3 * HIDDEN), "b" + d: np.zeros(3 * HIDDEN, np.float32)}
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        tried = texts if not apart.any() else [t for t, a in zip(texts, apart, strict=True) if a]
        label_of, weight_of = (y, by) if not apart.any() else (y[apart], by[apart])
        best: tuple[float, Params, np.ndarray] | None = None
        for step in range(1, steps + 1):
            x, label, one, none = held[rng.choice(len(held), p=sizes / sizes.sum())]
            rows = np.concatenate([rng.choice(one, batch // 2), rng.choice(none, batch // 2)])
            g = _gradients(p, x, rows, label[rows], np.ones(len(rows), np.float32))
            rate = 0.02 * min(1, (steps - step + 1) / (steps * 0.5))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if step % TRIED == 0 or step == steps:
                f = np.concatenate([self._pooled(p, some) for _, some in chunks(tried)])
                full = f[:, 2] > 0
                beta = _logistic(f[full], label_of[full], weight_of[full])
                loss = _loss(f[full], label_of[full], weight_of[full], beta)
                if best is None or loss < best[0]:
                    best = (loss, {k: a.copy() for k, a in p.items()}, beta)
        self.networks.append(best[1:])

    @classmethod
    def of(cls, parts: list[Model]) -> Model:
        """The networks of models that were trained apart on the same texts."""
        whole = parts[0]
        whole.networks = [n for part in parts for n in part.networks]
        return whole

    def _pooled(self, p: Params, texts: list[str]) -> np.ndarray:
        x = Inputs(texts, self.vocabulary)
        return _pooled(window_logits(p, x), x.doc, len(texts))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for first, some in chunks(texts) if self.networks else ():
            x = Inputs(some, self.vocabulary)
            pooled = [_pooled(window_logits(p, x), x.doc, len(some)) for p, _ in self.networks]
            logit = np.mean([f @ beta for f, (_, beta) in zip(pooled, self.networks, strict=True)], axis=0)
            out[first : first + len(some)] = np.where(pooled[0][:, 2] > 0, _sigmoid(logit), self.prior)
        return out


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1500, columns: tuple[str, ...] = ("doc_id",), score: str = "score", networks: int = 2) -> DataFrame:
    """The `columns` of docs with a further one called `score`, a name that none of them has: the probability that `labels` (doc_id, toxic) calls the whole text toxic.

    The networks are trained in numpy from at most `per_class` documents of each label for which `learn` holds, and a
    bounded number of bytes of them, in tasks; no text reaches the driver, which gets the networks and broadcasts them.
    Networks that meet in a task are trained one after the other. They read words in windows that overlap: a word's vector, beside that of
    its character trigrams and beginnings, goes through two gated recurrent layers, one each way; attention pools their states. A text's score is a logistic function of
    the largest and the mean window. Only the text is an input.

    Null and empty texts, and texts without a word, get the share of label 1 as score, as do all if the labels lack one
    of the classes. Repeated rows each come out. An empty table gives no rows.
    """
    spark = docs.sparkSession

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("doc_id")
        part = pickle.dumps(Model(rows["text"].tolist(), rows["label"].tolist(), rows["weight"].tolist(), only=key[0]))
        give_back()
        return pd.DataFrame({"network": [key[0]], "model": [part]})

    sample = training_rows(docs, labels, "toxic", learn, per_class).withColumn("network", F.explode(F.array(*map(F.lit, range(networks)))))
    trained = sample.repartition(networks, "network").groupBy("network").applyInPandas(train, "network int, model binary").collect()
    parts = [pickle.loads(bytes(r["model"])) for r in sorted(trained, key=lambda r: r["network"])]
    give_back(spark)
    model = spark.sparkContext.broadcast(Model.of(parts) if parts else Model([], [], []))
    held = list(dict.fromkeys([*columns, "text"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = batch[list(columns)].copy()
            part[score] = model.value.scores(batch["text"].tolist())
            give_back()
            yield part

    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in held])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInPandas(run, f"{schema}, `{score}` double")
