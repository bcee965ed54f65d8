"""Benchmark contamination by latent semantic retrieval, confirmed by common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.shared import PARTS, content_key, emit_slices, give_back, materialise, sum_slices
from findlake.llm.totals import running_totals
from findlake.llm.words import Words, chunks, mix

#: Cells to which words are hashed for their document frequencies; the table's size does not depend on the corpus.
CELLS = 1 << 20
#: Words of a benchmark passage, and (words, stride) of the windows of a document.
PASSAGE, WINDOWS = 64, ((16, 8), (48, 16))
#: Benchmark items that are searched for in one pass; more of them make more passes, so that what is broadcast stays small.
ITEMS = 2000
#: Bytes of the items' texts of one pass.
BLOCK_BYTES = 3 << 20


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def word_frequencies(docs: DataFrame) -> np.ndarray:
    """Of every cell the number of documents with a word in it, over all documents; the last entry is their number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            for _, texts in chunks(batch["text"].tolist()):
                w = Words(texts)
                owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(w.doc))
                both = np.sort((owner << 20) | _cells(w.hashes))
                first = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, bool)
                total[:CELLS] += np.bincount(both[first] & (CELLS - 1), minlength=CELLS)
                total[CELLS] += len(texts)
            give_back()
        yield emit_slices(total)

    return sum_slices(docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, PARTS), "int64", CELLS + 1)


def _signs(h: np.ndarray, width: int) -> np.ndarray:
    """A random matrix of signs with a row for each word, which any task can make from the word's hash."""
    j = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(h[:, None] ^ j[None, :]) >> np.uint64(63)).astype(np.float64) * 2 - 1


def _weights(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and their weights, the root of the count times the inverse document frequency."""
    word, n = np.unique(h, return_counts=True)
    return word, np.sqrt(n) * idf[_cells(word)]


def _vectors(rows: dict[int, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(list(rows), dtype="int64"), "b": pd.Series(list(rows.values()), dtype=object)})


def latent_space(passages: DataFrame, n_passages: int, rank: int, oversample: int = 16) -> DataFrame:
    """(word long, v array<float>): right singular vectors of the TF-IDF matrix of passages (words array<long>,
    weights array<double>), by randomised SVD. Rows and words stay distributed; only matrices of the sketch's width
    reach the driver."""
    width = max(1, min(rank + oversample, n_passages))

    def sketch(batch: pd.DataFrame) -> np.ndarray:
        return np.array([np.asarray(w) @ _signs(np.asarray(h, np.int64).view(np.uint64), width) for h, w in zip(batch["words"], batch["weights"], strict=True)]).reshape(-1, width)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            y = sketch(batch)
            total += y.T @ y
        yield emit_slices(total)

    def sums(df: DataFrame, by) -> np.ndarray:
        return sum_slices(df.mapInPandas(by, PARTS), "float64", width * width).reshape(width, width)

    values, vectors = np.linalg.eigh(sums(passages, gram))
    good = values > max(values.max(), 1e-12) * 1e-10
    to_basis = vectors[:, good] / np.sqrt(values[good])  # sketch @ to_basis has orthonormal columns

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for q, words, weights in zip(sketch(batch) @ to_basis, batch["words"], batch["weights"], strict=True):
                for word, weight in zip(words, weights, strict=True):
                    total[word] = total.get(word, 0) + weight * q
            if len(total) > 20_000:
                yield _vectors(total)
                total = {}
        yield _vectors(total)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, b in zip(batch["word"], batch["b"], strict=True):
                total[word] = total.get(word, 0) + np.asarray(b)
        yield _vectors(total)

    shape = "word long, b array<double>"
    reduced = materialise(passages.mapInPandas(project, shape).repartition("word").mapInPandas(add, shape), "reduced")
    k = int(good.sum())

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                b = np.array(batch["b"].tolist())
                total[:k, :k] += b.T @ b
        yield emit_slices(total)

    values, vectors = np.linalg.eigh(sums(reduced, outer)[:k, :k])
    top = np.argsort(values)[::-1][:rank]
    top = top[values[top] > max(values.max(initial=0), 1e-12) * 1e-10]
    rotate = vectors[:, top] / np.sqrt(values[top])

    def rotated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"word": batch["word"], "v": list((np.array(batch["b"].tolist()) @ rotate).astype(np.float32))})

    return reduced.mapInPandas(rotated, "word long, v array<float>")


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _answer(text: str) -> str:
    """What follows the last sentence end but one; of a text with a single sentence, its last third."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1:
        return parts[-1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 3) :])


class _Items:
    """A block of benchmark items as a task needs them."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> None:
        words = vectors[0].view(np.uint64)
        order = np.argsort(words)
        self.vocabulary, self.v = words[order], np.ascontiguousarray(vectors[1][order], np.float32)
        rank = self.v.shape[1]
        self.weight = idf[_cells(self.vocabulary)]
        self.flag = np.zeros(CELLS, bool)
        self.flag[_cells(self.vocabulary)] = True
        self.ids, self.words, self.answers, owner, latent = [], [], [], [], []
        for item, text in items:
            w = Words([text])
            if not len(w.hashes):
                continue
            self.ids.append(item)
            self.words.append(w.hashes.tolist())
            self.answers.append(Words([_answer(text)]).hashes.tolist())
            begin = np.arange(0, len(w.hashes), PASSAGE)
            owner += [len(self.ids) - 1] * len(begin)
            latent.append(self.latents(self.places(w.hashes), begin, np.minimum(begin + PASSAGE, len(w.hashes))))
        counts = [len(words) for words in self.words]
        self.size = np.array(counts, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = self.places(np.array([h for words in self.words for h in words], np.uint64))
        self.longest = max(counts, default=0)
        self.owner = np.array(owner, np.int64)
        self.held = np.concatenate(latent) if latent else np.zeros((0, rank), np.float32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or -1."""
        out = np.full(len(h), -1)
        if len(self.vocabulary):
            some = np.flatnonzero(self.flag[_cells(h)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == h[some], at, -1)
        return out

    def possible(self, places: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, item: np.ndarray, least: float) -> np.ndarray:
        """Of pairs of a region of words (row, ascending) and an item, those in which `least` of the item's words occur in
        the region: a common subsequence cannot be longer than that."""
        keep = np.zeros(len(row), bool)
        inside = np.flatnonzero(places >= 0)
        lo, size = np.searchsorted(inside, begin), np.searchsorted(inside, end)
        size = size - lo
        block = max(8, 50_000 // max(len(self.words), 1))
        for r in range(0, len(begin), block):
            a, b = np.searchsorted(row, [r, r + block])
            if a == b:
                continue
            n = size[r : r + block]
            region = np.repeat(np.arange(len(n)), n)
            present = np.zeros((len(n), len(self.vocabulary)), bool)
            present[region, places[inside[np.repeat(lo[r : r + block] - np.cumsum(n) + n, n) + np.arange(len(region))]]] = True
            mine, m = item[a:b], self.size[item[a:b]]
            pair = np.repeat(np.arange(b - a), m)
            start = np.cumsum(m) - m
            words = self.flat[np.repeat(self.first[mine] - start, m) + np.arange(len(pair))]
            found = np.add.reduceat(present[(row[a:b] - r)[pair], words].astype(np.int64), start)
            keep[a:b] = found >= least * m * (1 - 1e-9)
        return keep

    def latents(self, places: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unit latent vectors of windows of words, given as places in the vocabulary."""
        inside = np.flatnonzero(places >= 0)
        lo, hi = np.searchsorted(inside, begin), np.searchsorted(inside, end)
        size = hi - lo
        window = np.repeat(np.arange(len(begin)), size)
        word = places[inside[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(len(window))]]
        both = np.sort(window * len(self.vocabulary) + word)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(both)))
        window, word = np.divmod(both[first], max(len(self.vocabulary), 1))
        weight = np.sqrt(n, dtype=np.float32) * self.weight[word]
        z = np.zeros((len(begin), self.v.shape[1]), np.float32)
        count = np.bincount(window, minlength=len(begin))
        start = np.cumsum(count) - count
        for k in range(int(count.max(initial=0))):  # the windows' k-th words together; a window has few
            some = np.flatnonzero(count > k)
            z[some] += self.v[word[start[some] + k]] * weight[start[some] + k][:, None]
        return z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]


def _search(items_held, idf_held, share: float, cosine: float, overlap: float, loose: float, answer: float):
    def confirm(words: list[int], item: list[int], reply: list[int]) -> tuple[float, float]:
        ratio = common_subsequence(item, words) / len(item)
        return ratio, common_subsequence(reply, words) / len(reply) if reply and ratio >= min(overlap, loose) else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, idf = items_held.value, idf_held.value
        for batch in batches:
            out = []
            for first, texts in chunks(batch["text"].tolist()):
                w = Words(texts)
                n = np.diff(w.doc)
                places = items.places(w.hashes)
                square = idf[_cells(w.hashes)].astype(np.float64)
                square *= square
                everything = np.concatenate([[0.0], np.cumsum(square)])
                known = np.concatenate([[0.0], np.cumsum(np.where(places >= 0, square, 0))])
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for width, stride in WINDOWS:
                    count = np.where(n > 0, np.maximum(0, -(-(n - width) // stride)) + 1, 0)
                    doc = np.repeat(np.arange(len(texts)), count)
                    begin = w.doc[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
                    end = np.minimum(begin + width, w.doc[doc + 1])
                    held = known[end] - known[begin]
                    # what lies outside the benchmark's words is at right angles to every item
                    few = np.flatnonzero((held >= share * (everything[end] - everything[begin])) & (held > 0))
                    for part in np.array_split(few, max(1, len(few) // 2048)):
                        if not len(part):
                            continue
                        z = items.latents(places, begin[part], end[part])
                        cosines = z @ items.held.T
                        row, col = np.divmod(np.flatnonzero(cosines.reshape(-1) >= cosine), max(len(items.held), 1))
                        score = cosines[row, col]
                        item = items.owner[col]
                        whole = np.maximum(w.doc[doc[part]], begin[part] - items.longest), np.minimum(w.doc[doc[part] + 1], end[part] + items.longest)
                        some = items.possible(places, *whole, row, item, min(overlap, loose))
                        row, item, score = row[some], item[some], score[some]
                        for k, c, s in sorted(zip(part[row].tolist(), item.tolist(), score.tolist(), strict=True), key=lambda x: -x[2]):
                            at = (int(doc[k]), c)
                            if at in best and best[at][1] >= 0.999:
                                continue
                            words = items.words[c]
                            lo, hi = max(int(w.doc[doc[k]]), int(begin[k]) - len(words)), min(int(w.doc[doc[k] + 1]), int(end[k]) + len(words))
                            ratio, reply = confirm(w.hashes[lo:hi][places[lo:hi] >= 0].tolist(), words, items.answers[c])
                            if ratio >= overlap or (ratio >= loose and reply >= answer):
                                best[at] = max(best.get(at, (0.0, 0.0, 0.0)), (s, ratio, reply), key=lambda x: x[1])
                for (d, c), (s, ratio, reply) in best.items():
                    row = batch.iloc[first + d]
                    out.append((row["doc_id"], row["rid"], items.ids[c], s, ratio, reply))
            yield pd.DataFrame(out, columns=["doc_id", "rid", "item_id", "cosine", "overlap", "answer"])
            give_back()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 128, share: float = 0.2, cosine: float = 0.4, overlap: float = 0.7, loose: float = 0.55, answer: float = 0.9) -> DataFrame:
    """(doc_id, rid, item_id, cosine, overlap, answer): documents with a passage that is an item of the benchmark
    (item_id, text), word for word or in other words; a row for each row of docs and item found in it.

    Words weigh the root of their count times their inverse document frequency over all documents. The benchmark's
    passages give a latent space by distributed randomised SVD. Every overlapping window of every whole document goes
    through: one in which the benchmark's words carry less than `share` of the squared weight is done with; of the
    others, all items with a cosine of at least `cosine` in the latent space are candidates. A candidate is confirmed
    if the longest common subsequence of words covers `overlap` of the item, or `loose` of it and `answer` of the
    item's answer (its last sentence).

    The benchmark is searched in blocks of at most ITEMS items, and BLOCK_BYTES of text and one item more, each a pass over
    the documents that broadcasts one block and whose result is written before the next one begins. Items equal in id and
    text are one. All items that a document has are reported; of one item, the place with the largest overlap
    (of equal ones the first by cosine).
    Null and empty texts, and texts without a word, neither match nor are matched. Repeated rows each come out. Items
    with a null id keep it. Other columns are not read; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = word_frequencies(rows)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).clip(1e-3).astype(np.float32)
    idf_held = spark.sparkContext.broadcast(idf)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                h = Words([text]).hashes
                for i in range(0, len(h), PASSAGE):
                    word, weight = _weights(h[i : i + PASSAGE], idf_held.value)
                    out.append((word.view(np.int64), weight.astype(np.float64)))
            yield pd.DataFrame(out, columns=["words", "weights"])

    cut = materialise(items.select("text").mapInPandas(passages, "words array<long>, weights array<double>"), "passages")
    n_passages = cut.count()
    vectors = materialise(latent_space(cut, n_passages, rank), "latent")
    distinct = items.withColumn("key", content_key("item_id")).dropDuplicates(["key"]).withColumns({"one": F.lit(1), "bytes": F.octet_length("text").cast("long")})
    numbered = running_totals(distinct, ["key"], {"items before": "one", "bytes before": "bytes"})
    numbered = materialise(numbered.select("item_id", "text", F.floor(F.col("items before") / ITEMS).alias("by_items"), F.floor(F.col("bytes before") / BLOCK_BYTES).alias("by_bytes")), "items")
    blocks = [tuple(r) for r in numbered.select("by_items", "by_bytes").distinct().orderBy("by_items", "by_bytes").collect()]

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": np.unique(Words(batch["text"].tolist()).hashes).view(np.int64)})

    shape = "doc_id long, rid binary, item_id long, cosine double, overlap double, answer double"
    found = None
    for by_items, by_bytes in blocks:
        mine = numbered.where((F.col("by_items") == by_items) & (F.col("by_bytes") == by_bytes)).select("item_id", "text")
        own = mine.select("text").mapInPandas(words_of, "word long").distinct()
        table = vectors.join(own, "word").toArrow()  # as packed arrays
        held = table["word"].to_numpy(), table["v"].combine_chunks().values.to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 1), np.float32)
        block = spark.sparkContext.broadcast(_Items([tuple(r) for r in mine.collect()], idf, held))
        part = materialise(rows.withColumn("rid", content_key()).mapInPandas(_search(block, idf_held, share, cosine, overlap, loose, answer), shape), "contaminated")
        block.destroy()
        found = part if found is None else found.union(part)
    idf_held.destroy()
    return spark.createDataFrame([], shape) if found is None else found
