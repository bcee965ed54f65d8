"""Near-duplicate documents by improved consistent weighted sampling of TF-IDF shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.components import connected_components
from findlake.llm.shared import PARTS, content_key, emit_slices, give_back, materialise, sum_slices
from findlake.llm.words import Words, chunks, mix, shingles

#: Cells of the table of document frequencies: shingles are hashed to them, as in a hashed TF-IDF, so it never outgrows a broadcast.
CELLS = 1 << 20
#: Shingles of so many documents or fewer, as a share, have the full weight.
COMMON = 0.05
_LOW = np.uint64((1 << 44) - 1)


class Features:
    """Shingles of a chunk of texts: key (44 bits), tf and first of each text. Shingles of a text ascend and differ."""

    def __init__(self, texts: list[str], size: int) -> None:
        self.words = Words(texts)
        h, bounds = shingles(self.words.hashes, self.words.doc, size)
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds))
        both = np.sort((owner << np.uint64(44)) | (h >> np.uint64(20)))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.tf = np.diff(np.concatenate([first, [len(both)]]))
        both = both[first]
        self.key = mix((both & _LOW) + np.uint64(1))
        self.bounds = np.searchsorted(both >> np.uint64(44), np.arange(len(texts) + 1, dtype=np.uint64))

    def cell(self) -> np.ndarray:
        return (self.key >> np.uint64(44)).astype(np.int64)


def document_frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Of every cell the number of documents, counted over all documents; the last entry is their number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            for _, texts in chunks(batch["text"].tolist()):
                f = Features(texts, size)
                owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(f.bounds))
                both = np.sort((owner * CELLS) | f.cell())  # a document counts once a cell, however many of its shingles share it
                first = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, bool)
                total[:CELLS] += np.bincount(both[first] & (CELLS - 1), minlength=CELLS)
                total[CELLS] += int((np.diff(f.bounds) > 0).sum())
            give_back()
        yield emit_slices(total)

    return sum_slices(docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, PARTS), "int64", CELLS + 1)


def idf_table(df: np.ndarray, common: float = COMMON) -> np.ndarray:
    """1 for a shingle of all documents, rising with the inverse document frequency to 2 for those in a share of `common` or less.

    The ratio is bounded, so a few words changed in a text that many share do not outweigh it; and what is in less than
    `common` of all documents weighs alike, so a group of copies does not make its own shingles light. A cell adds the
    documents of all its shingles: on average it overstates a share by (shingles of a document) / CELLS, 0.0005 for 500
    shingles, at any size of the corpus, which is far below `common`; so cells at that share mean the same at any size."""
    n = max(int(df[-1]), 1)
    return (1 + np.clip(np.log(n / np.maximum(df[:-1], 1)) / np.log(1 / common), 0, 1)).astype(np.float32)


class Sampler:
    """Hash functions of consistent weighted sampling. Each draws r, c (gamma 2) and b (uniform) for a shingle from a table of 65536, at a place that differs by function."""

    def __init__(self, functions: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        r, c, b = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
        self.r, self.inverse, self.b = r.astype(np.float32), (1 / r).astype(np.float32), b.astype(np.float32)
        self.d = (np.log(c) + r * b - r).astype(np.float32)
        self.by = rng.integers(1, 2**63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, key: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts with a shingle, functions) of 64-bit samples: the shingle drawn, with its quantised weight."""
        lens = np.diff(bounds)
        start = bounds[:-1][lens > 0]
        lens = lens[lens > 0]
        out = np.empty((len(start), len(self.by)), np.uint64)
        if not len(start):
            return out
        log = np.log(weight).astype(np.float32)
        for k, by in enumerate(self.by):
            at = ((key * by) >> np.uint64(48)).view(np.int64)
            t = np.floor(log * self.inverse.take(at) + self.b.take(at))
            a = self.d.take(at) - self.r.take(at) * t
            low = np.minimum.reduceat(a, start)
            hit = np.flatnonzero(a == np.repeat(low, lens))
            pick = hit[np.searchsorted(hit, start)]
            out[:, k] = mix(key[pick] ^ (t[pick].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending keys, weights)."""
    total = float(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total > both else 1.0


def _signatures(size: int, bands: int, rows: int, idf_held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, sampler = idf_held.value, Sampler(bands * rows)
        for batch in batches:
            for first, texts in chunks(batch["text"].tolist()):
                f = Features(texts, size)
                weight = f.tf * idf[f.cell()]
                some = np.diff(f.bounds) > 0
                drawn = sampler.sample(f.key, weight, f.bounds)
                keys = np.zeros((len(drawn), bands), np.uint64)
                for k in range(rows):
                    keys = mix(keys + drawn[:, k::rows])
                keys = mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
                total = np.zeros(len(texts))
                if len(weight):
                    total[some] = np.add.reduceat(weight.astype(np.float64), f.bounds[:-1][some])
                held = iter(list(keys))
                doc, h = f.words.doc, f.words.hashes
                part = batch.iloc[first : first + len(texts)]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "rid": part["rid"].to_numpy(),
                        "words": [hashlib.blake2b(h[doc[i] : doc[i + 1]].tobytes(), digest_size=16).digest() if s else None for i, s in enumerate(some)],
                        "total": total,
                        "bands": [next(held) if s else None for s in some],
                    }
                )
            give_back()

    return run


def _weighted_shingles(size: int, idf_held):
    """Of rows (node, text) their shingles with count and IDF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in chunks(batch["text"].tolist()):
                f = Features(texts, size)
                ids = batch["node"].to_numpy()[first : first + len(texts)]
                yield pd.DataFrame({"node": np.repeat(ids, np.diff(f.bounds)), "key": f.key.view(np.int64), "tf": f.tf.astype(np.int32), "idf": idf_held.value[f.cell()]})
            give_back()

    return run


class _Rows:
    """Rows of a tile in blocks, each with a bounded number of rows and of features. A shingle that occurs tf times is tf
    features, so that the weight which two rows share is a product of matrices of 0 and 1."""

    def __init__(self, part: pd.DataFrame, most_rows: int = 256, most_features: int = 200_000) -> None:
        self.part = part
        self.bands = np.array(part["bands"].tolist(), np.int64).reshape(len(part), -1)
        sizes = part["keys"].map(len).to_numpy()
        tf = np.concatenate([np.asarray(x, np.int64) for x in part["tfs"]])
        key = np.concatenate([np.asarray(x, np.int64) for x in part["keys"]]).view(np.uint64)
        level = np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf)
        self.feature = np.repeat(key, tf) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.weight = np.repeat(np.concatenate([np.asarray(x, np.float64) for x in part["idfs"]]), tf)
        per_row = np.bincount(np.repeat(np.arange(len(part)), sizes), tf, len(part)).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(per_row)])
        self.blocks, first = [], 0
        for i in range(1, len(part) + 1):
            if i == len(part) or i - first >= most_rows or self.bounds[i + 1] - self.bounds[first] > most_features:
                self.blocks.append((first, i))
                first = i

    def column(self, name: str, block: tuple[int, int]) -> np.ndarray:
        return self.part[name].to_numpy()[block[0] : block[1]]


def _shared_weights(a: _Rows, p: tuple[int, int], b: _Rows, q: tuple[int, int], step: int = 8192) -> np.ndarray:
    """The weight that each row of block p of a shares with each row of block q of b."""
    left, right = (x.feature[x.bounds[r[0]] : x.bounds[r[1]]] for x, r in ((a, p), (b, q)))
    both, first = np.unique(left, return_index=True)
    weight = a.weight[a.bounds[p[0]] :][first]
    rows_a, rows_b = (np.repeat(np.arange(r[1] - r[0]), np.diff(x.bounds[r[0] : r[1] + 1])) for x, r in ((a, p), (b, q)))
    at_a, at_b = np.searchsorted(both, left), np.minimum(np.searchsorted(both, right), len(both) - 1)
    hit = both[at_b] == right
    rows_b, at_b = rows_b[hit], at_b[hit]
    total = np.zeros((p[1] - p[0], q[1] - q[0]))
    for k in range(0, len(both), step):
        x, y = np.zeros((len(total), min(step, len(both) - k))), np.zeros((total.shape[1], min(step, len(both) - k)))
        for m, rows, at in ((x, rows_a, at_a), (y, rows_b, at_b)):
            some = (at >= k) & (at < k + step)
            m[rows[some], at[some] - k] = 1
        total += (x * weight[k : k + step]) @ y.T
    return total


def _compare_tiles(threshold: float):
    """Of a pair of a bucket's tiles (or one with itself) edges that connect all rows that are linked across components.

    A pair of rows is compared in the first bucket that both are in, and only if their weights allow the threshold."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["band"].iloc[0])
        one = bool(group["lo"].iloc[0] == group["hi"].iloc[0])
        a = _Rows(group[group["tile"] == group["lo"]].reset_index(drop=True))
        b = a if one else _Rows(group[group["tile"] == group["hi"]].reset_index(drop=True))
        out: list[np.ndarray] = []
        for p in a.blocks:
            for q in b.blocks:
                if one and q < p:
                    continue
                total, shared, component, node = ([x.column(c, r) for x, r in ((a, p), (b, q))] for c in ("total", "shared", "component", "node"))
                both = total[0][:, None] + total[1][None, :]
                least = np.minimum(shared[0][:, None], shared[1][None, :])
                maybe = (component[0][:, None] != component[1][None, :]) & (least >= both * (threshold / (1 + threshold) * (1 - 1e-6)))
                for j in range(k):
                    maybe &= a.bands[p[0] : p[1], j][:, None] != b.bands[q[0] : q[1], j][None, :]
                if not maybe.any():
                    continue
                weight = _shared_weights(a, p, b, q)
                linked = maybe & (weight >= threshold * (both - weight) * (1 - 1e-12))
                # the rows of this block that are connected, as links to one of them
                name = [np.arange(len(node[0])), len(node[0]) + np.arange(len(node[1]))]
                far, before = len(node[0]) + len(node[1]), -1
                while (now := int(name[0].sum() + name[1].sum())) != before:
                    before = now
                    name[0] = np.minimum(name[0], np.where(linked, name[1][None, :], far).min(axis=1))
                    name[1] = np.minimum(name[1], np.where(linked, name[0][:, None], far).min(axis=0))
                ids, names = np.concatenate(node), np.concatenate(name)
                out.append(np.stack([ids[names], ids], axis=1)[names != np.arange(len(ids))])
        edges = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        del a, b
        give_back()
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return run


def _verify(size: int, threshold: float, idf_held):
    """Of rows (a, b, text_a, text_b) those whose weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = idf_held.value
        for batch in batches:
            left, right = batch["text_a"].tolist(), batch["text_b"].tolist()
            a, b, out = batch["a"].to_numpy(), batch["b"].to_numpy(), []
            step = 64
            for i in range(0, len(left), step):
                texts = list(dict.fromkeys(left[i : i + step] + right[i : i + step]))
                at = {t: k for k, t in enumerate(texts)}
                sets = []
                for _, some in chunks(texts):
                    f = Features(some, size)
                    w = (f.tf * idf[f.cell()]).astype(np.float64)
                    for k in range(len(some)):
                        lo, hi = f.bounds[k], f.bounds[k + 1]
                        order = np.argsort(f.key[lo:hi])
                        sets.append((f.key[lo:hi][order], w[lo:hi][order]))
                for k in range(i, min(i + step, len(left))):
                    s = weighted_jaccard(sets[at[left[k]]], sets[at[right[k]]])
                    if s >= threshold:
                        out.append((a[k], b[k], s))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})
            give_back()

    return run


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4, tile: int = 1024) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, rid, class_id, n_copies, group_id, kept.

    Texts with the same words in order are one class, named by its smallest doc_id (n_copies: its rows). Classes are
    linked where their weighted Jaccard similarity over `size`-word shingles, weighted by count times IDF over all
    documents, is at least `threshold`. A group is what is reachable over links; group_id is the class_id of the class
    that holds its first row, the one with the smallest (doc_id, rid), rows without doc_id last. kept marks that row;
    rows equal in doc_id and text share the mark.

    Candidates share a band of `rows` samples. In each bucket all classes are first compared with the smallest one, and
    where that leaves several groups with the one that has least of its own, so a bucket of near copies costs a few
    comparisons a class. Classes of buckets that still hold several groups are compared across these in tiles: a task
    has two tiles of `tile` classes, takes what their blocks share as matrix products, and returns edges that connect
    what is linked, so no row is made for a pair. A pair is passed over only if its ends are already connected, if an
    earlier bucket compares it, or if the weights that an end shares with any other class are too small. Classes that
    stay apart although they share buckets are compared pair by pair: that part of the work is quadratic in their number.

    Null and empty texts, and texts without a word, are classes of their own and never linked. Texts of one to four
    words have a single shingle. Classes are told apart by their words, not by doc_id: rows that share a doc_id but not
    their words are linked each by its own text, and where they are not near copies their groups share a number and each
    keeps a row. A class without any doc_id is named by a negative number from its words. Other columns are not read;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(document_frequencies(rows_in, size)))
    keyed = rows_in.withColumn("rid", content_key())
    signed = materialise(keyed.mapInPandas(_signatures(size, bands, rows, idf), "doc_id long, rid binary, words binary, total double, bands array<long>"), "signed")
    unnamed = -F.abs(F.xxhash64("words") % (1 << 62)) - 1
    least = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "rid"))
    classes = signed.where("words is not null").groupBy("words").agg(least.alias("least"), F.count("*").alias("n_copies"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    # a class goes by a number from its words, node, while links are sought
    classes = materialise(classes.select("words", F.xxhash64("words").alias("node"), "least.unnamed", F.coalesce("least.doc_id", unnamed).alias("class_id"), F.col("least.rid").alias("rid"), "n_copies", "total", "bands"), "classes")

    exploded = classes.select("node", "unnamed", "class_id", "total", F.posexplode("bands").alias("band", "bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("unnamed", "class_id", "node")).alias("first")).where("n > 1").select("bucket", F.col("first.node").alias("first"))
    members = materialise(exploded.drop("unnamed", "class_id").join(shared, "bucket"), "buckets")
    needed = members.select("node").distinct().join(classes.select("node", "rid"), "node")
    texts = materialise(keyed.select("rid", "text").join(needed, "rid").dropDuplicates(["node"]).select("node", "text"), "texts")
    totals = classes.select("node", "total")
    give_back(spark)  # what the shuffles of a part took would lie beside the Python workers of the next

    def verified(pairs: DataFrame) -> DataFrame:
        # a class that very many are compared with is dealt to as many tasks as it fills
        deals = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("deals"))
        dealt = pairs.join(deals, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")).drop("deals")
        left = texts.withColumnsRenamed({"node": "a", "text": "text_a"}).join(deals, "a").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return dealt.join(left, ["a", "deal"]).join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(_verify(size, threshold, idf), "a long, b long, similarity double")

    # the similarity is at most the smaller total over the larger
    close = F.least("total", "total_b") >= F.greatest("total", "total_b") * threshold * (1 - 1e-9)
    stars = members.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("total").alias("total_b")).distinct()
    stars = stars.join(totals.withColumnRenamed("node", "a"), "a").where(close).select("a", "b")
    edges = materialise(verified(stars), "links")
    group = connected_components(edges.select("a", "b"))
    give_back(spark)

    grouped = members.join(group.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = materialise(grouped, "grouped")
    mixed = grouped.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    still = grouped.join(mixed, "bucket").select("bucket", "band", "node", "total", "first")
    # no similarity is above what the shingles that some other class of these buckets has too allow
    rare = materialise(texts.join(still.select("node").distinct(), "node").mapInPandas(_weighted_shingles(size, idf), "node long, key long, tf int, idf float"), "shingles")
    common = rare.groupBy("key").count().where("count > 1").select("key")
    held = rare.join(common, "key", "left_semi").groupBy("node").agg(F.sum(F.col("tf") * F.col("idf").cast("double")).alias("shared"), F.collect_list(F.struct("key", "tf", "idf")).alias("held"))
    held = materialise(held.join(totals, "node").where(F.col("shared") >= F.col("total") * threshold * (1 - 1e-6)).drop("total"), "held")
    still = materialise(still.join(held.select("node", "shared"), "node"), "still")
    give_back(spark)
    enough = F.least("shared", "shared_b") >= (F.col("total") + F.col("total_b")) * (threshold / (1 + threshold) * (1 - 1e-6))

    def in_groups(links: DataFrame) -> DataFrame:
        found = connected_components(links).withColumnRenamed("id", "node")
        return still.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.select("bucket", F.col("node").alias("b"), F.col("component").alias("component_b"), F.col("total").alias("total_b"), F.col("shared").alias("shared_b"))

    # then with the class that has least of its own, which is nearest to what the others were copied from
    apart = F.col("component") != F.col("component_b")
    now = still.join(group.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nearest = now.groupBy("bucket").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("share"), "node", "component", "total", "shared")).alias("p")).select("bucket", "p.*")
    stars = now.join(renamed(nearest), "bucket").where(apart & close & enough).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    edges = edges.select("a", "b").union(materialise(verified(stars), "links").select("a", "b"))
    # and what is still apart with each other, in tiles of the buckets that hold several groups
    now = materialise(in_groups(edges), "grouped")
    sizes = now.join(held.select("node", F.size("held").alias("size")), "node").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    sizes = sizes.select("bucket", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("size") / (tile * 2048))).cast("int").alias("tiles"))
    tiled = now.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("node", "bucket"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("bucket", "band", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "component", "total", "shared")
    tiled = tiled.join(classes.select("node", "bands"), "node").join(held.select("node", F.col("held.key").alias("keys"), F.col("held.tf").alias("tfs"), F.col("held.idf").alias("idfs")), "node")
    across = tiled.groupBy("bucket", "lo", "hi").applyInPandas(_compare_tiles(threshold), "a long, b long")
    edges = edges.union(materialise(across, "links"))
    group = connected_components(edges)

    # of each group its first row
    named = group.withColumnRenamed("id", "node").join(classes.select("node", "unnamed", "class_id", "rid"), "node")
    heads = named.groupBy("component").agg(F.min(F.struct("unnamed", "class_id", "rid")).alias("head")).select("component", F.col("head.class_id").alias("group_id"), F.col("head.rid").alias("head_rid"))
    grouped = group.withColumnRenamed("id", "node").join(heads, "component").drop("component")

    named = signed.select("doc_id", "rid", "words").join(classes.select("words", "node", "class_id", "n_copies", F.col("rid").alias("class_rid")), "words", "left")
    named = named.join(grouped, "node", "left")
    alone = F.coalesce("doc_id", -F.abs(F.xxhash64("rid") % (1 << 62)) - 1)
    named = named.withColumn("class_id", F.coalesce("class_id", alone)).withColumn("group_id", F.coalesce("group_id", "class_id"))
    kept = F.col("rid") == F.coalesce("head_rid", "class_rid", "rid")
    return named.select("doc_id", "rid", "class_id", F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), "group_id", kept.alias("kept"))
