"""Near-duplicate embeddings by int8 tile products with error bounds, exact where a bound leaves doubt."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.components import connected_components
from findlake.llm.shared import materialise


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, scale, error, length) of unit vectors: v = scale * codes + e with |e| <= error and |scale * codes| <= length."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None]).clip(-127, 127)
    close = codes * scale[:, None]
    slack = 1 + 1e-12
    return codes.astype(np.int8), scale, np.linalg.norm(vectors - close, axis=1) * slack + 1e-15, np.linalg.norm(close, axis=1) * slack


#: Products of codes are whole numbers that float32 holds exactly up to this many components at a time.
_EXACT = (1 << 24) // (127 * 127)


def _code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], _EXACT):
        total += a[:, i : i + _EXACT].astype(np.float32) @ b[:, i : i + _EXACT].astype(np.float32).T
    return total


class _Forest:
    """Links of one tile pair, thinned to the edges that connect the same rows. All links of a block are taken together."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.up = ids, np.arange(len(ids))

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.up[left], self.up[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                higher = self.up[self.up]
                if (higher == self.up).all():
                    break
                self.up = higher

    def edges(self) -> list[tuple[int, int]]:
        some = np.flatnonzero(self.up != np.arange(len(self.up)))
        return list(zip(self.ids[self.up[some]].tolist(), self.ids[some].tolist(), strict=True))


def _compare(threshold: float, block: int = 512):
    """A pair of tiles, or a tile with itself: links of each class counted by its vectors, and edges that connect them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable").reset_index(drop=True)
        ids, n = group["id"].to_numpy(), group["n"].to_numpy()
        vectors = np.array(group["v"].tolist(), np.float64)
        mine = group["tile"].to_numpy() == group["lo"].to_numpy()
        one = bool(group["lo"].iloc[0] == group["hi"].iloc[0])
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        codes, scale, error, length = quantise(unit)
        a, b = (np.arange(len(ids)), np.arange(len(ids))) if one else (np.flatnonzero(mine), np.flatnonzero(~mine))
        links, forest = np.zeros(len(ids), np.int64), _Forest(ids)
        for i in range(0, len(a), block):
            p = a[i : i + block]
            for j in range(i if one else 0, len(b), block):
                q = b[j : j + block]
                about = _code_products(codes[p], codes[q]) * scale[p][:, None] * scale[q][None, :]
                # |x.y - x'.y'| <= |x'||e_y| + |e_x||y|, with |y| = 1
                bound = length[p][:, None] * error[q][None, :] + error[p][:, None] * (1 + 1e-9) + 1e-12
                maybe = np.nonzero(about + bound >= threshold)
                if one and i == j:
                    keep = maybe[0] < maybe[1]
                    maybe = maybe[0][keep], maybe[1][keep]
                sure = (about - bound)[maybe] >= threshold + 1e-9
                x, y = p[maybe[0]], q[maybe[1]]
                for k in np.array_split(np.flatnonzero(~sure), max(1, int((~sure).sum()) // 65536)):
                    sure[k] = np.einsum("ij,ij->i", unit[x[k]], unit[y[k]]) >= threshold
                x, y = x[sure], y[sure]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                forest.link(x, y)
        some = np.flatnonzero(links)
        rows = [(int(ids[k]), None, int(links[k])) for k in some] + [(a, b, 0) for a, b in forest.edges()]
        return pd.DataFrame(rows, columns=["a", "b", "links"]).astype({"a": "int64", "b": "Int64", "links": "int64"})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = 1024, most: int = 1 << 21) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label with cosine of at least `threshold` are linked; n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable, and kept says that it is the row's own.

    Equal vectors of a label are one class with a count, so copies are never compared with each other. Classes are
    dealt by hash to tiles, and a task compares two tiles block by block: products of int8 codes with a bound on
    their error from each vector's own quantisation error settle most pairs, and double precision the rest. Tasks
    return counts and connecting edges, not pairs. A label has as many tiles as give each core a pair of them, of
    `tile` classes at least and `most` components (16 MB) at most, so what a task holds is bounded and a vector is sent
    to few tiles: to (classes of its label) * (components) / `most` of them where a label is large.

    Links need a label and a vector that is not null, not zero and has only finite components: rows without have 0
    links and their own id. Vectors of different lengths in a label are not compared. A row without vec_id counts as a
    link of others, has null as component and is kept; rows that repeat a vec_id are counted as other rows. Other
    columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    fits = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fits = fits & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    # -0.0 equals 0.0 in every product, so both have one key; values far out of range are scaled before they are squared
    largest = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / largest + F.lit(0.0))
    keyed = plain.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("v", F.when(F.col("fits"), scaled)).withColumn("key", F.when(F.col("fits"), F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("v").cast("array<string>")))))
    keyed = materialise(keyed, "vectors")
    classes = keyed.where("fits").groupBy("label", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = classes.withColumn("id", F.coalesce("id", -F.abs(F.xxhash64("key") % (1 << 62)) - 1)).withColumn("dim", F.size("v"))
    classes = materialise(classes, "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    side = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    tiles = F.greatest(F.ceil(F.col("size") * F.col("dim") / most), F.least(F.ceil(F.col("size") / tile), F.lit(side))).cast("int")
    tiled = classes.join(sizes, ["label", "dim"]).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("label", "dim", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "id", "n", "v")
    compared = pairs.groupBy("label", "dim", "lo", "hi").applyInPandas(_compare(threshold), "a long, b long, links long")
    compared = materialise(compared, "compared")
    links = compared.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    group = connected_components(compared.where("b is not null").select("a", "b"))
    named = classes.select("label", "key", "id", "n").join(links, "id", "left").join(group, "id", "left")
    named = named.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
