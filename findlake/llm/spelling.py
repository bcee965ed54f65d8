"""Words that differ by one edit, found by blocked Gram matrices of their letter counts, and the frequent form of each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.shared import materialise

#: Letters are dealt to this many classes; the counts of the classes refine a block of words of one length.
CLASSES = 4
#: Words of a tile, and cells (words times letters of the longest) that bound it where words are long.
TILE, CELLS = 4096, 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, rare: int = 199) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, with their occurrences over all documents.

    The code point h % length of a run is deleted where `rare` divides h, the crc32 of `<doc_id>:<run>`. A null id
    counts as an empty one here. Results below `least_length` code points or `least_count` occurrences are left out;
    only runs that are long enough before a deletion leave the scan. A null text has no runs.
    """
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % rare == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def near_pairs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with a[i] and b[j] one edit apart; words of a have one length, those of b the same or one more.

    With letter counts x and y, |x|² + |y|² - 2xy is one product of matrices. One replaced code point makes it 2 and
    one inserted 1, so only pairs up to 2 are looked at letter by letter.
    """
    left, right = _points(a), _points(b)
    letters = np.unique(np.concatenate([np.unique(left), np.unique(right)]))
    x, y = (np.stack([(p == letter).sum(1) for letter in letters], 1).astype(np.float64 if right.shape[1] > 2000 else np.float32) for p in (left, right))
    one_x, one_y = np.ones((len(x), 1), x.dtype), np.ones((len(y), 1), y.dtype)
    squared = np.hstack([x, (x * x).sum(1, keepdims=True), one_x]) @ np.hstack([-2 * y, one_y, (y * y).sum(1, keepdims=True)]).T
    i, j = np.divmod(np.flatnonzero(squared < 2.5), len(b))
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), step := max(1, CELLS // right.shape[1])):
        p, q = left[i[k : k + step]], right[j[k : k + step]]
        if p.shape[1] == q.shape[1]:
            keep[k : k + step] = (p != q).sum(1) == 1
        else:
            # what is equal from the start and what is equal from the end of the shorter word cover it
            ahead = np.logical_and.accumulate(p == q[:, :-1], 1).sum(1)
            behind = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], 1).sum(1)
            keep[k : k + step] = ahead + behind >= p.shape[1]
    return i[keep], j[keep]


def _class_counts(words: pd.Series) -> np.ndarray:
    out = np.zeros((len(words), CLASSES), np.int32)
    for k, w in enumerate(words):
        out[k] = np.bincount(np.frombuffer(w.encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES)
    return out


def _shifts() -> list[tuple[int, ...]]:
    """What one edit adds to the class counts of the first word, where the second is not shorter: of each pair of blocks,
    one is the first."""
    unit = np.eye(CLASSES, dtype=int)
    moved = {tuple(map(int, unit[i] - unit[j])) for i in range(CLASSES) for j in range(CLASSES)}
    zero = (0,) * CLASSES
    return sorted(s for s in moved if s >= zero) + [tuple(map(int, u)) for u in unit]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = _class_counts(batch["word"])
        yield batch.assign(block=[",".join(map(str, c)) for c in counts.tolist()])


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each word once for each pair of blocks that its own is in, as first (0) and as second (1)."""
    shifts = np.array(_shifts())
    for batch in batches:
        own = np.array([[int(c) for c in b.split(",")] for b in batch["block"]]).reshape(-1, CLASSES)
        for s in shifts:
            for side, other in ((0, own + s), (1, own - s)):
                fits = (other >= 0).all(1)
                name = [",".join(map(str, c)) for c in other[fits].tolist()]
                part = batch[fits]
                first, second = (part["block"], name) if side == 0 else (name, part["block"])
                yield part.assign(first=first, second=second, side=side, other=name)


def _compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of every word in a pair of tiles: how many near words it has there, and the best one's (count, word)."""
    first, second, i, j = key
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(a) or not len(b):
        return pd.DataFrame([], columns=["word", "n_near", "form_n", "form"], dtype=object)
    if first == second and i == j:
        b = a  # a tile against itself, in one order
    x, y = near_pairs(a["word"].tolist(), b["word"].tolist())
    if b is a:
        x, y = x[x < y], y[x < y]
    wa, wb, na, nb = a["word"].tolist(), b["word"].tolist(), a["n"].tolist(), b["n"].tolist()
    near = np.bincount(x, minlength=len(a)), np.bincount(y, minlength=len(b))
    rows: list[tuple] = []
    for own, other, n, at, to, count in ((wa, wb, nb, x, y, near[0]), (wb, wa, na, y, x, near[1])):
        # per word its best partner first: the largest n, then the smallest by code point, as Python compares strings
        rank = np.empty(len(other), np.int64)
        rank[sorted(range(len(other)), key=lambda k: (-n[k], other[k]))] = np.arange(len(other))
        order = np.lexsort((rank[to], at))
        words, first = np.unique(at[order], return_index=True)
        rows += [(own[w], int(count[w]), int(n[k]), other[k]) for w, k in zip(words.tolist(), to[order][first].tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"], dtype=object)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, form_n, form) for every word of (word, n) with a near one: how many differ by exactly one inserted,
    deleted or replaced code point, and of these the one of the largest n, the smallest of equals.

    A block is the words of equal counts of letters in CLASSES classes (and so of one length). One edit changes these
    counts by one unit in one class, or by one unit each in two, so a block meets only those blocks of its own and the
    next length: 1 + (CLASSES² - CLASSES) / 2 and CLASSES of them as the first of a pair. Blocks are dealt in tiles of
    at most about `tile` words by hash, and a task compares two tiles in one product; a large block is many tasks.
    Tasks return one row a word, not the pairs.
    """
    blocked = materialise(words.mapInPandas(_blocks, "word string, n long, block string"), "blocks")
    tiles = F.ceil(F.count("*") / F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.max(F.length("word")))))).cast("long")
    sizes = materialise(blocked.groupBy("block").agg(tiles.alias("tiles")), "tiles")
    met = blocked.mapInPandas(_meetings, "word string, n long, block string, first string, second string, side int, other string")
    own, other = sizes.select("block", F.col("tiles").alias("own_tiles")), sizes.select(F.col("block").alias("other"), F.col("tiles").alias("other_tiles"))
    # only pairs of blocks that both exist
    met = met.join(own, "block").join(other, "other").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("own_tiles")))
    met = met.withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_tiles") - 1)))
    met = met.withColumn("i", F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("theirs"))).withColumn("j", F.when(F.col("side") == 0, F.col("theirs")).otherwise(F.col("mine")))
    # within a block, tiles i > j are the same comparison as j, i
    met = met.where("first <> second or i <= j").select("word", "n", "first", "second", "side", "i", "j")
    seen = met.groupBy("first", "second", "i", "j").applyInPandas(_compare, "word string, n_near long, form_n long, form string")
    # strings compare by code point
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return seen.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def with_roots(words: DataFrame, ratio: int) -> DataFrame:
    """(word, form, ...) with `root`: where following forms from a word ends, itself if it has none.

    A form's n is at least `ratio` times the word's, so a chain is no longer than the logarithm of the largest n; each
    round of joins doubles the steps that are behind a word."""
    most = words.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, ratio)) + 1
    links = materialise(words.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    for _ in range(math.ceil(math.log2(steps + 1))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialise(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return words.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, rare: int = 199, tile: int = TILE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    The form of a word is its near word of the largest n if that is at least `ratio` times its own n, else null; the
    root is where forms lead to. Null texts and texts without letters have no words; a row that is repeated counts
    each time; texts are read whole; other columns are not read; an empty table gives no rows.
    """
    words = materialise(word_counts(docs, least_length, least_count, rare), "words")
    near = words.join(near_words(words, tile), "word", "left")
    chosen = F.col("form_n") >= ratio * F.col("n")
    formed = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n"))
    return with_roots(materialise(formed, "formed"), ratio).select("word", "form", "root", "n", "n_near", "form_n")
