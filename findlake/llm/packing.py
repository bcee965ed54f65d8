"""Best-fit packing of tokenised documents into sequences, planned on the counts of lengths alone."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.shared import materialise

_BEYOND = regex.compile("[^\x00-ɏ]")


@lru_cache(maxsize=2)
def _encoder(json_path: str, rank_path: str | None):
    """ids of a text as the tokenizers library gives them. Where a rank file of the same vocabulary is given, Latin text
    goes through it, which is several times faster and gives the same ids; anything else through the library itself."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def slow(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    if not rank_path:
        return slow
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if text.isascii() or not _BEYOND.search(text):
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        return slow(text)

    return encode


def _pieces(json_path: str, rank_path: str | None, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, rank_path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    out.append((doc_id, k, a, b - a, zlib.crc32(raw), raw if keep_ids else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, offset): items of a length, numbered from 0, in runs that go to
    consecutive bins at one offset.

    Items above a third of the capacity are matched first, the longest with the longest that still fits beside it, two
    a bin at most. The rest go, longest first, into the smallest gap that holds them; bins with equal gaps are filled
    together, so the work depends on the number of lengths, not of items.
    """
    left = Counter({k: v for k, v in counts.items() if v})
    used: Counter = Counter()
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of bins (first, end)
    sizes: list[int] = []  # gaps that exist, ascending
    bins = 0

    def put(length: int, first: int, n: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, offset))
        used[length] += n
        left[length] -= n

    def gap(size: int, first: int, end: int) -> None:
        if size and end > first:
            if not gaps[size]:
                insort(sizes, size)
            gaps[size].append((first, end))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            mate = next((m for m in reversed(large) if m <= min(length, capacity - length) and left[m] and (m != length or left[m] > 1)), None)
            n = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
            put(length, bins, n, 0)
            if mate is not None:
                put(mate, bins, n, length)
            gap(capacity - length - (mate or 0), bins, bins + n)
            bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                n = max(1, left[length] // each)
                many = min(each, left[length])
                for k in range(many):
                    put(length, bins, n, k * length)
                gap(capacity - many * length, bins, bins + n)
                bins += n
                continue
            size = sizes[at]
            first, end = gaps[size].pop()
            if not gaps[size]:
                sizes.pop(at)
            n = min(end - first, left[length])
            put(length, first, n, capacity - size)
            gap(size - length, first, first + n)
            gap(size, first + n, end)
    return runs


def pack_documents(docs: DataFrame, json_path: str, rank_path: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False, items_per_task: int = 100_000) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if kept).

    A document is its token ids and then end_id; a longer one than the capacity is cut from its end into pieces of the
    capacity, so that only piece 0 may be shorter. Pieces are written once. The plan is made on the driver from the
    number of pieces of each length - `capacity` numbers, however large the corpus - and comes back as a small table
    of runs that each piece finds by its length and its rank among equals. Ranks are counted within hashed shares of a
    length and shifted by the sizes of the shares before, so no task sees all pieces of a common length.

    A null text is empty and gives one piece that holds end_id alone. Null ids and repeated rows are packed like any
    other. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(json_path, rank_path, end_id, capacity, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = materialise(pieces if keep_ids else pieces.drop("ids"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    shares = max(16, -(-sum(counts.values()) // items_per_task))
    shared = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    before = shared.groupBy("length", "share").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))).select("length", "share", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # at most a few runs a length: the table's size is bounded by the capacity
    runs = docs.sparkSession.createDataFrame(plan_bins(counts, capacity), "length long, first long, end long, bin long, offset long")
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).drop(runs["length"])
    held = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *(["ids"] if keep_ids else []))
    return held
