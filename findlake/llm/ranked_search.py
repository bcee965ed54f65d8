"""Ranked search: block-compressed posting lists by shard, and Block-Max MaxScore over them with heaps that shards share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.shared import content_key, materialise
from findlake.llm.totals import running_totals

#: Terms are runs of digits, letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a block, bytes of text of a shard (one longer text is a shard of its own), documents of a shard.
BLOCK, SHARD_BYTES, SHARD_DOCS = 128, 1 << 24, 1 << 15
#: (item, term) pairs that a pass over the index holds, besides those of its last item.
PAIRS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = np.arange(256, dtype=np.uint8)
_IN_TERM = (_BYTES >= 128) | np.isin(_BYTES, np.frombuffer(f"0123456789{_UPPER}{_LOWER}".encode(), np.uint8))
_LOWERED = np.where(np.isin(_BYTES, np.frombuffer(_UPPER.encode(), np.uint8)), _BYTES + 32, _BYTES).astype(np.uint8)

INDEX = "shard long, term string, block int, first int, last int, n int, tf_most array<int>, n_least array<int>, packed binary, doc_ids array<long>, lengths array<long>"


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the lowest first, the last of each below 128; and the bytes of each number."""
    values = values.astype(np.int64)
    widths = np.ones(len(values), np.int64)
    for k in range(1, 9):
        widths += values >= 1 << 7 * k
    starts = np.cumsum(widths) - widths
    out = np.zeros(int(widths.sum()), np.uint8)
    for k in range(int(widths.max(initial=0))):
        held = widths > k
        out[starts[held] + k] = (values[held] >> 7 * k & 127) | np.where(widths[held] > k + 1, 128, 0)
    return out, widths


def unpack_numbers(packed: np.ndarray) -> np.ndarray:
    if not len(packed):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(packed < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    places = np.arange(len(packed)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((packed & 127).astype(np.int64) << 7 * places, starts)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _shard(number: int, ids: pa.Array, raw: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: a head with its documents by id, and the blocks of the list of each of its terms."""
    n_docs = len(ids)
    order = np.array(pc.sort_indices(ids, null_placement="at_end"))
    place = np.empty(n_docs, np.int64)
    place[order] = np.arange(n_docs)
    held = _IN_TERM[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[bounds] = True
    edge = np.concatenate([[False], held, [False]])
    starts = np.flatnonzero(held & (~edge[:-2] | fresh[:-1]))
    ends = np.flatnonzero(held & (~edge[2:] | fresh[1:])) + 1
    owner = np.searchsorted(bounds, starts, "right") - 1
    lengths = np.bincount(owner, minlength=n_docs)[order]
    head = {"shard": [number], "doc_ids": pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64()))}
    yield _batch(1, head)
    if not len(starts):
        return
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(_LOWERED[raw[held]])]).dictionary_encode()
    keys, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n_docs + place[owner], return_counts=True)
    code, doc = np.divmod(keys, n_docs)
    at = np.arange(len(code))
    of_list = at - np.searchsorted(code, code)
    opens = of_list % BLOCK == 0
    block = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(code)]]) - 1
    gap = np.diff(doc, prepend=0)
    gap[first] = 0
    packed, widths = pack_numbers(np.stack([gap, tf], 1).reshape(-1))
    sizes = np.add.reduceat(widths, 2 * first)
    # of a block, the postings that no other one beats in both more occurrences and a shorter document
    n = lengths[doc]
    by = np.lexsort((n, -tf, block))
    low = np.minimum.accumulate(n[by] - block[by] * (int(n.max()) + 1))
    kept = by[np.concatenate([[True], low[1:] < low[:-1]])]
    kept_ends = np.concatenate([[0], np.cumsum(np.bincount(block[kept], minlength=len(first)))])
    rows = {
        "shard": np.full(len(first), number),
        "term": words.dictionary.take(pa.array(code[first])).cast(pa.string()),
        "block": (of_list[first] // BLOCK).astype(np.int32),
        "first": doc[first].astype(np.int32),
        "last": doc[last].astype(np.int32),
        "n": (last - first + 1).astype(np.int32),
        "tf_most": _lists(kept_ends, pa.array(tf[kept].astype(np.int32))),
        "n_least": _lists(kept_ends, pa.array(n[kept].astype(np.int32))),
        "packed": pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(packed)]),
    }
    whole = _batch(len(first), rows)
    for k in range(0, len(first), 10_000):
        yield whole.slice(k, 10_000)


_ARROW = pa.schema(
    [("shard", pa.int64()), ("term", pa.string()), *[(c, pa.int32()) for c in ("block", "first", "last", "n")], ("tf_most", pa.list_(pa.int32())), ("n_least", pa.list_(pa.int32())), ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(texts):
            b = min(max(a + 1, int(np.searchsorted(bounds, bounds[a] + SHARD_BYTES, "right")) - 1), a + SHARD_DOCS, len(texts))
            yield from _shard(number, ids.slice(a, b - a), raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            number += 1
            a = b


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs, written: for each shard a row with its documents (doc_ids in order, lengths in terms), and a
    row for each block of a term's list.

    A block has its first and last document, its number of postings, the pairs of occurrences and document length that
    no other posting of it beats (they give the exact largest weight of a block for any corpus statistics), and its
    postings as gaps and occurrences in bytes of seven bits. Null texts are empty; every row is a document.
    """
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_build, INDEX), "index")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What an occurrence count adds to a score, before the weight of its term."""
    m = 100 - 25 + (25 * n.astype(np.int64) * docs) // total
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


class _List:
    """The blocks of one term in one shard, in order of documents."""

    def __init__(self, first: np.ndarray, last: np.ndarray, n: np.ndarray, most: np.ndarray, packed: list[bytes]):
        self.first, self.last, self.n, self.most, self.packed = first, last, n, most, packed
        self.bound = int(most.max())
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences of some blocks."""
        values = unpack_numbers(np.frombuffer(b"".join(self.packed[k] for k in blocks.tolist()), np.uint8))
        gap, tf = values[::2], values[1::2]
        run = np.cumsum(gap)
        starts = np.cumsum(self.n[blocks]) - self.n[blocks]
        return run + np.repeat(self.first[blocks] - run[starts], self.n[blocks]), tf

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            self.whole = self.decode(np.arange(len(self.packed)))
        return self.whole


@dataclass
class Heap:
    """The best documents so far, by falling score and then rising id; ids without a value come last."""

    k: int
    ids: np.ndarray
    none: np.ndarray
    scores: np.ndarray

    @classmethod
    def empty(cls, k: int) -> Heap:
        return cls(k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    @property
    def least(self) -> int:
        """A score below this one does not get in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def push(self, ids: np.ndarray, none: np.ndarray, scores: np.ndarray) -> None:
        ids, none, scores = np.concatenate([self.ids, ids]), np.concatenate([self.none, none]), np.concatenate([self.scores, scores])
        best = np.lexsort((ids, none, -scores))[: self.k]
        self.ids, self.none, self.scores = ids[best], none[best], scores[best]


@dataclass
class Work:
    """What a search has read, for tests: postings in lists and postings decoded."""

    postings: int = 0
    decoded: int = 0


def search_shard(lists: dict[int, _List], items: list[list[tuple[int, int]]], heaps: list[Heap], lengths: np.ndarray, ids: np.ndarray, none: np.ndarray, docs: int, total: int, work: Work | None = None) -> None:
    """Put a shard's documents into the items' heaps. items: (term, weight times repeats) of each.

    By its lists' largest weights, an item's lists are non-essential as long as they sum to less than the heap's least
    score: a document in these alone cannot get in. The essential ones are read, and make the candidates. What
    non-essential lists can add to a candidate is then bounded by the block that the candidate would be in, and
    candidates below the heap's least score are rejected before any of those blocks is decoded; the other blocks are
    decoded list by list, the largest first, and each time rejects more.
    """
    n_docs = len(lengths)
    for item, heap in zip(items, heaps, strict=True):
        have = sorted(((lists[t].bound * w, t, w) for t, w in item if t in lists and w), key=lambda x: (x[0], x[1]))
        least = heap.least
        sums = np.cumsum([b for b, _, _ in have], dtype=np.int64)
        cut = int(np.searchsorted(sums, least, "left"))  # lists before it sum to less
        if cut == len(have):
            continue
        score = np.zeros(n_docs, np.int64)
        for _, t, w in have[cut:]:
            at, tf = lists[t].all()
            score[at] += w * impact(tf, lengths[at], docs, total)
            if work:
                work.decoded += len(at)
        rest = int(sums[cut - 1]) if cut else 0
        found = np.flatnonzero(score)
        found = found[score[found] + rest >= least]
        looked, could = [], score[found]
        for _, t, w in reversed(have[:cut]):
            held = lists[t]
            k = np.searchsorted(held.last, found)
            inside = k < len(held.last)
            inside[inside] = held.first[k[inside]] <= found[inside]
            bound = np.zeros(len(found), np.int64)
            bound[inside] = w * held.most[k[inside]]
            could = could + bound
            looked.append((held, w, k, inside, bound))
        alive = np.flatnonzero(could >= least)
        for held, w, k, inside, bound in looked:
            into = alive[inside[alive]]
            if len(into):
                blocks = np.unique(k[into])
                at, tf = held.all() if held.whole is not None else held.decode(blocks)
                if work:
                    work.decoded += len(at)
                where = np.searchsorted(at, found[into])
                hit = where < len(at)
                hit[hit] = at[where[hit]] == found[into][hit]
                exact = np.zeros(len(into), np.int64)
                exact[hit] = w * impact(tf[where[hit]], lengths[found[into][hit]], docs, total)
                could[into] += exact - bound[into]
                alive = alive[could[alive] >= least]
        if work:
            work.postings += sum(int(lists[t].n.sum()) for _, t, _ in have)
        best = found[alive]
        heap.push(ids[best], none[best], could[alive])


def _search(queries, terms: dict[str, int], k: int, docs: int, total: int):
    """queries: broadcast list of (rid, [(term number, weight times repeats)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = queries.value
        items, numbers = [q[1] for q in held], terms.value
        heaps = [Heap.empty(k) for _ in items]

        def finish(parts: list[pa.Table]) -> None:
            t = pa.concat_tables(parts)
            head = t.filter(pc.is_null(t["term"]))
            if not head.num_rows:
                return
            ids = pc.list_flatten(head["doc_ids"]).combine_chunks()
            lengths = pc.list_flatten(head["lengths"]).to_numpy()
            t = t.filter(pc.is_valid(t["term"])).sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
            lists: dict[int, _List] = {}
            if t.num_rows:
                names = t["term"].to_pylist()
                counts = pc.list_value_length(t["tf_most"]).to_numpy()
                worth = impact(pc.list_flatten(t["tf_most"]).to_numpy(), pc.list_flatten(t["n_least"]).to_numpy(), docs, total)
                most = np.maximum.reduceat(worth, np.cumsum(counts) - counts)
                first, last, n, packed = t["first"].to_numpy(), t["last"].to_numpy(), t["n"].to_numpy(), t["packed"].to_pylist()
                a = 0
                for b in range(1, len(names) + 1):
                    if b == len(names) or names[b] != names[a]:
                        lists[numbers[names[a]]] = _List(first[a:b], last[a:b], n[a:b], most[a:b], packed[a:b])
                        a = b
            search_shard(lists, items, heaps, lengths, ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(ids.is_null()), docs, total)

        shard, parts = None, []
        for batch in batches:
            numbers_of = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers_of)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers_of)], strict=True):
                if a < b:
                    if parts and numbers_of[a] != shard:
                        finish(parts)
                        parts = []
                    shard = numbers_of[a]
                    parts.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if parts:
            finish(parts)
        rows = [(rid, None if x else int(i), int(s)) for (rid, _), h in zip(held, heaps, strict=True) for i, x, s in zip(h.ids, h.none, h.scores, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["rid", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each row of items.

    The index is built once. Items are taken in passes of at most `pairs` (item, term) pairs and one item more; a pass
    reads the blocks of its terms alone, deals them by shard, and a task carries the items' heaps from shard to shard,
    so later shards are read against thresholds that earlier ones set. Tasks return their heaps; the best of them are
    the answer.

    A null text has no terms: such a document is found by nothing and such an item finds nothing. Equal scores go by
    rising doc_id, null last; every row of docs is a document and every row of items is asked, repeated ones too.
    Other columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    heads, lists = index.where("term is null"), index.where("term is not null")
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    n, total = heads.agg(F.sum(F.size(F.filter("lengths", lambda x: x > 0)).cast("long")), F.sum(length)).first()
    asked = materialise(items.select(F.col("item_id"), content_key("item_id").alias("rid"), F.col("text").cast("string").alias("text")), "items")
    terms = asked.dropDuplicates(["rid"]).select("rid", F.explode(_terms(F.col("text"))).alias("term")).groupBy("rid", "term").agg(F.count("*").alias("repeats"))
    df = lists.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((2.0 * (n or 0) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = materialise(terms.join(df, "term").select("rid", "term", (weight * F.col("repeats")).alias("weight")), "item-terms")
    sizes = running_totals(weighted.groupBy("rid").agg(F.count("*").alias("pairs")), ["rid"], {"before": "pairs"})
    passed = materialise(weighted.join(sizes.select("rid", F.floor(F.col("before") / pairs).cast("int").alias("pass")), "rid"), "item-passes")
    most = passed.agg(F.max("pass")).first()[0]
    found = []
    for p in range(most + 1 if most is not None else 0):
        mine = passed.where(F.col("pass") == p)
        # bounded by `pairs` and one item's terms
        queries: dict[bytes, list[tuple[int, int]]] = {}
        numbers: dict[str, int] = {}
        for r in mine.select("rid", "term", "weight").toLocalIterator():
            queries.setdefault(bytes(r["rid"]), []).append((numbers.setdefault(r["term"], len(numbers)), r["weight"]))
        shared, named = spark.sparkContext.broadcast(sorted(queries.items())), spark.sparkContext.broadcast(numbers)
        wanted = lists.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi").unionByName(heads)
        dealt = wanted.repartition("shard").sortWithinPartitions("shard")
        found.append(materialise(dealt.mapInArrow(_search(shared, named, k, n, total), "rid binary, doc_id long, score long"), "heaps"))
        shared.destroy()
        named.destroy()
    if not found:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    heaps = found[0]
    for f in found[1:]:
        heaps = heaps.unionByName(f)
    best = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return asked.select("item_id", "rid").join(best, "rid").select("item_id", "rank", "doc_id", "score")
