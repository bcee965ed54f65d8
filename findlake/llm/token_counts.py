"""Token counts without token ids: pieces are counted once per distinct pre-token and summed over each document."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Above this the Unicode tables of two regular-expression libraries may differ; such texts are split by the tokenizer's own code.
_BEYOND = regex.compile("[^\x00-ɏ]")
#: Documents of a task whose postings are held together (their numbers fit in 16 bits), and postings that end a block before that.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 4_000_000
#: Tasks (a power of two) whose blocks meet by pre-token.
TASKS_BITS = 6
#: Pre-tokens whose counts a task remembers; beyond it forgets them all and counts anew.
REMEMBER = 500_000


@lru_cache(maxsize=2)
def _splitter(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    special = [t["content"] for t in parts["added_tokens"] if t["special"]]
    split = next(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    return tokenizer, regex.compile(split["pattern"]["Regex"]), cut


def pre_tokens(text: str, path: str) -> tuple[Counter, int]:
    """How often each pre-token of the normalised text occurs, and how many special strings stand in the text."""
    tokenizer, pattern, cut = _splitter(path)
    parts = cut.split(text) if cut else [text]
    found: Counter = Counter()
    for part in parts:
        if not part:
            continue
        plain = tokenizer.normalizer.normalize_str(part)
        if plain.isascii() or not _BEYOND.search(plain):
            found.update(pattern.findall(plain))
        else:
            found.update(plain[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(plain))
    return found, len(parts) - 1


def _postings(path: str):
    """Rows of a task: each document once (word null), and each distinct pre-token of a block with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        vocabulary: dict[str, int] = {}
        ids: list[int] = []
        counts: list[int] = []
        owners: list[tuple[int, int]] = []
        docs: list[tuple[int, int | None, int, int]] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal base
            words = list(vocabulary)
            word = np.array(ids, np.int32)
            count = np.array(counts, np.int64)
            owner = np.repeat(np.array([o for o, _ in owners], np.uint16), [n for _, n in owners])
            while len(count) and count.max() > 255:  # a count of many fills several bytes-sized entries
                big = np.flatnonzero(count > 255)
                word, owner = np.concatenate([word, word[big]]), np.concatenate([owner, owner[big]])
                count = np.concatenate([np.where(count > 255, count - 255, count), np.full(len(big), 255)])
            order = np.argsort(word, kind="stable")
            owner, count = owner[order].tobytes(), count[order].astype(np.uint8).tobytes()
            edge = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]).tolist()
            for i in range(0, len(words), 100_000):
                k = range(i, min(i + 100_000, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[i : i + 100_000], pa.string()), pa.array(np.full(len(k), base)), pa.array([owner[2 * edge[j] : 2 * edge[j + 1]] for j in k], pa.binary()), pa.array([count[edge[j] : edge[j + 1]] for j in k], pa.binary()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64())],
                    names=NAMES,
                )
            if docs:
                none = pa.nulls(len(docs))
                yield pa.RecordBatch.from_arrays(
                    [none.cast(pa.string()), pa.array([base + d[0] for d in docs], pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array([d[1] for d in docs], pa.int64()), pa.array([d[2] for d in docs], pa.int64()), pa.array([d[3] for d in docs], pa.int64())], names=NAMES
                )
            base += 1 << 15
            for x in (vocabulary, ids, counts, owners, docs):
                x.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found, special = pre_tokens(text, path)
                ids += [vocabulary.setdefault(w, len(vocabulary)) for w in found]
                counts += found.values()
                owners.append((len(docs), len(found)))
                docs.append((len(docs), doc_id, len(text.encode("utf-8", "surrogatepass")), special))
                if len(docs) >= BLOCK_DOCS or len(ids) >= BLOCK_POSTINGS:
                    yield from block()
        yield from block()

    return run


NAMES = ["word", "base", "owners", "counts", "doc_id", "n_bytes", "n_special"]


def _sums(path: str):
    """Partial sums per document of what the pre-tokens of one partition add to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _splitter(path)[0]
        known: dict[str, int] = {}
        sums: dict[int, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            packed = []
            for base, total in sums.items():
                at = np.flatnonzero(total)
                packed.append((base, at.astype(np.uint16).tobytes(), total[at].astype(np.uint32).tobytes()))
            none = pa.nulls(len(packed), pa.int64())
            columns = zip(*packed, strict=True) if packed else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)), none, none, none, none], names=SUMS)
            sums.clear()

        for batch in batches:
            words = batch.column(0)
            docs = batch.filter(words.is_null())
            if len(docs):
                at = docs.column(1).to_numpy()
                none = pa.nulls(len(docs), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at - at % BLOCK_DOCS), none, none, pa.array(at % BLOCK_DOCS), docs.column(4), docs.column(5), docs.column(6)], names=SUMS)
                batch = batch.filter(words.is_valid())
            if not len(batch):
                continue
            words = batch.column(0).to_pylist()
            if len(known) > REMEMBER:
                known.clear()
            new = list({w for w in words if w not in known})
            if new:
                known.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            pieces = np.array([known[w] for w in words], np.int64)
            bases = batch.column(1).to_numpy()
            blobs, times = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            lens = np.array([len(t) for t in times])
            owner = np.frombuffer(b"".join(blobs), np.uint16)
            value = np.frombuffer(b"".join(times), np.uint8) * np.repeat(pieces, lens)
            of = np.repeat(bases, lens)
            order = np.argsort(of, kind="stable")
            of, owner, value = of[order], owner[order], value[order]
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:], strict=False):
                total = sums.setdefault(int(of[a]), np.zeros(BLOCK_DOCS, np.int64))
                total += np.bincount(owner[a:b], value[a:b], minlength=BLOCK_DOCS).astype(np.int64)
            if len(sums) > 256:
                yield from emit()
        yield from emit()

    return run


SUMS = ["block", "owners", "sums", "place", "doc_id", "n_bytes", "n_special"]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block with the sums of all partitions added up; rows of a block follow each other."""
    block, total, docs = None, np.zeros(BLOCK_DOCS, np.int64), []

    def done() -> Iterator[pa.RecordBatch]:
        for d in docs:
            at = d.column(3).to_numpy()
            n = total[at] + d.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([d.column(4), d.column(5), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if blocks[a] != block:
                yield from done()
                block, docs = blocks[a], []
                total[:] = 0
            part = batch.slice(a, b - a)
            packed = part.column(1).is_valid()
            for at, n in zip(part.filter(packed).column(1).to_pylist(), part.filter(packed).column(2).to_pylist(), strict=True):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
            docs.append(part.filter(part.column(1).is_null()))
    yield from done()


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text), as encoding whole texts gives.

    Each task lists the distinct pre-tokens of a block of its documents with the documents that hold them, so one row
    leaves it for each pre-token and block rather than for each occurrence. Rows meet by pre-token: pieces are counted
    once for it, and the partial sums of a block go on packed in one row. A pre-token that every document has is one row
    a block; the blocks of every 64 tasks meet apart from others', so its rows do not all go to one task, and its pieces
    are counted once for 64 tasks.

    A null text counts as empty, and an empty text has no tokens. Null ids and repeated rows stay: a row comes out for
    every row that goes in. Other columns are not read. Special strings inside a text count as one token each, as the
    library has it by default. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = rows.mapInArrow(_postings(tokenizer_path), "word string, base long, owners binary, counts binary, doc_id long, n_bytes long, n_special long")
    met = listed.repartition(F.coalesce("word", F.col("base").cast("string")), F.shiftright("base", 33 + TASKS_BITS))
    sums = met.mapInArrow(_sums(tokenizer_path), "block long, owners binary, sums binary, place long, doc_id long, n_bytes long, n_special long")
    total = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
    return total.withColumn("over_limit", F.col("n_tokens") > limit)
