"""Removal of byte strings that repeat anywhere in a corpus, by sorting suffixes at sampled places."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.shared import content_key, discard, give_back, materialise
from findlake.llm.words import mix

_rng = np.random.default_rng(41)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: Bytes of texts that are looked at together; arrays of 8 bytes for each of them, about a dozen at once.
CHUNK = 1 << 18
#: Rows of contexts and leads that leave a task together.
BATCH = 4096


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(str(base))
    if held is None or len(held) < n:
        held = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * CHUNK), base)]))
        _powers[str(base)] = held
    return held[:n]


class Anchors:
    """Places of a text that depend only on the bytes near them: the least hashed `gram` of each string of `span` bytes.

    Two equal strings of `span` bytes have the same places in them, wherever they stand, so every repeat is seen from one."""

    def __init__(self, span: int) -> None:
        self.span, self.gram = span, span * 2 // 7
        self.reach = span - self.gram  # a string starts at most so far before its place

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes of the grams) in the joined bytes of texts; no string crosses texts."""
        n, k, width = len(raw), self.gram, self.reach + 1
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[raw] * _power(_BASE, n), dtype=np.uint64)])
        back = _power(_BACK, n + 1)
        h = mix((prefix[k:] - prefix[:-k]) * back[: n - k + 1])
        low = np.uint64((1 << max(20, n.bit_length())) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // width) * width, ~np.uint64(0))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[: len(key) - width + 1], ahead[width - 1 : len(key)])
        inside = np.zeros(len(least) + 1, np.int32)
        long = ends - starts >= self.span
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - self.span + 1, -1)
        at = np.unique(least[np.cumsum(inside[:-1]) > 0] & low).astype(np.int64)
        return at, h[at]


def _joined(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, bytes, starts, ends) of about CHUNK bytes of texts."""
    held: list[bytes] = []
    index: list[int] = []
    for i, text in enumerate([*texts, None]):
        raw = (text or "").encode("utf-8", "replace")
        if held and (i == len(texts) or sum(map(len, held)) + len(raw) > CHUNK):
            ends = np.cumsum([len(x) for x in held])
            yield index, np.frombuffer(b"".join(held), np.uint8), ends - [len(x) for x in held], ends
            held, index = [], []
        held.append(raw)
        index.append(i)


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `words` (rows, symbols), and for each place of the order but the first the symbol at which
    its row differs from the one before (the number of symbols if it does not).

    Each run of rows that agree so far is split in three by a pivot, the median of three of their next symbols: smaller,
    equal, larger. Equal ones go on with the symbol after it. All runs are split together, one numpy step a round.
    """
    n, depth = words.shape
    order, differs = np.arange(n), np.full(n, depth)
    at = np.arange(n) if n > 1 and depth else np.zeros(0, np.int64)  # places in runs that are not done
    first, symbol = np.zeros(min(len(at), 1), np.int64), np.zeros(min(len(at), 1), np.int64)  # of each run
    while len(at):
        size = np.diff(np.append(first, len(at)))
        run = np.repeat(np.arange(len(first)), size)
        value = words[order[at], symbol[run]]
        three = np.sort(np.stack([value[first], value[first + size // 2], value[first + size - 1]]), axis=0)
        pivot = three[1][run]
        part = run * 3 + (value >= pivot) + (value > pivot)
        sort = np.argsort(part, kind="stable")
        order[at] = order[at][sort]
        part = part[sort]
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        inner = new[~np.isin(new, first)]
        differs[at[inner]] = symbol[run[inner]]
        size = np.diff(np.append(new, len(at)))
        deep = symbol[part[new] // 3] + (part[new] % 3 == 1)
        on = (size > 1) & (deep < depth)
        at = at[np.repeat(on, size)]
        symbol, size = deep[on], size[on]
        first = np.cumsum(size) - size
    return order, differs


def _common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the bytes that each has in common with the one before."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, differs = multikey_quicksort(words)
    common = np.full(len(rows), rows.shape[1])
    at = np.flatnonzero((differs < words.shape[1]) & (np.arange(len(rows)) > 0))
    x = words[order[at], differs[at]] ^ words[order[at - 1], differs[at]]
    common[at] = 8 * differs[at] + sum((x < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
    common[:1] = 0
    return order, common


def _table(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    width8 = -(-width // 8) * 8
    return np.frombuffer(b"".join(b.ljust(width8, b"\0") for b in blobs), np.uint8).reshape(-1, width8), np.array([len(b) for b in blobs])


def _sorted_buckets(length: int, span: int):
    """Rows of a bucket (context, doc, docs, near, far, left, right) -> (context, lo, hi, passage).

    lo, hi: bytes about the place that strings of `length` cover which another row of the bucket has too; passage: rows
    of another document share a string of `span` bytes. Suffixes are sorted by what follows the place, and by what
    stands before it, read backwards; neighbours in either order give what rows have in common. A string that starts d
    bytes before the place is repeated if two rows agree in d bytes before and length - d bytes after. Only starts from
    `near` to `far` are looked at; rows of different ranges are different buckets."""
    reach = Anchors(span).reach

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        bucket = pd.concat(held, ignore_index=True)
        n = len(bucket)
        right, r_len = _table(bucket["right"].tolist(), length)
        left, l_len = _table(bucket["left"].tolist(), reach)
        r_order, r_common = _common(right)
        l_order, l_common = _common(left)
        near, far, docs = (bucket[c].to_numpy() for c in ("near", "far", "docs"))
        doc = np.unique(np.array([bytes(x) for x in bucket["doc"]], object), return_inverse=True)[1]
        hits, passage = np.zeros((n, reach + 3), bool), np.zeros(n, bool)
        r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)

        def alike(d: int, size: int) -> tuple[np.ndarray, np.ndarray]:
            """Rows that could start a string of `size` bytes d before their place, and the first of each set of equal strings among them."""
            r_class[r_order] = np.cumsum(r_common < size - d)
            l_class[l_order] = np.cumsum(l_common < d)
            fits = np.flatnonzero((l_len >= d) & (r_len >= size - d) & (near <= d) & (far >= d))
            key = (r_class[fits] * (n + 1) + l_class[fits]) * (reach + 1) + near[fits]
            order = np.argsort(key)
            key = key[order]
            return fits[order], np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)

        for d in range(int(near.min()), int(far.max()) + 1):
            rows, first = alike(d, length)
            hits[rows, d + 1] = np.repeat(np.diff(np.append(first, len(rows))) > 1, np.diff(np.append(first, len(rows))))
            if d % _STRIDE == 0:
                rows, first = alike(d, span)
                if len(rows):
                    several = (np.minimum.reduceat(doc[rows], first) < np.maximum.reduceat(doc[rows], first)) | np.logical_or.reduceat(docs[rows], first)
                    passage[rows] |= np.repeat(several, np.diff(np.append(first, len(rows))))
        step = np.diff(hits.astype(np.int8), axis=1)
        row, begin = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        context = bucket["context"].to_numpy()
        yield pd.DataFrame({"context": context[row], "lo": (-(end - 1)).astype(np.int32), "hi": (length - begin).astype(np.int32), "passage": passage[row]})
        only = np.setdiff1d(np.flatnonzero(passage), row)
        yield pd.DataFrame({"context": context[only], "lo": np.zeros(len(only), np.int32), "hi": np.zeros(len(only), np.int32), "passage": passage[only]})
        del held, bucket, right, left, hits, step
        give_back()

    return run


#: A passage is looked for at every so many starts, and in crowded leads at every fourth of these: one of span + _STRIDE - 1
#: bytes is always found, in crowded leads one of span + 4 * _STRIDE - 1.
_STRIDE = 10
#: Starts of strings that are tried together where a lead has too many contexts for a bucket, then fewer, then each alone.
STEPS = (50, 10, 1)


def _leads(size: int, reach: int, step: int):
    """Of rows (context, left, right[, near, far]) a row for each run of `step` starts (within near to far): key, a digest
    of the bytes that all strings of `size` bytes have which start there. Rows that share none of these share no such string."""

    def table(batch: pd.DataFrame, out: list[tuple], kept: list[int]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["context", "near", "far", "key"]).astype({"near": "int32", "far": "int32"})
        for name in {"doc", "docs"} & set(batch.columns):
            found[name] = batch[name].to_numpy()[kept]
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, kept = [], []
            limits = zip(batch["near"], batch["far"], strict=True) if "near" in batch else ((0, reach) for _ in range(len(batch)))
            for i, (context, left, right, (first, last)) in enumerate(zip(batch["context"], batch["left"], batch["right"], limits, strict=True)):
                for near in range(first, last + 1, step):
                    far = min(near + step - 1, last)
                    if len(left) >= near and len(right) >= size - far:
                        core = left[:near][::-1] + right[: size - far]
                        out.append((context, near, far, hashlib.blake2b(core, digest_size=16, salt=near.to_bytes(8, "little")).digest()))
                        kept.append(i)
                if len(out) > BATCH:
                    yield table(batch, out, kept)
                    out, kept = [], []
            yield table(batch, out, kept)
            give_back()

    return run


def _contexts(length: int, reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["context", "n", "doc", "docs", "gram", "crowded", "left", "right"]
        for batch in batches:
            out = []
            for rid, packed, places in zip(batch["rid"], batch["packed"], batch["places"], strict=True):
                raw = zlib.decompress(packed)
                for p in places:
                    at = p["pos"]
                    out.append((p["context"], p["n"], rid, p["docs"], p["gram"], p["crowded"], raw[max(0, at - reach) : at][::-1], raw[at : at + length]))
                if len(out) > BATCH:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)
            give_back()

    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as compressed bytes, which are what is shuffled."""
    for batch in batches:
        texts = batch.pop("text")
        batch["packed"] = [zlib.compress((t or "").encode("utf-8", "replace"), 1) for t in texts]
        del texts
        yield batch
        give_back()


def _cut(keep_bytes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for packed, spans in zip(batch["packed"], batch["spans"], strict=True):
                raw = zlib.decompress(packed)
                merged: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in (spans if spans is not None else []) if s["lo"] < s["hi"]):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
            found = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield pd.concat([batch[["doc_id", "shares_passage"]].reset_index(drop=True), found], axis=1)
            give_back()

    return run


def _meet(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """rows joined with counted (key, c: rows of that key, ...). Keys of over a thousandth of all rows, of which there are
    under a thousand, are broadcast, so that no task gets the rows of such a key."""
    total = counted.agg(F.sum("c")).first()[0] or 0
    hot = counted.where(F.col("c") > total / 1000)
    cold = counted.where(F.col("c") <= total / 1000)
    return rows.join(F.broadcast(hot), key).union(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def remove_repeats(docs: DataFrame, length: int = 400, span: int | None = None, keep_bytes: bool = False, crowd: int = 20_000, bucket_rows: int = 20_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage (and kept, the bytes left).

    A byte goes if a string of `length` bytes covers it that also starts elsewhere, in another text or the same one.
    shares_passage says that another document has a passage of the text, `span` bytes (7/10 of `length`, about fifty
    words of prose for 400) or a few more: passages from `span` to `length` are reported, not removed.
    1. Suffixes are sampled at places that the bytes around them choose, at least one in any `span` bytes, and equal
       strings have equal places; those whose gram occurs once are done with, for no repeat holds them.
    2. Places with the same bytes all around (by a digest of 128 bits) are one context with a count.
    3. Contexts are range-partitioned by the bytes that lead their suffix, with splitters that Spark samples. Each bucket
       sorts its suffixes by multikey quicksort and compares neighbours. Ranges are cut between leads, never inside
       one, so nothing is left to compare across the boundary of two buckets: they differ in the lead.
    4. A lead with more than `crowd` contexts is split by further bytes: once for each run of string starts, by all bytes
       that the strings of the run have in common. What then has few contexts is sorted in the same way, the rest is
       split by shorter runs, at last by whole strings. A lead that nobody shares is done with.
    5. The bytes covered come back by context to all places that have it.
    Texts are rows' UTF-8 bytes; null counts as empty, and a text shorter than `length` stays whole. Equal rows repeat
    each other; they do not make a passage shared. Other columns are not read; an empty table gives no rows.
    """
    span = span or length * 7 // 10
    anchors = Anchors(span)
    reach = anchors.reach
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", content_key())

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rid = batch["rid"].to_numpy()
            for index, raw, starts, ends in _joined(batch["text"].tolist()):
                if (ends - starts).max(initial=0) < span:
                    continue
                at, gram = anchors.of(raw, starts, ends)
                owner = np.searchsorted(ends, at, side="right")
                low, high = np.maximum(at - reach, starts[owner]), np.minimum(at + length, ends[owner])
                data = raw.tobytes()
                context = [hashlib.blake2b(data[i:j], digest_size=16, salt=k.to_bytes(8, "little")).digest() for i, j, k in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)]
                yield pd.DataFrame({"rid": rid[index][owner], "pos": (at - starts[owner]).astype(np.int32), "gram": gram.view(np.int64), "context": context})
            give_back()

    sampled = materialise(rows.select("rid", "text").mapInPandas(places, "rid binary, pos int, gram long, context binary"), "places")
    grams = materialise(sampled.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"), "grams")
    again = materialise(_meet(sampled, grams, "gram").drop("c"), "again")
    discard(sampled)
    contexts = again.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("one"), F.max("rid").alias("other"))
    contexts = materialise(contexts.select("gram", "context", "n", "one", (F.col("one.rid") != F.col("other")).alias("docs")), "contexts")
    crowds = materialise(contexts.groupBy("gram").agg(F.count("*").alias("c")), "crowds")
    one = _meet(contexts, crowds, "gram").select(F.col("one.rid").alias("rid"), F.struct(F.col("one.pos").alias("pos"), "context", "n", "docs", "gram", (F.col("c") > crowd).alias("crowded")).alias("place"))
    wanted = one.groupBy("rid").agg(F.collect_list("place").alias("places"))
    shape = "context binary, n long, doc binary, docs boolean, gram long, crowded boolean, left binary, right binary"
    packed = rows.select("rid", "text").mapInPandas(_packed, "rid binary, packed binary")
    around = materialise(packed.join(wanted, "rid").dropDuplicates(["rid"]).mapInPandas(_contexts(length, reach), shape), "around")

    result = "context binary, lo int, hi int, passage boolean"

    def sorted_by(df: DataFrame, *lead) -> DataFrame:
        buckets = max(1, -(-df.count() // bucket_rows), parallel)
        return df.repartitionByRange(buckets, *lead).select("context", "doc", "docs", "near", "far", "left", "right").mapInPandas(_sorted_buckets(length, span), result)

    calm = around.where("not crowded").withColumn("near", F.lit(0)).withColumn("far", F.lit(reach))
    found = sorted_by(calm, F.substring("right", 1, anchors.gram))
    # a context that occurs more than once repeats every string in it
    least, most = F.greatest(F.lit(0), F.lit(length) - F.octet_length("right")), F.least(F.octet_length("left"), F.lit(reach))
    whole = F.when(least <= most, F.struct((-most).alias("lo"), (F.lit(length) - least).alias("hi"))).otherwise(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    shared = F.col("docs") & (F.octet_length("left") + F.octet_length("right") >= span)
    found = found.union(around.where("n > 1").select("context", whole.alias("w"), shared.alias("passage")).select("context", "w.lo", "w.hi", "passage"))

    crowded = around.where("crowded").drop("crowded", "gram", "n")
    keyed = "context binary, near int, far int, key binary"
    part = crowded
    for step in STEPS:
        lead = materialise(part.select("context", "left", "right", *(["near", "far"] if step < STEPS[0] else [])).mapInPandas(_leads(length, reach, step), keyed), "leads")
        often = materialise(lead.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "often")
        met = materialise(_meet(lead, often, "key"), "met")
        if step == 1:
            found = found.union(met.select("context", -F.col("near"), F.lit(length) - F.col("near"), F.lit(False)))
        else:
            few = crowded.join(met.where(F.col("c") <= crowd).drop("c"), "context")
            found = found.union(sorted_by(few, "key"))
            part = crowded.join(met.where(F.col("c") > crowd).select("context", "near", "far"), "context")
    # passages of crowded leads
    starts = crowded.withColumn("near", F.explode(F.sequence(F.lit(0), F.lit(reach), F.lit(_STRIDE * 4)))).withColumn("far", F.col("near"))
    lead = materialise(starts.select("context", "doc", "docs", "left", "right", "near", "far").mapInPandas(_leads(span, reach, 1), f"{keyed}, doc binary, docs boolean"), "passages")
    often = materialise(lead.groupBy("key").agg(F.count("*").alias("c"), F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("docs").alias("docs")).where("a <> b or docs").select("key", "c"), "often")
    found = found.union(_meet(lead.select("context", "key"), often, "key").select("context", F.lit(0), F.lit(0), F.lit(True)).distinct())
    found = materialise(found, "covered")

    # one row a context, so one a place
    found = found.groupBy("context").agg(F.collect_set(F.struct("lo", "hi")).alias("about"), F.max("passage").alias("passage"))
    spans = again.join(found, "context").select("rid", F.transform("about", lambda s: F.struct((F.col("pos") + s["lo"]).alias("lo"), (F.col("pos") + s["hi"]).alias("hi"))).alias("spans"), "passage")
    spans = spans.groupBy("rid").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.max("passage").alias("shares_passage"))
    texts = rows.mapInPandas(_packed, "doc_id long, rid binary, packed binary")
    cut = texts.join(spans, "rid", "left").select("doc_id", "packed", "spans", F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))
    cut = cut.mapInPandas(_cut(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean, kept binary")
    return cut if keep_bytes else cut.drop("kept")
