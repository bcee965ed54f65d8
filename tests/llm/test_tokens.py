"""Token counts and packing against the tokenizers themselves."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from findlake.llm.packing import pack_documents, plan_bins
from findlake.llm.token_counts import count_tokens
from tests.llm.fixtures import documents, hard_rows

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def _odd_texts():
    rng = random.Random(2)
    alphabet = "abcXYZ 019.,'sdT\n\t \u0085éÀßŁ<|>İΣς漢😀 ́"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["it's we're I'LL <|endoftext|>x<|ENDOFTEXT|>", "a" * 400 + " " + "b " * 400]


def test_counts_are_the_librarys(spark):
    rows = hard_rows() + list(enumerate(_odd_texts(), 100))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(documents(spark, rows).repartition(3), WORD, limit=100).collect())
    t = Tokenizer.from_file(WORD)
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]
    assert got == sorted((i or -1, len((x or "").encode()), k, k > 100) for (i, x), k in zip(rows, n, strict=True))
    assert count_tokens(documents(spark, []), WORD).count() == 0


def test_a_count_of_more_than_a_byte_holds(spark):
    got = count_tokens(documents(spark, [(1, "word " * 1000), (2, "word")]), WORD).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 1000), (2, 1)]


def test_packing_is_a_round_trip(spark):
    rows = hard_rows() + list(enumerate(_odd_texts(), 100))
    got = pack_documents(documents(spark, rows).repartition(3), BYTE, RANKS, end_id=2, capacity=64, keep_ids=True, items_per_task=50).collect()
    t = Tokenizer.from_file(BYTE)
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length <= 64 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by[r.doc_id].append((r.piece, r.start, ids))
        bins[r.sequence_id].append((r.offset, r.length))
    for (i, text) in rows:
        if i in (None, 7):
            continue
        parts = sorted(by[i], key=lambda p: p[0])
        assert np.concatenate([p[2] for p in parts]).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert [p[1] for p in parts] == [0, *np.cumsum([len(p[2]) for p in parts])[:-1].tolist()]
        assert all(len(p[2]) == 64 for p in parts[1:])
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.02 * -(-total // 64) + 1
    assert pack_documents(documents(spark, []), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=25))
def test_plan_places_every_item_once(counts):
    used, seen = defaultdict(list), defaultdict(int)
    for length, first, end, start, offset in plan_bins(counts, 60):
        assert seen[length] == first
        seen[length] = end
        for k in range(end - first):
            used[start + k].append((offset, length))
    assert dict(seen) == counts
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 60
    assert sum(3 * n > 60 for parts in used.values() for _, n in parts) <= 2 * len(used)
