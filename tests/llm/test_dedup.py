"""Near-duplicates and repeats against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from findlake.llm.components import connected_components
from findlake.llm.embedding_dedup import near_duplicate_vectors, quantise
from findlake.llm.minhash import Features, document_frequencies, idf_table, near_duplicates, weighted_jaccard
from findlake.llm.suffix_dedup import multikey_quicksort, remove_repeats
from tests.llm.fixtures import documents, hard_rows, prose


def _components(edges, nodes):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300), (None, 4), (1, 2), (2, 1)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _components([e for e in edges if None not in e and e[0] != e[1]], {x for e in edges if None not in e and e[0] != e[1] for x in e})
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    x = [(base[rng.integers(20)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.3])).astype(np.float32).tolist() for _ in range(240)]
    label = [int(v) if v < 3 else None for v in rng.integers(0, 4, 240)]
    x[5], x[6], x[7], x[8], x[9] = None, [0.0] * 16, [*x[7][:-1], float("nan")], [*x[8][:-1], None], [*x[9][:-1], float("inf")]
    x[10] = x[11] = x[12]
    x[13] = [v * 2 for v in x[12]]
    for k in range(10, 14):
        label[k] = 0
    ids = rng.permutation(240).tolist()
    rows = [(i, v, lab, "extra", 1) for i, v, lab in zip(ids, x, label, strict=True)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string, n int"), tile=40).collect()
    ok = [v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    edges, n = [], defaultdict(int)
    for a in range(240):
        for b in range(a):
            if label[a] is not None and label[a] == label[b] and ok[a] and ok[b]:
                u, w = np.array(x[a], np.float32).astype(float), np.array(x[b], np.float32).astype(float)
                if u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.98:
                    edges.append((ids[a], ids[b]))
                    n[ids[a]] += 1
                    n[ids[b]] += 1
    comp = _components(edges, ids)
    assert len(edges) > 100
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], comp[i], comp[i] == i) for i in ids}


def test_vectors_without_rows_or_ids(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert near_duplicate_vectors(spark.createDataFrame([], shape)).count() == 0
    rows = near_duplicate_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0], 1), (4, [1.0], 1)], shape)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in rows) == [(0, 1, None, True), (3, 1, 3, True), (4, 1, 4, True), (4, 1, 4, True)]


def test_quantisation_bounds_hold():
    v = np.random.default_rng(0).normal(size=(50, 33))
    v /= np.linalg.norm(v, axis=1)[:, None]
    codes, scale, error, length = quantise(v)
    close = codes * scale[:, None]
    about, exact = close @ close.T, v @ v.T
    assert (np.abs(about - exact) <= length[:, None] * error[None, :] + error[:, None] + 1e-12).all()


def _near_rows():
    rows = []
    for g in range(12):
        words = prose(100 + g, 160).split()
        for k in range(6):
            rng = random.Random(g * 10 + k)
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = f"edit{g}x{k}y{rng.randrange(999)}"
            rows.append((len(rows) + 1000, " ".join(copy)))
    return rows + [(2000 + i, prose(500 + i, 120)) for i in range(20)]


def test_near_duplicates_against_all_pairs(spark):
    rows = _near_rows()
    docs = documents(spark, rows)
    got = {r.doc_id: r.group_id for r in near_duplicates(docs).collect()}
    idf = idf_table(document_frequencies(docs, 5))
    f = Features([t for _, t in rows], 5)
    w = (f.tf * idf[f.cell()]).astype(float)
    sets = []
    for k in range(len(rows)):
        lo, hi = f.bounds[k], f.bounds[k + 1]
        order = np.argsort(f.key[lo:hi])
        sets.append((f.key[lo:hi][order], w[lo:hi][order]))
    edges = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if weighted_jaccard(sets[a], sets[b]) >= 0.8]
    assert len(edges) > 30
    assert got == _components(edges, [i for i, _ in rows])


def test_near_duplicates_of_hard_rows(spark):
    got = near_duplicates(documents(spark, hard_rows())).collect()
    assert len(got) == len(hard_rows())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.group_id, r.kept, r.n_copies))
    assert by[5] == [(5, True, 2)] and by[6] == [(5, False, 2)] and by[7] == [(7, True, 2)] * 2
    assert all(by[i] == [(i, True, 1)] for i in (1, 2, 3, 4, 8, 9))
    assert near_duplicates(documents(spark, [])).count() == 0


def _brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = defaultdict(int)
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] += 1
    out = []
    for r in raws:
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~hit].tobytes()
        out.append((len(r), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [200, 3])
def test_repeats_against_brute_force(spark, crowd):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [para(rng.randint(5, 30)) for _ in range(20)]
    texts = [para(rng.randint(0, 20)) + " " + " ".join(rng.choice(shared) for _ in range(rng.randint(0, 4))) + para(rng.randint(0, 12)) for _ in range(150)]
    texts += [None, "", "ab" * 300, "a" * 500, "x" * 39, texts[5], texts[6], "é" * 100, "\0" * 90]
    docs = documents(spark, list(enumerate(texts))).repartition(3)
    rows = remove_repeats(docs, 40, crowd=crowd, bucket_rows=300).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(_brute(texts, 40)))
    # a passage of span bytes of another document; found for sure from span + 9 bytes on, in crowded leads from span + 39
    of = lambda size: {t: {t[i : i + size] for i in range(len(t) - size + 1)} for t in ((x or "").encode() for x in texts)}
    grams, longer = of(28), of(37 if crowd == 200 else 67)
    shares = lambda held, i: any(held[(texts[i] or "").encode()] & held[(texts[j] or "").encode()] for j in range(len(texts)) if j != i)
    for r in rows:
        assert not r.shares_passage or shares(grams, r.doc_id)
        assert r.shares_passage or not shares(longer, r.doc_id)


def test_repeats_of_hard_rows(spark):
    rows = hard_rows()
    got = remove_repeats(documents(spark, rows), 400, keep_bytes=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id in (5, 6, 9)}
    assert by[5].n_removed == by[5].n_bytes and by[6].n_spans == 1 and bytes(by[9].kept) == b""
    assert remove_repeats(documents(spark, []), 400).count() == 0


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (200, 6)).astype(np.uint64)
    order, differs = multikey_quicksort(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(map(tuple, words.tolist()))
    for i in range(1, 200):
        same = next((k for k in range(6) if rows[i][k] != rows[i - 1][k]), 6)
        assert differs[i] == same


def test_words_are_runs_and_hash_by_content():
    import re

    from findlake.llm.words import Words, shingles

    texts = ["The cat, the CAT!", "", "...", "Ünïcode 漢字_1 x", "a" * 700 + " " + "a" * 701, "cat"]
    w = Words(texts)
    plain = [re.findall(r"[\w\u0080-\U0010ffff]+", t.lower()) for t in texts]
    assert np.diff(w.doc).tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    assert [w.word(i) for i in range(len(flat))] == flat
    assert len(set(w.hashes.tolist())) == len(set(flat))
    assert all((w.hashes[i] == w.hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    h, bounds = shingles(w.hashes, w.doc, 2)
    assert np.diff(bounds).tolist() == [max(len(p) - 1, min(len(p), 1)) for p in plain] and len(set(h.tolist())) == len(h) - 1  # "the cat" twice


def test_document_frequencies_count_a_cell_once_a_document(spark):
    long = " ".join(np.random.default_rng(5).integers(0, 10**9, 200_000).astype(str))
    docs = documents(spark, [(1, long), (2, long + " end"), (3, "")])
    df = document_frequencies(docs, 5)
    assert df[-1] == 2 and df[:-1].max() == 2
    idf = idf_table(df)
    assert idf.min() >= 1 and idf.max() <= 2
    assert {r.doc_id: r.group_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_one_row_of_a_group_is_kept_whatever_the_ids(spark):
    base = prose(41, 200)
    edited = base.replace(base.split()[100], "edited", 1)
    other = prose(42, 200)
    # copies without id of document 7, also in capitals; a group without ids; a repeated id with two texts, each near to another document
    rows = [(7, base), (None, base), (None, base.upper()), (None, edited), (None, "one two three"), (None, "One, two, three!"), (20, other), (20, prose(43, 200)), (21, other + " end"), (22, prose(43, 200) + " end")]
    got = near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.group_id].append((r.doc_id, r.kept))
    assert sorted(by[7], key=str) == [(7, True), (None, False), (None, False), (None, False)]
    assert sorted(by[20]) == [(20, True), (20, True), (21, False), (22, False)]
    rest = [v for k, v in by.items() if k not in (7, 20)]
    assert len(rest) == 1 and sorted(kept for _, kept in rest[0]) == [False, True]


def test_components_that_are_not_joined_in_time_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    with pytest.raises(RuntimeError, match="not joined after 2 rounds"):
        connected_components(path, max_rounds=2)


def test_places_and_leads_take_little_memory_of_a_task():
    """Places of 8 MB of texts need arrays over a small part of them, and rows with many starts leave in small tables."""
    import tracemalloc

    import pandas as pd

    from findlake.llm import suffix_dedup

    anchors, texts = suffix_dedup.Anchors(280), [prose(i, 350) for i in range(4000)]
    suffix_dedup._powers.clear()
    tracemalloc.start()
    places = sum(len(anchors.of(raw, starts, ends)[0]) for _, raw, starts, ends in suffix_dedup._joined(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert places > 10_000 and most < 60 << 20
    rows = pd.DataFrame({"context": [i.to_bytes(4) for i in range(500)], "left": [b"l" * 200] * 500, "right": [b"r" * 400] * 500})
    sizes = [len(t) for t in suffix_dedup._leads(400, 200, 1)(iter([rows]))]
    assert sum(sizes) == 500 * 201 and max(sizes) < 5000
