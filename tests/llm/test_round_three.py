"""Mixing, ranked search and spelling variants against plain Python, with the rows that are hard for them."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findlake.llm import queries as llm
from findlake.llm.mixing import mix, mix_parts, mixed_texts
from findlake.llm.ranked_search import Heap, Work, _List, build_index, impact, pack_numbers, rank_documents, search_shard, unpack_numbers
from findlake.llm.spelling import near_pairs, near_words, spelling_variants
from findlake.llm.totals import running_totals
from tests import oracle
from tests.llm.fixtures import hard_rows, prose

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, source string, rank int, key string, size string, term string, shard int, n long, block string, `pass` int"


def table(spark, rows):
    """Documents from (doc_id, text, source), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, 7, "k", "x", "t", 1, 9, "b", 3) for i, t, s in rows], SHAPE)


@pytest.mark.parametrize("name", ["op11_mixing", "op12_ranked_search", "op13_spelling"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    df = llm.QUERIES[name](spark, SF)
    result = oracle.connect(SF).execute(llm.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert oracle.rows(df.columns, df.collect()) == oracle.rows(names, result.fetchall())


def test_running_totals_are_those_of_a_sorted_list(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), k, rng.choice([None, 0, 3, 9])) for k in range(500)]
    got = running_totals(spark.createDataFrame(rows, "a int, b int, v long").repartition(5), ["a", "b"], {"before": "v"}).collect()
    total, want = 0, {}
    for a, b, v in sorted(rows, key=lambda r: r[:2]):
        want[a, b] = total
        total += v or 0
    assert {(r.a, r.b): r.before for r in got} == want
    assert running_totals(spark.createDataFrame([], "a int, v long"), ["a"], {"before": "v"}).count() == 0


def _targets(sizes: dict, weights=(5, 2, 1)):
    """Share out, cap, share out again what is left over, until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / rest > 2 * sizes[s]} if rest else set()
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else left * weight[s] / rest for s in order}
        capped |= over


def test_mixing_meets_targets_with_hard_rows(spark):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["b", "a", None, "ä", ""])) for i, t in hard_rows()]
    rows += [(k, prose(k, rng.randrange(1, 200)), rng.choice("aaaaaaaabcdefgh")) for k in range(20, 220)] + [(500, "one two", "only")] * 3
    df = table(spark, rows)
    got = mix(df.repartition(3)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    wanted = _targets(sizes)
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(sizes.values()))
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target[r.source_size, round(r.target, 6)] += r.taken
    for s, target in wanted.items():
        assert abs(by_target[sizes[s], round(target, 6)] - target * sum(1 for x in wanted if sizes[x] == sizes[s] and round(wanted[x], 6) == round(target, 6))) <= len(wanted)
    again = mix(df.repartition(7, "n_chars" if "n_chars" in df.columns else "size")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(df.limit(0)).count() == 0
    assert [(r.taken, r.target) for r in mix(table(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0.0), (0, 0.0)]


def test_sources_advance_together_and_texts_are_cut_at_the_target(spark):
    rows = [(k, f"w{k} " * 10, "abc"[k % 3]) for k in range(300)]
    parts = mix_parts(table(spark, rows)).where("words > 0").orderBy("at").collect()
    assert [p["at"] for p in parts] == [0, *np.cumsum([p.words for p in parts])[:-1].tolist()]
    half = [p for p in parts if p.finish <= 0.5]
    for rank in range(3):
        target = next(p.target for p in parts if p.source_rank == rank)
        assert abs(sum(p.words for p in half if p.source_rank == rank) - target / 2) <= 10
    texts = mixed_texts(table(spark, rows)).collect()
    assert [len(t.text.split()) for t in texts] == [t.words for t in texts] and sum(t.words for t in texts) == sum(p.words for p in parts)
    assert all(t.text.split()[0] == f"w{t.doc_id}" for t in texts)


def test_numbers_come_back_from_their_bytes():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**45, 5])
    packed, widths = pack_numbers(values)
    assert unpack_numbers(packed).tolist() == values.tolist() and widths.sum() == len(packed)
    assert unpack_numbers(pack_numbers(np.zeros(0, np.int64))[0]).tolist() == []


def _ranking(docs, items, k):
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, Counter(low(t))) for i, t in docs]
    n, total = sum(1 for _, c in terms if c), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        q = Counter(low(text))
        scores = []
        for i, c in terms:
            size = sum(c.values())
            s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * size * n // total))) for t, a in q.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def test_ranking_is_the_exhaustive_one_with_hard_rows(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.7 else words[0] for _ in range(n))
    docs = hard_rows() + [(k, text(rng.randint(0, 90))) for k in range(100, 900)] + [(900 + k, "same words here") for k in range(40)]
    items = [(1, text(12)), (1, text(5)), (2, None), (3, ""), (4, "nothing-of-this"), (None, "Same WORDS here one"), (5, text(6)), (5, "a " * 30), (6, "ONE two"), (6, "ONE two")]
    df = table(spark, [(i, t, "s") for i, t in docs]).repartition(6)
    asked = spark.createDataFrame([(*i, 1, "r") for i in items], "item_id long, text string, rank int, rid string")
    for pairs in (1 << 20, 9):
        got = rank_documents(df, asked, k=20, pairs=pairs).collect()
        assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == _ranking(docs, items, 20)
    assert rank_documents(df.limit(0), asked).count() == 0 and rank_documents(df, asked.limit(0)).count() == 0


def test_rare_terms_keep_lists_of_common_ones_unread():
    rng = np.random.default_rng(3)
    n_docs = 20_000
    lengths = rng.integers(20, 400, n_docs)
    total = int(lengths.sum())

    def of(docs):
        docs = np.sort(docs)
        cuts = range(0, len(docs), 128)
        tf = rng.integers(1, 4, len(docs))
        packed = [pack_numbers(np.stack([np.diff(docs[c : c + 128], prepend=docs[c]), tf[c : c + 128]], 1).reshape(-1))[0].tobytes() for c in cuts]
        most = np.array([impact(tf[c : c + 128], lengths[docs[c : c + 128]], n_docs, total).max() for c in cuts])
        return docs, tf, _List(np.array([docs[c] for c in cuts]), np.array([docs[c : c + 128][-1] for c in cuts]), np.array([len(docs[c : c + 128]) for c in cuts]), most, packed)

    made = [of(np.arange(0, n_docs, 2)), of(np.arange(0, n_docs, 3)), of(rng.choice(n_docs, 60, replace=False))]
    item = [(0, 30), (1, 45), (2, 9000)]
    heap, work = Heap.empty(20), Work()
    score = np.zeros(n_docs, np.int64)
    for (docs, tf, _), (_, w) in zip(made, item, strict=True):
        score[docs] += w * impact(tf, lengths[docs], n_docs, total)
    for _ in range(2):  # the second time against the thresholds of the first
        before = work.decoded
        search_shard({k: m[2] for k, m in enumerate(made)}, [item], [heap], lengths, np.arange(n_docs), np.zeros(n_docs, bool), n_docs, total, work)
        if not before:
            assert heap.ids.tolist() == sorted(range(n_docs), key=lambda d: (-score[d], d))[:20]
            for m in made:
                m[2].whole = None
    assert work.decoded - before < work.postings / 2 / 2


def test_the_index_holds_every_document_once(spark):
    index = build_index(table(spark, [(i, t, "s") for i, t in hard_rows()]).repartition(4))
    heads = index.where("term is null").select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("d")).select("d.*").collect()
    want = [(i, len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or ""))) for i, t in hard_rows()]
    assert Counter((h.doc_ids, h.lengths) for h in heads) == Counter(want)
    assert index.where("term = 'one'").agg(F.sum("n")).first()[0] == 2


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.booleans(), st.data())
def test_pairs_of_blocks_are_those_one_edit_apart(length, longer, data):
    words = lambda n: data.draw(st.lists(st.text("abé", min_size=n, max_size=n), min_size=1, max_size=30, unique=True))
    a, b = words(length), words(length + longer)
    i, j = near_pairs(a, b)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if _one_edit(a[x], b[y])]


def _variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if _one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_are_those_of_all_pairs_with_hard_rows(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["ABCdef", "ÀÉÎõüÿ", "a" * 3000]

    def changed(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcß") + w[k:], w[:k] + rng.choice("abcß") + w[k + 1 :]])

    text = []
    for s in stems:
        v, u = changed(s), changed(changed(s))
        text += [s] * 260 + [v] * rng.randint(5, 50) + [changed(v)] * 6 + [u] * 5 + [changed(s) for _ in range(20)]
    rng.shuffle(text)
    rows = hard_rows() + [(k, " ".join(text[k::40])) for k in range(40)] + [(None, "abcdef-abcdef 1abcdef")]
    df = table(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    for tile in (4096, 7):
        got = spelling_variants(df, tile=tile).collect()
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == _variants(rows) and len(got) == len({r.word for r in got})
    assert any(r.form and r.root != r.form for r in got)
    assert spelling_variants(df.limit(0)).count() == 0
    assert near_words(spark.createDataFrame([], "word string, n long")).count() == 0
