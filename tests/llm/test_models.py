"""Classifiers by held-out accuracy, the network by finite differences, and the pipeline's stages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from findlake.llm import toxicity
from findlake.llm.labelled import fold, training_sample
from findlake.llm.quality import score_quality
from findlake.llm.shared import materialise
from findlake.llm.toxicity import Inputs, Model, score_toxicity
from tests.llm.fixtures import documents, hard_rows

SF = "/root/testdata/sf0.1"


def _accuracy(spark, name, label):
    """Of the held-out fold the share that is predicted right, and that of the documents of label 1."""
    got = entry.queries()[name](spark, SF)
    held = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    right = (F.col("predicted") == F.col(label)).cast("int")
    r = held.agg(F.avg(right).alias("a"), F.avg(F.when(F.col(label) == 1, right)).alias("recall"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.n > 800 and 0 <= r.lo and r.hi <= 1
    return r.a, r.recall


def test_toxicity_on_the_held_out_fold(spark):
    # 0.88 of the labels are 0
    right, recall = _accuracy(spark, "op3_toxicity", "toxic")
    assert right >= 0.97 and recall >= 0.85


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_toxicity_does_not_hang_on_a_seed(spark, seed):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Model(*training_sample(docs, labels, "toxic", fold(5) != 0, 1500), seed=seed)
    held = labels.where((fold(5) == 0) & F.col("toxic").isNotNull()).join(docs, "doc_id").select("text", "toxic").collect()
    called, toxic = model.scores([r.text for r in held]) >= 0.5, np.array([r.toxic == 1 for r in held])
    assert (called == toxic).mean() >= 0.97 and called[toxic].mean() >= 0.85


def test_quality_on_the_held_out_fold(spark):
    assert _accuracy(spark, "op9_quality", "quality")[0] >= 0.97


def test_folds_are_crc32(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", fold(5).alias("k")).collect()
    assert all(r.k == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    texts, y, w = training_sample(docs, labels, "toxic", fold(5) != 0, 40)
    assert len(texts) == 80 and sum(y) == 40 and all(v > 1 for v in w)
    held = {f"text {r.doc_id}" for r in docs.where(fold(5) == 0).collect()}
    assert not held & set(texts)
    few, z, _ = training_sample(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.repeat("text", 1000)).otherwise(F.col("text"))), labels, "toxic", fold(5) != 0, 40, most_bytes=200)
    assert {0, 1} == set(z) and all(sum(len(t) for t, v in zip(few, z) if v == c) <= 200 for c in (0, 1)) and not any(len(t) > 200 for t in few)


def test_scores_of_hard_rows(spark):
    docs = documents(spark, hard_rows())
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (score_toxicity(docs, labels, F.lit(True)), score_quality(docs, labels, F.lit(True))):
        rows = scored.collect()
        assert len(rows) == len(hard_rows()) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_toxicity(docs, none, F.lit(True)).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, none, F.lit(True)).collect()} == {0.5}
    assert score_toxicity(documents(spark, []), labels, F.lit(True)).count() == 0


def test_networks_train_in_tasks_and_not_on_the_driver(spark, monkeypatch):
    from tests.llm.fixtures import prose

    texts = [f"{prose(i, 20, 200)} {'idiot clown' if i % 2 else ''}" for i in range(60)]
    docs = documents(spark, list(enumerate(texts))).repartition(5)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    want = Model(*training_sample(docs, labels, "toxic", F.lit(True), 1500)).scores(texts)
    monkeypatch.setattr(Model, "_train", lambda *a: pytest.fail("a network is trained on the driver"))
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels, F.lit(True)).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(want.tolist(), abs=1e-6)


def test_gradients_of_the_network():
    texts = ["alpha beta gamma idiot delta", "one two three four five six seven", "x"] * 3
    model = Model(texts, [1, 0, 0] * 3, [1.0] * 9, steps=2, batch=4, networks=1)
    x = Inputs(texts, model.vocabulary)
    p = {k: np.array(v, np.float64) for k, v in model.networks[0][0].items()}
    label, rows = np.array([1, 0, 0] * 3, np.float64)[x.doc], np.arange(len(x.windows))
    got = toxicity._gradients({k: v.astype(np.float32) for k, v in p.items()}, x, rows, label, np.ones(len(rows), np.float32))

    def loss(q):
        z = toxicity.window_logits({k: v.astype(np.float32) for k, v in q.items()}, x).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * label + np.log1p(np.exp(z)) * (1 - label)))

    rng = np.random.default_rng(0)
    for name in ("wo", "va", "wa", "uf", "ub", "wf", "bb"):
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - got[name][at]) < 2e-3, name


def test_scores_do_not_depend_on_company():
    texts = [f"word{i} other{i} idiot text here" if i % 2 else f"plain words number {i}" for i in range(40)]
    model = Model(texts, [i % 2 for i in range(40)], [1.0] * 40, steps=40)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-5)


def test_pipeline_stages(spark):
    smallest = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, smallest), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, smallest)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    benchmark = [r.text for r in spark.read.parquet(f"{smallest}/benchmark.parquet").collect()]
    assert not [r.doc_id for r in docs.collect() for b in benchmark if b in r.text]


def test_pipeline_of_hard_rows(spark):
    docs = documents(spark, [*hard_rows(), (60, "write to a@b.cc now"), (60, "write to a@b.cc now")])
    smallest = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, smallest), name)
    rows = docs.collect()
    assert sum(r.doc_id == 60 for r in rows) == 1 and sum(r.doc_id == 5 for r in rows) == 1 and not [r for r in rows if r.doc_id == 6]
    assert [r.text for r in rows if r.doc_id == 60] == ["write to [EMAIL] now"]
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, smallest).count() == 0


def test_the_ten_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_the_toxicity_stage_keeps_a_column_called_score(spark, tmp_path):
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, [(i, f"some words {i}") for i in range(20)]).withColumn("score", F.lit("a")).withColumn("Own Score", F.lit(0.9))
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.score, r["Own Score"]) for r in kept.collect()) == [(i, "a", 0.9) for i in range(20)]


def test_the_stages_keep_columns_called_like_their_own(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(20).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = documents(spark, [(i, f"some words {i} mail to a{i}@example.org please") for i in range(12)])
    taken = ["own rid", "Kept rid", "found rid", "pii key", "pii rid", "Pii spans"]
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in taken})
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, str(tmp_path)).collect()
        assert len(kept) == 12 and all(r[c] == f"{c} {r.doc_id}" for r in kept for c in taken)


def test_scores_against_a_plain_loop_over_windows():
    from findlake.llm.words import Words
    from tests.llm.fixtures import prose

    texts = [f"{prose(i, 20 + 37 * i, 200)} {'idiot clown' if i % 2 else ''}" for i in range(12)]
    model = Model(texts, [i % 2 for i in range(12)], [1.0] * 12, steps=20, networks=2)
    for text, score in zip(texts, model.scores(texts), strict=True):
        w = Words([text])
        words, total = [w.word(i) for i in range(len(w.hashes))], 0.0
        for params, final in model.networks:
            logits = []
            for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
                logits.append(float(toxicity.window_logits(params, Inputs([" ".join(words[at : at + toxicity.WINDOW])], model.vocabulary))[0]))
            total += np.array([max(logits), np.mean(logits), 1]) @ final
        assert abs(1 / (1 + np.exp(-total / len(model.networks))) - score) < 1e-4


def test_votes_against_a_plain_count():
    from findlake.llm.quality import SIZE, Voters, features, nearest
    from tests.llm.fixtures import prose

    texts = [prose(i, 60, 80) if i % 3 else "!!! " * (i + 5) for i in range(40)]
    labels, by = [int(i % 3 > 0) for i in range(40)], [1.0 + i % 2 for i in range(40)]
    df = np.zeros(SIZE + 1, np.int64)
    df[:SIZE], df[SIZE] = (features(texts) > 0).sum(axis=0), len(texts)
    voters = Voters(texts, labels, by, df, rank=8, neighbours=5)
    asked = [*texts[:6], "", prose(77, 30, 80), "!!! ???"]
    for text, score in zip(asked, voters.scores(asked), strict=True):
        z = voters.latent(voters.weigh([text]))[0]
        near = sorted(((-float(z @ h), i) for i, h in enumerate(voters.held)))[:5]
        weight = [max(-c, 1e-6) ** 8 * by[i] for c, i in near]
        assert abs(sum(w * labels[i] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight) - score) < 1e-3
    tied = np.array([[0.5, 0.9, 0.5, 0.5, 0.1]])
    assert sorted(nearest(tied, 2)[0].tolist()) == [0, 1]
