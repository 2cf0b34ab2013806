"""The pipeline's stages against plain versions, and the classifier on held-out labels."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gondola.llm import quality_classifier
from tests.llm.test_against_brute_force import brute_contamination, groups, shingles

SF = "/root/testdata/sf0.001"


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    model = quality_classifier.fit(docs, labels.where(half == 0))
    rows = quality_classifier.score(docs, model).join(labels.where(half == 1), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    toxic = [r["kept"] for r in rows if r["toxic"] == 1]
    poor = [r["kept"] for r in rows if r["quality"] == 0 and r["toxic"] == 0]
    assert np.mean(good) > 0.95 and np.mean(toxic) < 0.35 and np.mean(poor) < 0.2
    assert model.thresholds[0] < model.thresholds[1]


def test_classifier_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "some words", 0.5), (3, "some words", 0.5), (None, "x", 0.5)], "doc_id bigint, text string, p_good double")
    none = spark.createDataFrame([(3, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality_classifier.score(docs, quality_classifier.fit(docs, none)).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in rows) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert quality_classifier.score(docs.limit(0), quality_classifier.fit(docs, none)).collect() == []


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_near_dedup_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    group = groups({d: shingles(t, 5) for d, t in before.items()})
    assert set(after) == {d for d, g in group.items() if d == g}
    assert all(before[d] == t for d, t in after.items())


def test_decontamination_stage(spark, stages):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[1]), texts(stages[2])
    for d, t in before.items():
        n, hit, _ = brute_contamination(t, items)
        assert (d in after) == (not (hit > 0 and 20 * hit >= n))


def test_personal_data_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t) for t in after.values())
    for d, t in after.items():
        assert re.sub(r"<[A-Z]+>", "", t) == t or before[d] != t


def test_mixing_stage(stages):
    rows = stages[4].collect()
    before = texts(stages[3])
    assert all(r["copies"] in (1, 2, 3) and before[r["doc_id"]] == r["text"] for r in rows)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in before.values())
    assert 0.8 * total < sum(r["taken"] for r in rows) < 1.2 * total


def test_training_finds_the_maximum_of_the_plain_likelihood():
    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(400)]
    true = rng.normal(0, 1.5, 12)
    z = np.array([sum(true[i] for i in s) for s in sets]) + rng.logistic(0, 1, len(sets))
    y = (z > -1).astype(int) + (z > 1)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ridge = 1e-3
    model = quality_classifier.train(np.concatenate(sets).astype(np.int32), at, y, ridge=ridge, rounds=400)

    def loss(w, theta):
        total = ridge / 2 * sum(x * x for x in w)
        up = lambda x: 1 / (1 + np.exp(-x))
        for s, k in zip(sets, y, strict=True):
            score = sum(w[i] for i in s)
            p = [1.0, up(score - theta[0]), up(score - theta[1]), 0.0]
            total -= np.log(p[k] - p[k + 1]) / len(sets)
        return total

    w, theta = [float(x) for x in model.weights[:12]], [float(x) for x in model.thresholds]
    assert not model.weights[12:].any() and theta[0] < theta[1]
    best = loss(w, theta)
    for i in range(14):
        for step in (-0.03, 0.03):
            moved = [*w, *theta]
            moved[i] += step
            assert loss(moved[:12], moved[12:]) > best
    # the expected grade is the sum of the tail probabilities
    p = model.probabilities(np.array([0.0, 3.0]))
    assert np.all(p[0] > p[1]) and np.all(p[:, 1] > p[:, 0])
