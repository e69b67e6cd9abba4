import random

import numpy as np
import pytest
from tests.llm.util import ODD, documents, prose

from tessera.llm import quality, toxicity


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    good = np.array(labels) == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def labels(spark, values, column):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"doc_id long, {column} int")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    texts, bad, toxic = [], [], []
    for i in range(600):
        text = prose(i, 60, 5_000)
        bad.append(i % 5 == 0)
        toxic.append(i % 6 == 1)
        if bad[-1]:
            text = " ".join(w + "!!" for w in text.upper().split()) if i % 2 else " ".join([text.split()[0]] * 60)
        if toxic[-1]:
            parts = text.split()
            for _ in range(3):
                parts.insert(r.randrange(len(parts)), r.choice(["vilest", "vilely", "rotten", "foulmouth"]) + r.choice(["", ".", ","]))
            text = " ".join(parts)
        texts.append(text)
    return texts, bad, toxic


def test_quality(spark, corpus):
    texts, bad, _ = corpus
    rows = quality.quality_scores(documents(spark, texts, extra=True), labels(spark, [1 - b for b in bad], "quality")).orderBy("doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and 60 < len(held) < 180
    assert auc([r.score for r in held], [1 - bad[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity(spark, corpus):
    texts, _, toxic = corpus
    rows = toxicity.toxicity_scores(documents(spark, texts, extra=True), labels(spark, list(map(int, toxic)), "toxic")).orderBy("doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert auc([r.score for r in held], [int(toxic[r.doc_id]) for r in held]) > 0.97
    assert np.mean([r.predicted for r in held if toxic[r.doc_id]]) > 0.9 and np.mean([r.predicted for r in held if not toxic[r.doc_id]]) < 0.03


def test_labels_of_the_held_out_fold_do_not_matter(spark, corpus):
    texts, bad, _ = corpus
    docs = documents(spark, texts[:200])
    known = labels(spark, [1 - b for b in bad[:200]], "quality")
    turned = known.selectExpr("doc_id", "case when crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0 then 1 - quality else quality end as quality")
    one, two = ({r.doc_id: r.score for r in quality.quality_scores(docs, k).collect()} for k in (known, turned))
    assert one == two


@pytest.mark.parametrize("values", [[], [None, 1], [1, 1, 1], [0, 1] * 6])
def test_odd_tables(spark, values):
    docs = documents(spark, ODD, extra=True)
    for scores, column in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        rows = scores(docs, labels(spark, values, column)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert rows[ODD.index("")].score == rows[ODD.index(None)].score
        assert scores(documents(spark, []), labels(spark, values, column)).count() == 0


def test_filters_keep_columns(spark, corpus):
    texts, bad, toxic = corpus
    docs = documents(spark, texts, extra=True)
    kept = quality.keep_good(docs, labels(spark, [1 - b for b in bad], "quality"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, b in enumerate(bad) if not b}
    kept = toxicity.drop_toxic(docs, labels(spark, list(map(int, toxic)), "toxic"))
    assert kept.columns == docs.columns and abs(kept.count() - 500) < 15


def test_trees_equal_a_plain_walk():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.boost(x, y, trees=30)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.95
    for row, margin in zip(x[:50], model.margins(x[:50]), strict=True):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9


def test_non_negative_risk():
    r = np.random.default_rng(4)
    positive = np.arange(400) < 100
    toxic = positive | (np.arange(400) % 5 == 0)  # hidden ones among the unlabelled
    rows, words = [], []
    for i in range(400):
        for w in {*r.integers(1, 6, 2), *([0] if toxic[i] else [])}:
            rows.append(i), words.append(w)
    weights, bias = toxicity.fit(np.array(rows), np.array(words), positive, 6, 0.2)
    assert weights[0] + bias > 0 and weights[1:].max() + bias < 0
