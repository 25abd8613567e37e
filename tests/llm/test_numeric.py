"""Learned models against enumeration, numeric slopes and held-out rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"   # enough held-out rows of either label


# ---------------------------------------------------------------- pages: sum-product over trees
PAGES = ["<body><nav class=menu><a href=/>Home</a></nav><article><h1>Head line</h1><p>Some text to read here.</p></article>"
         "<footer>(c)</footer></body>",
         "<div><div><p>One</p><p>Two words</p></div><ul><li>a</li><li><a href=x>b</a></li></ul></div>", "<p>Only</p>", ""]


def tree_score(hc, nodes, labels, weights) -> float:
    edge = weights[len(hc.FEATURES):].reshape(len(hc.KINDS), 2, 2)
    total = 0.0
    for node, described, own in zip(nodes, hc.describe(nodes), labels, strict=True):
        total += own * sum(weights[j] * v for j, v in described)
        if node.parent:
            total += edge[hc.KINDS.index(node.kind), labels[node.parent.order], own]
    return total


@pytest.mark.parametrize("page", PAGES)
@pytest.mark.parametrize("seed", range(3))
def test_marginals_and_slope_by_enumeration(page, seed):
    from annospark.llm import html_content as hc
    weights = np.random.default_rng(seed).normal(size=hc.SIZE)
    nodes = hc.parse(page)
    marked = hc.mark(nodes)
    every = list(itertools.product((0, 1), repeat=len(nodes)))
    scores = np.array([tree_score(hc, nodes, x, weights) for x in every])
    chance = np.exp(scores - np.logaddexp.reduce(scores))
    expected = [float(sum(c for c, x in zip(chance, every, strict=True) if x[i])) for i in range(len(nodes))]
    assert hc.marginals(nodes, weights) == pytest.approx(expected, abs=1e-9)

    def likelihood(w):
        all_scores = np.array([tree_score(hc, nodes, x, w) for x in every])
        return (tree_score(hc, nodes, marked, w) - np.logaddexp.reduce(all_scores)) / len(nodes)
    slope = hc.gradient(nodes, marked, weights)
    for j in np.random.default_rng(seed).choice(hc.SIZE, 25, replace=False).tolist() + [0, len(hc.FEATURES) + 1]:
        step = np.zeros(hc.SIZE)
        step[j] = 1e-5
        assert slope[j] == pytest.approx((likelihood(weights + step) - likelihood(weights - step)) / 2e-5, abs=1e-6)


# ---------------------------------------------------------------- toxicity: Viterbi over lattices
def reading_cost(tox, readings, model) -> float:
    total, a, b = 0.0, 0, 0
    for reading, price in readings:
        total += price
        if reading == " ":
            total += model[a, b, 0]
            a = b = 0
            continue
        for c in reading:
            code = tox._CODE.get(c, tox._OTHER)
            total += model[a, b, code]
            a, b = b, code
    return total + model[a, b, 0]


def test_viterbi_by_enumeration():
    from annospark.llm import toxicity as tox
    pick = random.Random(6)
    model = tox.character_model(tox._trigrams(["the idiot and the moron were stupid losers in trash while others sat"] * 20))
    tried = 0
    for _ in range(300):
        word = "".join(pick.choice("idiotsmrn1034$@!.- _") for _ in range(pick.randint(1, 8)))
        cells = tox.lattice(word)
        if np.prod([len(c) for c in cells]) > 4000:
            continue
        tried += 1
        options = list(itertools.product(*cells))
        least = min(reading_cost(tox, x, model) for x in options)
        best = {"".join(r for r, _ in x) for x in options if reading_cost(tox, x, model) <= least + 1e-9}
        assert tox.restore(word, model) in best
    assert tried > 200


# ---------------------------------------------------------------- personal data: trees as columns
def test_trees_as_columns_are_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from annospark.llm import pii
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (400, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] + x[:, 3] > 11) ^ (x[:, 5] > 8)).astype(float)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], [*pii.FEATURES, "label"])
    vectors = VectorAssembler(inputCols=pii.FEATURES, outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(vectors)
    judge = pii.Judge([pii._tree(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), {})
    out = model.transform(vectors).select(vector_to_array("probability")[1].alias("p"),
                                          judge.score({c: F.col(c) for c in pii.FEATURES}).alias("s")).collect()
    assert [r["s"] for r in out] == pytest.approx([r["p"] for r in out], abs=1e-12) and len({round(r["p"], 6) for r in out}) > 5


# ---------------------------------------------------------------- quality: the non-negative risk
def pu_rows(spark, rng, n, positives, overlap):
    from annospark.llm import pu_quality as pu
    k = len(pu.MEASURES)
    x = rng.normal(size=(n, k))
    x[:positives, 1] += 3.0 if overlap else 9.0
    flags = np.arange(n) < positives // 2
    return x, flags, spark.createDataFrame([(v.tolist(), bool(f)) for v, f in zip(x, flags, strict=True)], "x array<double>, positive boolean")


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_newton_minimises_the_non_negative_risk(spark, prior):
    from annospark.llm import pu_quality as pu
    x, flags, rows = pu_rows(spark, np.random.default_rng(2), 400, 160, True)
    k = x.shape[1]
    w = pu._newton(rows, prior, np.zeros(k), np.ones(k))
    x = x.copy()
    x[:, 0] = 1.0

    def risk(v):
        z = x @ v
        negative = pu._softplus(z).mean() - prior * pu._softplus(z[flags]).mean()
        return prior * pu._softplus(-z[flags]).mean() + max(0.0, negative) + 0.5 * pu.PENALTY * (v[1:] ** 2).sum()
    # no better weights nearby, and better than none
    rng = np.random.default_rng(0)
    assert risk(w) < risk(np.zeros(k))
    assert all(risk(w + d) > risk(w) - 2e-3 for d in rng.normal(scale=0.05, size=(300, k)))


def test_class_prior_of_separable_rows(spark):
    from annospark.llm import pu_quality as pu
    x, _flags, rows = pu_rows(spark, np.random.default_rng(5), 2000, 600, False)
    k = x.shape[1]
    w = pu._newton(rows, None, np.zeros(k), np.ones(k))
    assert 0.2 < pu.class_prior(rows, w, np.zeros(k), np.ones(k)) < 0.4   # 600 of 2,000


# ---------------------------------------------------------------- held-out rows
@pytest.mark.parametrize("which, label", [("toxicity", "toxic"), ("pu_quality", "quality")])
def test_held_out_accuracy(spark, which, label):
    from annospark.llm import pu_quality, toxicity
    score = {"toxicity": toxicity.score_toxicity, "pu_quality": pu_quality.score_quality}[which]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = score(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    good = [r["score"] for r in rows if r["y"] == 1]
    bad = [r["score"] for r in rows if r["y"] == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(good) > 50 and len(bad) > 50 and auc > 0.95
