"""Quality classifier by positive-unlabelled learning.

Trusted positives P (labelled good) and unlabelled text U (all documents) train
a linear logistic model that minimises the non-negative unbiased risk

    R(w) = prior * mean_P l(z) + max(0, mean_U l(-z) - prior * mean_P l(-z)),

with l the logistic loss and z the margin.  The class prior is estimated
first: of a model that tells P from U, the least ratio U(A) / P(A) over its
upper score ranges A bounds the share of positives in U from above and meets
it where A holds no negatives.  Negative labels are never used.

Documents become short vectors of text measures once; every step of the fit is a
Spark aggregation of a k x k matrix over all of them, so P and U are whole.

Defined results: null and empty texts have the measures of an empty text; rows
that repeat count as often as they occur; without positives every score is the
prior 0.5; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import written
from annospark.llm.toxicity import held_out

MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: L2 penalty, steps of the fit, least share of P in a range that bounds the prior.
PENALTY, STEPS, LEAST_MASS = 1e-3, 12, 0.25
#: Cells of the score histogram that the prior is read off.
CELLS = 200

MEASURES = ["one", "log_words", "word_length", "symbols", "pipes", "upper", "digits", "stops", "shouts", "beyond_ascii",
            "distinct", "adjacent", "top_word", "single_letters", "short_words", "long_words", "line_words", "dup_lines",
            "distinct_pairs", "capitals", "few_words", "very_few_words"]
_PUNCT = np.frombuffer(b".,;:?", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&<>=@^~_{}[]\\/", np.uint8)


def measures(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n = len(words)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = max(int(h.sum() - h[32] - h[9:14].sum() - h[0x80:0xC0].sum()), 1)
    letters = max(int(h[65:91].sum() + h[97:123].sum() + h[0xC3:].sum()), 1)
    m = max(n, 1)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = max(counts.values(), default=0) / m
    return [1.0, np.log1p(n), solid / m / 10, np.sqrt(h[_SYMBOLS].sum() / solid), np.sqrt(h[0x7C] / solid),
            h[65:91].sum() / letters, np.sqrt(h[48:58].sum() / solid), np.sqrt(h[_PUNCT].sum() / solid),
            np.sqrt(h[33] / solid), np.sqrt(h[0x80:].sum() / solid), len(counts) / m ** 0.8, same / m, np.sqrt(top),
            (sizes == 1).sum() / m, (sizes <= 3).sum() / m, (sizes >= 12).sum() / m, np.log1p(m / max(len(lines), 1)),
            (len(lines) - len(set(lines))) / max(len(lines), 1), pairs / m, min(h[65:91].sum() / m, 1.0),
            float(n < 20), float(n < 5)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x: array<float> of the measures of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measures(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


def _sums(rows: DataFrame, task, names: list[str]) -> dict[str, np.ndarray]:
    """Adds up the arrays that ``task(x, positive)`` makes of batches, over all rows.

    Every Spark task sends one row a number, summed by Spark; what reaches the
    driver has the size of the arrays.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)).astype(np.float64)
                positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
                for name, value in task(x, positive).items():
                    total[name] = total.get(name, 0) + value
        for name, value in total.items():
            flat = np.asarray(value, np.float64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat)],
                                             ["name", "i", "v"])
    added = rows.select("x", "positive").mapInArrow(run, "name string, i long, v double").groupBy("name", "i").agg(F.sum("v").alias("v"))
    out: dict[str, list] = {n: [] for n in names}
    for r in added.orderBy("name", "i").collect():
        out[r["name"]].append(r["v"])
    return {n: np.array(v) for n, v in out.items()}


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _newton(rows: DataFrame, prior: float | None, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of standardised measures.  ``prior`` None: P against U, else the non-negative risk.

    Newton steps on the non-negative risk: where its part of the negatives is
    below zero, slope and curvature are those of the positives alone.  Of some
    step lengths the one with the least risk is taken, all judged in one pass.
    """
    k = len(centre)
    w = np.zeros(k)

    def slopes(x: np.ndarray, positive: np.ndarray) -> dict[str, np.ndarray]:
        x = (x - centre) / scale
        x[:, 0] = 1.0
        p = _sigmoid(x @ w)
        heavy = p * (1 - p)
        z, xp, pp = x @ w, x[positive], p[positive]
        return {"u": np.array([len(x)]), "gu": x.T @ p, "hu": (x * heavy[:, None]).T @ x, "n": np.array([positive.sum()]),
                "sp": xp.sum(0), "gp": xp.T @ (pp - 1), "hp": (xp * (pp * (1 - pp))[:, None]).T @ xp,
                "lu": np.array([_softplus(z).sum()]), "ln": np.array([_softplus(z[positive]).sum()])}

    def risks(x: np.ndarray, positive: np.ndarray) -> dict[str, np.ndarray]:
        x = (x - centre) / scale
        x[:, 0] = 1.0
        z = x @ tries.T
        return {"u": np.array([len(x)]), "n": np.array([positive.sum()]), "lu": _softplus(z).sum(0),
                "lp": _softplus(-z[positive]).sum(0), "ln": _softplus(z[positive]).sum(0)}

    penalty = PENALTY * np.r_[0.0, np.ones(k - 1)]
    best = np.inf
    for _ in range(STEPS):
        s = _sums(rows, slopes, ["u", "gu", "hu", "n", "sp", "gp", "hp", "lu", "ln"])
        n_u, n_p = s["u"][0], s["n"][0]
        if prior is None:
            grad, hess = s["gu"] / n_u + s["gp"] / n_p, s["hu"] / n_u + s["hp"] / n_p
        elif s["lu"][0] / n_u >= prior * s["ln"][0] / n_p:
            grad, hess = s["gu"] / n_u - prior * s["sp"] / n_p, s["hu"] / n_u
        else:   # the part of the negatives counts as zero
            grad, hess = prior * s["gp"] / n_p, prior * s["hp"] / n_p
        move = np.linalg.solve(hess.reshape(k, k) + np.diag(penalty + 1e-6), grad + penalty * w)
        lengths = np.array([1.0, 0.5, 0.25, 0.1, 0.02])
        tries = w - lengths[:, None] * move
        r = _sums(rows, risks, ["u", "n", "lu", "lp", "ln"])
        if prior is None:
            risk = r["lu"] / n_u + r["lp"] / n_p
        else:
            risk = prior * r["lp"] / n_p + np.maximum(0.0, r["lu"] / n_u - prior * r["ln"] / n_p)
        risk = risk + 0.5 * (tries * tries) @ penalty
        at = int(risk.argmin())
        if not risk[at] < best - 1e-7:
            break
        best, w = risk[at], tries[at]
    return w


def _margin(x: np.ndarray, w: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = (x - centre) / scale
    x[:, 0] = 1.0
    return x @ w


def class_prior(rows: DataFrame, w: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> float:
    """Estimated share of positives in U, from the P-against-U margins."""
    def task(x: np.ndarray, positive: np.ndarray) -> dict[str, np.ndarray]:
        cell = np.minimum((_sigmoid(_margin(x, w, centre, scale)) * CELLS).astype(int), CELLS - 1)
        return {"u": np.bincount(cell, minlength=CELLS), "p": np.bincount(cell[positive], minlength=CELLS)}
    s = _sums(rows, task, ["u", "p"])
    u, p = (s[n][::-1].cumsum() / max(s[n].sum(), 1) for n in ("u", "p"))
    wide = p >= LEAST_MASS
    ratio = (u[wide] / p[wide]).min() if wide.any() else 0.5
    return float(np.clip(ratio, 0.02, 0.98))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    good = (labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"), MODULUS, HELD_OUT) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long").alias("good_id")).distinct())
    x = written(measured(docs), "quality-measures")
    rows = x.join(good, F.col("doc_id") == F.col("good_id"), "left").select(
        "doc_id", "x", F.col("good_id").isNotNull().alias("positive"))
    rows = written(rows, "quality-rows")
    k = len(MEASURES)
    s = _sums(rows, lambda v, p: {"u": np.array([len(v)]), "n": np.array([p.sum()]), "s": v.sum(0), "q": (v * v).sum(0)},
              ["u", "n", "s", "q"])
    if not len(s["n"]) or s["n"][0] == 0:
        centre, scale, w = np.zeros(k), np.ones(k), np.zeros(k)
    else:
        centre = s["s"] / s["u"][0]
        scale = np.sqrt(np.maximum(s["q"] / s["u"][0] - centre * centre, 0))
        scale[scale < 1e-9] = 1.0
        prior = class_prior(rows, _newton(rows, None, centre, scale), centre, scale)
        w = _newton(rows, prior, centre, scale)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (_sigmoid(_margin(np.stack(batch.column("x").to_numpy(zero_copy_only=False)).astype(np.float64), w, centre, scale))
                   if batch.num_rows else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own)], ["doc_id", "score"])
    return (rows.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
