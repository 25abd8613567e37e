"""Toxicity behind disguised spelling: noisy-channel deobfuscation, then scoring.

A character trigram model is counted over the words of all documents.  A
disguised word (digits or signs for letters, letters spaced out or split by
signs, repeated letters) becomes a lattice: each sign offers the letters it
may stand for, each run of one letter its shorter forms, each gap the end of a
word or nothing, each with the cost of the channel; Viterbi search finds the
restored words that the model and the channel together make likeliest.  A logistic model over words and beginnings of words of the
restored text, learned from labelled rows, gives the score.

Defined results: null and empty texts get the score of a text without
features; rows that repeat score alike; without usable labels (no rows, or
one label only) the score is the share of label 1, or 0; an empty table gives
no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import written

# Letters that a sign may stand for (fixed values).
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c", "*": "aeiouscktr", "#": "h",
}
_SIGNS = re.escape("".join(c for c in LOOKS_LIKE if not c.isdigit())) + "0-9"
#: Codes of the character model: 0 edge, 1-26 letters, then groups of other letters.
_GROUPS = ("áàâäãåæ", "éèêë", "íìîïóòôöõøúùûü", "ñçßÿý")
CODES = 32
_CODE = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {c: 27 + i for i, g in enumerate(_GROUPS) for c in g}
_OTHER = 31

#: Channel costs in nats: a sign read as a letter, kept as it is, a letter of a run dropped, a word ended at a gap.
READ, KEEP, DROP, BREAK = 1.0, 9.0, 0.7, 0.5
#: Restored or plain words kept by a worker; beyond it the table starts anew.
KEPT_WORDS = 300_000

#: Labelled rows used for the fit (by least hash), features by hash, least documents with a feature.
SAMPLE, BUCKETS, LEAST_DOCS = 20_000, 1 << 20, 5
#: Least strength of a feature's association with the label, in standard errors.
LEAST_Z = 4.0
#: Least odds of label 1 among its documents, in odds of all.
LEAST_ODDS = 2
#: L2 penalty of a weight, in documents.
DECAY = 0.05
PREFIXES = (4, 5, 6, 7)
HELD_OUT, MODULUS = 2, 4
THRESHOLD = 0.3

_DISGUISED = re.compile(rf"[^\W\d_]['’.\-_]?[{_SIGNS}]|[{_SIGNS}][^\W\d_]|([^\W\d_])\1\1|(?:[^\W\d_][._\-~*'/]){{2,}}[^\W\d_]")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][._\-~'/]){2,}[^\W\d_](?![^\W_])")
_SPACED = re.compile(rf"(?<!\S)(?:[^\W_]|[{_SIGNS}])(?:[ \t._\-*~/]{{1,2}}(?:[^\W_]|[{_SIGNS}])){{2,}}(?!\S)")
_SPLITS = re.compile(r"[ \t._\-~/'’]+")
#: Runs of one letter or sign, and gaps.
_PARTS = re.compile(r"[ \t._\-~/'’]+|([^ \t._\-~/'’])\1*", re.S)
_EDGE = re.compile(r"^[^\w@$!|+(<€£¢*]+|(?:([#*$%&!|+])\1+)?[^\w@$*]*$")
_LETTERS = re.compile(r"[^\W\d_]+")


def codes(word: str) -> list[int]:
    return [_CODE.get(c, _OTHER) for c in word]


# ---------------------------------------------------------------- character model
def _trigrams(texts: list[str]) -> Counter:
    """Counts of code triples over the letters-only words of some texts."""
    joined = "  " + "  ".join(texts).lower() + "  "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    table = np.full(0x250, _OTHER, np.uint8)
    table[:0x80] = 0
    for c, code in _CODE.items():
        table[ord(c)] = code
    own = table[np.minimum(points, 0x24F)].astype(np.int32)
    # an edge between words counts once before a word and once after it
    own = own[~((own == 0) & np.r_[False, own[:-1] == 0] & np.r_[False, False, own[:-2] == 0])]
    seen = np.bincount((own[:-2] * CODES + own[1:-1]) * CODES + own[2:], minlength=CODES ** 3)
    return Counter({int(i): int(seen[i]) for i in np.flatnonzero(seen)})


def character_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): trigram counts over the whole texts of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES ** 3, np.int64)
        for batch in batches:
            part: list[str] = []
            size = 0
            for t in batch.column("text"):
                text = t.as_py()
                if text:
                    part.append(text)
                    size += len(text)
                if size > 1_000_000:
                    for i, n in _trigrams(part).items():
                        total[i] += n
                    part, size = [], 0
            if part:
                for i, n in _trigrams(part).items():
                    total[i] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])
    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(counts: dict[int, int]) -> np.ndarray:
    """-log p(c | a, b) as [a, b, c], trigrams backed off to bigrams and single characters."""
    tri = np.zeros((CODES,) * 3)
    for gram, n in counts.items():
        tri.ravel()[gram] = n
    bi, one = tri.sum(0), tri.sum((0, 1))
    one = (one + 1) / (one.sum() + CODES)
    bi = (bi + 4 * one) / (bi.sum(1, keepdims=True) + 4)
    tri = (tri + 2 * bi[None]) / (tri.sum(2, keepdims=True) + 2)
    return -np.log(tri)


# ---------------------------------------------------------------- lattice and Viterbi search
def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Readings and their channel costs: of each run of one letter, each sign and each gap.

    Signs of a run may stand for different letters; the run is one disguise, so
    its first sign bears the cost of it, and each further one may be dropped.  A
    gap ends a word (a space) or is nothing: without cost between letters that
    stand apart, unless it is wider than others, and else at the cost of a sign.
    """
    cells: list[list[tuple[str, float]]] = []
    parts = [m.group() for m in _PARTS.finditer(word)]
    least = min((len(x) for x in parts if _SPLITS.fullmatch(x)), default=0)
    for i, part in enumerate(parts):
        run, c = len(part), part[0]
        letters = LOOKS_LIKE.get(c, "")
        if c.isalpha():
            cells.append([(c, DROP if run > 1 else 0.0)] + ([(c * 2, 0.0 if run == 2 else DROP)] if run > 1 else []))
        elif letters:
            cost = math.log(len(letters))
            cells.append([(x, READ + cost) for x in letters] + [("", KEEP)])
            cells += [[(x, cost) for x in letters] + [("", DROP)]] * (run - 1)
        elif _SPLITS.fullmatch(part):
            apart = run == least and all(len(x) == 1 for x in parts[max(i - 1, 0):i + 2:2])
            cells.append([("", 0.0 if apart else READ), (" ", BREAK)])
        else:
            cells.append([("", READ)])
    return cells


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word, or of several with gaps between them."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(word):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, read) in best.items():
            for reading, price in options:
                x, y, total = a, b, cost + price
                if reading == " ":  # the model sees two edges between words
                    total += model[x, y, 0]
                    x = y = 0
                else:
                    for c in reading:
                        code = _CODE.get(c, _OTHER)
                        total += model[x, y, code]
                        x, y = y, code
                if (x, y) not in step or total < step[x, y][0]:
                    step[x, y] = (total, (read, reading) if reading else read)
        best = step
    last = min(((cost + model[a, b, 0], (a, b)) for (a, b), (cost, _) in best.items()))[1]
    out, read = [], best[last][1]
    while read is not None:
        read, reading = read
        out.append(reading)
    return "".join(reversed(out))


def buckets(words: tuple[str, ...] | list[str]) -> set[int]:
    """Buckets of words and of their beginnings."""
    out: set[str] = set()
    for w in words:
        if len(w) > 2:
            out.add(w)
            out.update(f"{w[:n]}-" for n in PREFIXES if len(w) > n)
    return {zlib.crc32(x.encode()) % BUCKETS for x in out}


class Features:
    """Buckets of the restored words of whole texts, all or only the ``wanted`` ones,
    with a bounded table of the tokens seen."""

    def __init__(self, model: np.ndarray, wanted: frozenset[int] | None = None):
        self.model, self.wanted = model, wanted
        self.seen: dict[str, tuple[int, ...]] = {}

    def restored(self, token: str) -> tuple[str, ...]:
        """Restored words of one token between white space."""
        if not _DISGUISED.search(token):
            return (token,) if token.isalpha() else tuple(_LETTERS.findall(token))
        core = _EDGE.sub("", token)
        if not _DISGUISED.search(core) or core.startswith("http") or "@" in core and "." in core:
            return tuple(_LETTERS.findall(core or token))
        read = _LETTERS.findall(restore(core, self.model))
        parts = _SPLITS.split(core)
        if _APART.search(core):
            read += self.unbroken("".join(parts))
        if len(parts) > 1:
            read += [w for part in parts if _DISGUISED.search(part) for w in _LETTERS.findall(restore(part, self.model))]
        return (*read, *(w for w in _LETTERS.findall(core) if len(w) > 3))

    def unbroken(self, joined: str) -> list[str]:
        """Letters that stood apart read as one word, and the beginnings at every place of it.

        The model tells too little about ends of words, so a word may begin anywhere.
        """
        read = _LETTERS.findall(restore(joined, self.model))
        return read + [w[i:i + n] for w in read for i in range(1, len(w)) for n in (3, 4, PREFIXES[-1] + 1)]

    def spaced(self, text: str) -> list[str]:
        """Restored words of letters that stand apart."""
        out: list[str] = []
        for found in _SPACED.finditer(text):
            joined = _SPLITS.sub("", found.group())
            if any(c.isalpha() for c in joined) and len(set(joined)) > 1:
                out += _LETTERS.findall(restore(found.group(), self.model)) + self.unbroken(joined)
        return out

    def words(self, text: str) -> list[str]:
        text = text.lower()
        return [w for token in text.split() for w in self.restored(token)] + self.spaced(text)

    def _own(self, words: tuple[str, ...] | list[str]) -> tuple[int, ...]:
        own = buckets(words)
        return tuple(own if self.wanted is None else own & self.wanted)

    def __call__(self, text: str) -> np.ndarray:
        text = text.lower()
        seen, out = self.seen, set()
        if len(seen) > KEPT_WORDS:
            seen.clear()
        for token in set(text.split()):
            own = seen.get(token)
            if own is None:
                own = seen[token] = self._own(self.restored(token))
            if own:
                out.update(own)
        out.update(self._own(self.spaced(text)))
        return np.array(sorted(out), np.int32)


# ---------------------------------------------------------------- scores
class Scorer:
    """Weights of the chosen buckets; score = logistic of their sum."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.bias = bias
        self.weights = dict(zip(buckets.tolist(), weights.tolist(), strict=True))

    def __call__(self, found: np.ndarray) -> float:
        z = self.bias + sum(self.weights.get(i, 0.0) for i in found.tolist())
        return 1.0 / (1.0 + math.exp(-min(max(z, -60.0), 60.0)))


def chosen_buckets(rows: DataFrame) -> np.ndarray:
    """Buckets that go with label 1 in ``rows`` (label, found), counted by Spark."""
    total = rows.agg(F.avg("label").alias("rate")).first()["rate"]
    if total is None or not 0 < total < 1:
        return np.zeros(0, np.int64)
    n, n1, rate = F.col("n"), F.col("n1"), F.lit(total)
    stands_out = (n1 - n * rate) / F.sqrt(n * rate * (1 - rate)) >= LEAST_Z
    counted = (rows.select("label", F.explode("found").alias("bucket")).groupBy("bucket")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1"))
               .where((n >= LEAST_DOCS) & stands_out & ((n1 + rate) / (n - n1 + 1 - rate) > LEAST_ODDS * rate / (1 - rate))))
    return np.array(sorted(r["bucket"] for r in counted.select("bucket").collect()), np.int64)  # at most BUCKETS numbers


def fit(chosen: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> Scorer:
    """Logistic regression with L2 over the chosen buckets."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Scorer(np.zeros(0, int), np.zeros(0), math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    r = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    c = np.searchsorted(chosen, np.concatenate([x for x, _ in rows]))
    rate = y.mean()
    w, b = np.zeros(len(chosen)), math.log(rate / (1 - rate))
    m, g2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, 301):  # Adam on the whole sample
        margin = b + np.bincount(r, w[c], minlength=len(y))
        miss = 1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y
        grad = np.r_[(np.bincount(c, miss[r], minlength=len(chosen)) + DECAY * w) / len(y), miss.mean()]
        m = 0.9 * m + 0.1 * grad
        g2 = 0.99 * g2 + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(g2 / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Scorer(chosen, w, float(b))


def held_out(doc_id: Column, modulus: int = MODULUS, remainder: int = HELD_OUT) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, out: Column, sample: int) -> DataFrame:
    """doc_id, text, label of at most ``sample`` different labelled rows outside the held-out part, by least hash.

    Repeated rows count once; of an id with many texts only as many rows are taken as the sample has left.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    few = known.where(~out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample bounds the broadcast side
    known_rows = rows.join(F.broadcast(few), "doc_id").withColumn("__key", F.xxhash64("doc_id", F.lit("fit"), "text"))
    # the sample's last key; one row for each different row of the table is sorted, and only the first are kept
    last = known_rows.select("__key").distinct().orderBy("__key").limit(sample).agg(F.max("__key")).scalar()
    return known_rows.where(F.col("__key") <= last).dropDuplicates(["doc_id", "__key"]).drop("__key")


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = character_model({r["gram"]: r["n"] for r in character_counts(docs).collect()})  # at most 32^3 rows
    out = held_out(F.col("doc_id"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model)
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "found"])
    train = training_rows(docs, labels, "toxic", out, sample).select("label", "text")
    rows = written(train.mapInArrow(featured, "label int, found array<int>"), "toxicity-train")
    chosen = chosen_buckets(rows)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(x, chosen).astype("<i4").tobytes() for x in batch.column("found").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "found"])
    few = rows.mapInArrow(picked, "label int, found binary").collect()
    scorer = fit(chosen, [(np.frombuffer(r["found"], "<i4"), r["label"]) for r in few])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model, frozenset(scorer.weights))
        for batch in batches:
            score = [scorer(features(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       out.alias("held_out"))
    return (rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
