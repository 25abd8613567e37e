"""Quality rules by tokeniser fertility.

Public vocabularies say how well a text looks like what they were made from:
characters per token of a byte-level BPE, share of bytes that a piece
vocabulary can only write byte by byte, and entropy of the token distribution.  Each
script has bands; a text outside them is rejected.

Defined results: null, empty and white-space texts have no words, so the base rule
rejects them; rows that repeat are judged alike; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.tokens import RANKS, parts_table

PIECES = "piece_bpe_32k.model"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

#: Bands by script: least and most characters per token, most share of fallback
#: bytes, least and most token entropy relative to the logarithm of the token count.
#: Measured: clean documents of the given tables have at least 1.61 characters a
#: token, English prose 5, random letters 1.45 to 1.61, base64 1.28 to 1.32, runs
#: of signs 1.10 to 1.19.
BANDS = {
    "latin": (1.56, 8.0, 0.20, 0.30, 1.0),
    "signs": (1.30, 12.0, 0.90, 0.20, 1.0),   # no letters at all
    "greek": (0.40, 4.0, 0.30, 0.30, 1.0),
    "cyrillic": (0.40, 5.0, 0.20, 0.30, 1.0),
    "hebrew": (0.30, 4.0, 0.40, 0.25, 1.0),
    "arabic": (0.30, 4.0, 0.40, 0.25, 1.0),
    "indic": (0.15, 3.0, 0.90, 0.20, 1.0),
    "cjk": (0.20, 3.0, 0.80, 0.25, 1.0),
    "other": (0.10, 12.0, 0.90, 0.20, 1.0),
}
#: Scripts by the first byte of a letter's UTF-8 form (fixed by the encoding).
_SCRIPT_BYTES = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD4)], "hebrew": [0xD6, 0xD7],
    "arabic": [*range(0xD8, 0xDC)], "indic": [0xE0], "cjk": [*range(0xE3, 0xEE)],
}
_SCRIPTS = np.array([[b in own for own in _SCRIPT_BYTES.values()] for b in range(256)], np.int64)
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, script string, chars_per_token double, fallback_share double, "
          "token_entropy double, kept boolean")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside ``window``-word runs that the text holds at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    runs = np.zeros(n, np.uint64)
    for k in range(window):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n]
        runs ^= runs >> np.uint64(29)
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=1)
def piece_characters(path: str) -> frozenset[str]:
    """Characters that are a piece of their own; all others are written byte by byte."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(p for i in range(model.get_piece_size()) if len(p := model.id_to_piece(i)) == 1)


class Fertility:
    """Measures of a text by the public vocabularies."""

    def __init__(self, ranks_path: str, pieces_path: str):
        self.ids = parts_table(ranks_path)
        self.pieces_path = pieces_path

    def __call__(self, text: bytes, words: list[bytes], histogram: np.ndarray, chars: int) -> tuple[str, float, float, float]:
        letters = histogram @ _SCRIPTS
        script = (list(_SCRIPT_BYTES)[int(letters.argmax())] if letters.any() else
                  "other" if histogram[0x80:].any() else "signs")
        counts = Counter(words)
        table = self.ids
        own = [table[w.decode()] for w in counts]
        flat = np.frombuffer(b"".join(own), np.uint32)
        weight = np.repeat(np.fromiter(counts.values(), np.float64, len(own)),
                           np.fromiter(map(len, own), np.int64, len(own)) // 4)
        total = float(weight.sum())
        mass = np.bincount(flat, weight)
        mass = mass[mass > 0] / total
        entropy = float(-(mass * np.log2(mass)).sum())
        relative = entropy / np.log2(max(total, 2.0))
        fallback = 0
        if histogram[0x80:].any():
            known = piece_characters(self.pieces_path)
            whole = text.decode()
            fallback = sum(len(c.encode()) * whole.count(c) for c in set(whole) - known if c > "\x7f")
        return script, chars / total, fallback / max(total, 1.0), relative


def measure(key: int | None, text: bytes | None, fertility: Fertility, bands: dict) -> tuple:
    text = text or b""
    words = text.split()
    n = len(words)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(len(text) - histogram[0x80:0xC0].sum() - histogram[_SPACE].sum())
    symbols = int(histogram[_SYMBOLS].sum())
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    base = (key, n, chars, symbols, dup_lines(text), repeated, failed)
    if not n:
        return (*base, "other", None, None, None, False)
    script, per_token, fallback, entropy = fertility(text, words, histogram, chars)
    least, most, most_fallback, low, high = bands[script]
    inside = least <= per_token <= most and fallback <= most_fallback and low <= entropy <= high + 1e-9
    return (*base, script, per_token, fallback, entropy, bool(inside and not failed))


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(RANKS), public_tokenizers.path(PIECES)


def quality_rules(docs: DataFrame, bands: dict | None = None, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row a document: base counts, fertility measures, verdict ``kept``."""
    bands, paths = bands or BANDS, paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(*paths)
        for batch in batches:
            rows = [measure(k, t.as_py(), fertility, bands)
                    for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_quality(docs: DataFrame, bands: dict | None = None, paths: tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``docs`` that the rules keep, judged in place, without a shuffle."""
    bands, paths = bands or BANDS, paths or vocabulary_paths()
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(*paths)
        at = schema.names.index("text")
        for batch in batches:
            kept = [measure(None, t.encode() if (t := x.as_py()) is not None else None, fertility, bands)[-1]
                    for x in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))
    return docs.mapInArrow(run, schema)
