"""Phrase counts and scores against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from annospark.llm import collocations as co

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pieces(text: str | None) -> list[list[str]]:
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", lowered)]


def brute(rows, longest=4, least=30, share=(80, 100), first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside: Counter = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s:s + m]] = max(inside[p[s:s + m]], a)
        kept = []
        for p, a in cand.items():
            if share[1] * inside[p] >= share[0] * a:
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed: int, n: int = 160) -> list[tuple]:
    pick = random.Random(seed)
    vocabulary = ["of", "the", "New", "york", "été", "a", "B", "ss", "ß", "a\x00", "x y", "日本"]
    out = [(None, "en"), ("", "en"), (" \t\n.;", None), ("one of the", None)] + [("of the new york city", "en")] * 40
    for _ in range(n):
        words = [pick.choice(vocabulary[:pick.choice([3, 12])]) + pick.choice(["", "", "", ".", ",", "\n", "\t", "  ", "\x0b"])
                 for _ in range(pick.randint(0, 60))]
        out.append((" ".join(words), pick.choice(["en", "fr", None])))
    return out


@pytest.mark.parametrize("sizes", [{}, {"held": 40, "burst": 5}, {"held": 40, "vocabulary": 3, "burst": 2}])
@pytest.mark.parametrize("least", [30, 3])
def test_collocations(spark, monkeypatch, sizes, least):
    rows = made(least)
    frame = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], DOCS)
    frame = frame.selectExpr("*", "1 AS phrase", "2 AS f", "3 AS k", "4 AS score").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(frame, least=least, first=25, **sizes).collect())
    assert got == brute(rows, least=least, first=25)


@pytest.mark.parametrize("longest", [2, 3])
def test_shorter(spark, longest):
    rows = made(9)
    frame = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(tuple(r) for r in co.collocations(frame, longest=longest, least=5).collect())
    assert got == brute(rows, longest, 5)


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


@pytest.mark.parametrize("vocabulary", [10**6, 2])
def test_slices_of_one_text(vocabulary):
    pick = random.Random(4)
    text = " ".join(pick.choice(["a", "bb", "c.", "d"]) for _ in range(500)).encode()
    every = co.Bits(16, np.full(1024, 2**64 - 1, np.uint64))
    task, seen, last = co.Task((3, 4), every, every, held=20, vocabulary=vocabulary, burst=4), Counter(), np.zeros(0, np.int64)

    def keep(runs):
        for run in runs:
            for row in run.to_pylist():
                seen[row["phrase"]] += row["f"]
    for part, goes_on in co.slices([text], 40):
        if task.known() > task.vocabulary:
            words = [task.names[i] if i >= 0 else None for i in last.tolist()]
            keep(task.all_spilled())
            last = task.ids(b"x", words)
        assert goes_on == (len(last) > 0)
        last = task.add(b"x", part, last)
        if task.size > task.held:
            keep(task.spilled(task.held // 2))
    keep(task.all_spilled())
    expected = Counter(" ".join(ws[i:i + k]) for ws in pieces(text.decode()) for k in (3, 4) for i in range(len(ws) - k + 1))
    assert seen == expected


def test_bit_table(spark):
    words = [f"w{i}" for i in range(300)]
    table = co.bit_table(co.word_hashes(spark.createDataFrame([("en", w) for w in words], "lang string, phrase string"))).value
    assert all(table.has_one(co.word_hash(b"en", w.encode())) for w in words)
    assert sum(table.has_one(co.word_hash(b"en", f"v{i}".encode())) for i in range(3000)) < 100
