"""Periodic runs against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from annospark.llm import runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(words: list, least: int = runs.LEAST, times: int = runs.TIMES) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(least, times * q):
                found.setdefault((a, i - a + q), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(seed: int) -> list[list[int]]:
    pick, out = random.Random(seed), []
    for _ in range(40):
        size = pick.choice([1, 2, 3, 30])
        row: list[int] = []
        for _ in range(pick.randint(0, 5)):
            kind = pick.random()
            if kind < 0.4:
                row += [pick.randrange(size) for _ in range(pick.randint(0, 40))]
            elif kind < 0.8:
                root = [pick.randrange(size) for _ in range(pick.choice([1, 2, 3, 5, 7, 8, 9, 13, 15, 16, 17, 31, 33]))]
                row += (root * 12)[:pick.randint(1, 110)]
            else:   # long stretches of one word inside the period
                root = [0] * pick.choice([7, 8, 15, 16, 20, 31]) + [1] * pick.choice([1, 2, 9])
                row += (root * 6)[pick.randint(0, 20):][:pick.randint(20, 190)]
        out.append(row)
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (3, 3), (10, 4), (60, 3)])
@pytest.mark.parametrize("seed", range(12))
def test_find(seed, least, times):
    rows = texts(seed)
    bounds = np.cumsum([0, *map(len, rows)])
    flat = np.array([w for r in rows for w in r], np.int64)
    got = [tuple(map(int, r)) for r in runs.find(flat, bounds, least, times)]
    expected = [(int(b) + s, n, q) for b, r in zip(bounds, rows, strict=False) for s, n, q in brute(r, least, times)]
    assert got == expected


def test_wavelet():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    tree = runs.Wavelet(values, 9)
    lo = rng.integers(0, 300, 200)
    hi = np.minimum(300, lo + rng.integers(1, 80, 200))
    x = rng.integers(0, 400, 200)
    assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(lo, hi, x, strict=True)]
    k = (hi - lo) // 2
    assert tree.kth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(lo, hi, k, strict=True)]


def test_documents(spark):
    pick = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 20), (4, "a b " * 20), (None, "x " * 30), (5, "é ü " * 24 + "z"),
            (6, " ".join(pick.choice("abc") for _ in range(400))), (7, "tick tock " * 60_000), (8, "once only")]
    frame = spark.createDataFrame([(k, t, "en", "s", 7) for k, t in rows], DOCS).selectExpr("*", "1 AS runs", "2 AS top")
    got = runs.collapse_runs(frame).collect()
    assert len(got) == len(rows)
    by_text = {(k, t): None for k, t in rows}
    for r in got:
        texts_ = [t for k, t in by_text if k == r["doc_id"]]
        words = (texts_[0] or "").encode().split()
        mine = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        expected = [(0, 120_000, 2)] if r["doc_id"] == 7 else brute(words)
        assert mine == expected and r["n_words"] == len(words)
        dropped = {i for s, n, q in mine for i in range(s + q, s + n)}
        assert r["collapsed"] == b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()
        best = max(mine, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r["top"] and tuple(r["top"])) == best
    assert runs.collapse_runs(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2])
def test_query_plants_and_digests(spark, tmp_path, size):
    import hashlib
    import zlib

    from annospark.llm import queries
    pick = random.Random(size)
    rows = [(i, " ".join(pick.choice(["ab", "c", "dé"]) for _ in range(pick.choice([1, 2, 30, 90])))) for i in range(60)]
    rows += [(61, None), (62, " \t"), (None, "a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(size).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.REGISTRY["op11_periodic_runs"][0](spark, str(tmp_path)).collect()}
    for key, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        mine, r = brute(words), got[key]
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in mine)
        dropped = {i for s, m, q in mine for i in range(s + q, s + m)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) == (
            len(mine), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        s, m, q = max(mine, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, m, q, m and 1000 * m // q)
