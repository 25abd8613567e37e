"""Least squares packing: ids of the tokenizer, the fit, the plan and whole round trips."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from annospark.llm import nnls_packing as nn
from annospark.llm.word_ids import Parts, text_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def own(parts: Parts, text: str) -> list[int]:
    return array("I", text_ids(parts, text.encode())).tolist()


def test_ids_of_documents(whole, spark):
    parts = Parts(PATH, limit=500)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect():
        assert own(parts, r[0]) == whole(r[0])


def test_ids_of_odd_texts(whole):
    parts, pick = Parts(PATH), random.Random(3)
    alphabet = list("abcdefgxyzAÉé ßüñ'’.,-_0123456789²½\t\n\r\x0b\x0c\x1c\x85\xa0 ​İıſΣς日本́😀<|>!?#@") + [
        "'s", "'ll", "'re", "<|endoftext|>", "the", "ing", " of ", "Ångström", "é", "\x00"]
    for _ in range(4000):
        text = "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 14)))
        assert own(parts, text) == whole(text), repr(text)


def test_ids_of_made_words(whole):
    parts, pick = Parts(PATH), random.Random(8)
    for _ in range(400):
        text = " ".join("".join(pick.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(pick.randint(1, 14))) for _ in range(40))
        assert own(parts, text) == whole(text)


def test_combinations():
    counts = np.zeros(25, np.int64)
    counts[[1, 2, 3, 5, 8, 11, 12, 16, 24]] = [4, 9, 1, 1, 7, 2, 5, 3, 2]
    there = np.flatnonzero(counts).tolist()
    expected = {tuple(sorted(c)) for k in (1, 2, 3) for c in combinations_with_replacement(there, k) if sum(c) == 24}
    got = [tuple(sorted(n for n in r if n)) for r in nn.combinations(counts, 24).tolist()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert len(nn.combinations(counts, 24, 4)) == 4


def test_fit_is_the_least_squares_solution():
    rng = np.random.default_rng(1)
    counts = np.concatenate([[0], rng.integers(0, 60, 32)])
    rows = nn.combinations(counts, 32)
    x = nn.fitted(rows, counts, 4000)
    a = np.zeros((33, len(rows)))
    for j, row in enumerate(rows):
        for n in row[row > 0]:
            a[n, j] += 1
    slope = a.T @ (a @ x - counts)
    assert (x >= 0).all() and slope.min() > -0.05 and abs(slope[x > 0.05]).max() < 0.05


def check_slots(counts: dict[int, int], capacity: int, slots: list[tuple]) -> None:
    sequences, covered = defaultdict(list), Counter()
    for whole_, first, stop, start, length, sequence, offset in slots:
        for k in range(first, stop):
            sequences[sequence + k - first].append((offset, length))
            covered.update((whole_, k, start + i) for i in range(length))
    assert set(covered.values()) <= {1}
    assert set(covered) == {(n, k, i) for n, c in counts.items() for k in range(c) for i in range(n)}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


@pytest.mark.parametrize("seed", range(25))
def test_plan(seed):
    pick = random.Random(seed)
    capacity = pick.choice([8, 32, 64])
    counts = {pick.randint(1, capacity): pick.choice([1, 2, 7, 40]) for _ in range(pick.randint(0, 30))}
    check_slots(counts, capacity, nn.plan(counts, capacity, most=pick.choice([3, 1000]), steps=40))


def test_plan_does_not_grow():
    pick = random.Random(6)
    counts = {n: pick.randint(0, 30) for n in range(1, 2049)}
    small, large = nn.plan(counts), nn.plan({n: c * 1_000_000 for n, c in counts.items()})
    assert len(large) < 5 * nn.COMBINATIONS and len(small) < 5 * nn.COMBINATIONS
    assert sum((s[2] - s[1]) * s[4] for s in large) == 1_000_000 * sum(n * c for n, c in counts.items())
    assert len(nn.plan({1500: 10**9, 1: 3})) < 1000


def check_packed(rows, docs, whole, capacity, end):
    expected = Counter()
    by_key = defaultdict(list)
    for key, text in docs:
        by_key[key].append([*whole(text), end])
    sequences, ids_of = defaultdict(list), defaultdict(Counter)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        fits = [ids for ids in by_key[r["doc_id"]] if len(ids) == r["doc_tokens"]
                and zlib.crc32(array("I", ids[r["start"]:r["start"] + r["length"]]).tobytes()) == r["ids_crc32"]]
        assert fits, r
        ids_of[r["doc_id"], r["doc_tokens"]].update(range(r["start"], r["start"] + r["length"]))
    for key, texts in by_key.items():
        for n, times in Counter(map(len, texts)).items():
            expected[key, n] = times
            assert ids_of[key, n] == {i: times for i in range(n)}
    assert set(ids_of) == set(expected)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


@pytest.mark.parametrize("capacity, limit", [(2048, 2000), (64, 3)])
def test_round_trip(spark, whole, capacity, limit):
    rows = [(i, r[0]) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    rows += [(None, "no id"), (500, None), (501, ""), (502, " \t\n"), (503, "many words " * 3000), (504, "ünï ☃ 日本語 text")]
    rows += [(505, "the same row again")] * 90
    frame = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    frame = frame.selectExpr("*", "1 AS length", "2 AS number", "3 AS place", "4 AS ids", "5 AS sequence_id")
    got = nn.packed_pieces(frame, capacity, limit=limit).collect()
    check_packed(got, rows, whole, capacity, 1)
    assert nn.packed_pieces(frame.limit(0), capacity).count() == 0
