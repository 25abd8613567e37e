"""Operators on documents against brute force, with nulls, repeats, ties, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two three", "en", "b", 13),
    (4, "one two three", "en", "b", 13), (5, "One TWO three", "de", None, 13), (None, "x y z", "en", "b", 5),
    (6, "word " * 30000, "en", "c", 150000), (7, "ünï cödé ☃ \U0001f600 text", "xx", "c", 20),
    (8, "a@b.cd and 10.0.0.1 and 4111 1111 1111 1111 and +1 (017) 555-7713", "en", "c", 60),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["size", "score", "target", "key", "fp", "length", "candidates", "label", "component_id"]
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit(7).alias(c) for c in extra])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- mixing
def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, fixed = {}, {}
    goal = share * sum(sizes.values())
    while True:
        rest = goal - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        target = fixed | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return target
        fixed |= {s: float(cap * sizes[s]) for s in over}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(spark, request, which):
    from annospark.llm import mixing
    frame = request.getfixturevalue(which)
    rows = mixing.mixed_sizes(frame).collect()
    source = frame.select("doc_id", "source", "text").collect()
    assert len(rows) == len(source)
    sizes: dict = defaultdict(int)
    for r in source:
        sizes[r["source"]] += len(words(r["text"]))
    target = brute_targets(sizes)
    taken: dict = defaultdict(int)
    largest: dict = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] if which == "odd" else abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = mixing.mixed_sizes(frame.repartition(5)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows, key=key) == sorted(again, key=key)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed_sizes(frame.limit(0)).count() == 0
    assert mixing.mix(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- packing
def test_pieces_and_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    from annospark.llm import packing
    tokenizer = Tokenizer.from_file(packing.tokenizer_paths()[0])
    tokenizer.encode_special_tokens = True
    for frame in (docs, odd):
        source = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
                  for r in frame.select("doc_id", "text").collect()]
        rows = packing.packed_pieces(frame).collect()
        assert sum(len(ids) for _, ids in source) == sum(r["length"] for r in rows)
        want = []
        for key, ids in source:
            first = (len(ids) - 1) % 1024 + 1
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want.append((key, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
        got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
        order = lambda t: tuple((x is None, x) for x in t)
        assert sorted(got, key=order) == sorted(want, key=order)
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(bins) <= -(-sum(len(ids) for _, ids in source) // 1024) + 2
    assert packing.packed_pieces(docs.limit(0)).count() == 0


def test_sequences_round_trip(spark, docs):
    from annospark.llm import packing
    pieces = packing.pieces(docs.limit(40)).persist()
    packed = packing.pack(pieces).persist()
    sequences = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert sequences[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    pieces.unpersist()
    packed.unpersist()


def test_patterns_swap_the_smallest_piece():
    from annospark.llm import packing
    # greedy gives 6 + 3 (gap 1); best-two-fit turns the 3 into 2 + 2
    assert packing.patterns({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)
    counts = {n: (n * 7919) % 13 + 1 for n in range(1, 1025)}
    found = packing.patterns(counts)
    used: dict = defaultdict(int)
    for lengths, times in found:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert dict(used) == counts
    assert sum(t for _, t in found) <= 1.005 * sum(n * c for n, c in counts.items()) / 1024 + 1


# ---------------------------------------------------------------- quality rules
def brute_rules(text):
    text = text or ""
    own = words(text)
    windows = defaultdict(list)
    for i in range(len(own) - 7):
        windows[tuple(own[i:i + 8])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(own)
    return (n, sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


def test_quality_rules(spark, docs, odd):
    from annospark.llm import quality_rules
    for frame in (docs, odd):
        text = {(r["doc_id"], hash(r["text"])): r["text"] for r in frame.collect()}
        rows = quality_rules.quality_rules(frame).collect()
        source = sorted(((r["doc_id"] or -1), *brute_rules(r["text"])) for r in frame.collect())
        got = sorted(((r["doc_id"] or -1), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                      r["base_failed"]) for r in rows)
        assert got == source and text
        assert not any(r["kept"] and r["base_failed"] for r in rows)
        kept = quality_rules.keep_quality(frame)
        assert kept.columns == frame.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_fertility_rejects_what_vocabularies_cannot_read(spark):
    from annospark.llm import quality_rules
    clean = "The river rose in spring and the people of the valley moved their animals to higher ground until summer came again."
    noise = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:24] for i in range(40))
    rare = " ".join("\U00012000\U00012001\U00012002" for _ in range(12)) + " " + " ".join(chr(0x12010 + i) for i in range(30))
    frame = spark.createDataFrame([(1, clean), (2, noise), (3, rare)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(frame).collect()}
    assert rows[1]["kept"] and rows[1]["chars_per_token"] > 3
    assert rows[3]["fallback_share"] > rows[1]["fallback_share"] == 0
    assert rows[2]["chars_per_token"] < rows[1]["chars_per_token"]


# ---------------------------------------------------------------- near-duplicates
def brute_fingerprint(text):
    own = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words(text)]
    if not own:
        return 0
    shingles = [" ".join(own[i:i + 4]) for i in range(max(len(own) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark, docs, odd):
    from annospark.llm import simhash
    for frame in (docs, odd):
        source = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        fps = [brute_fingerprint(t) for _, t in source]
        roots = brute_components(fps)
        lowest: dict = {}
        for (key, _), r in zip(source, roots, strict=True):
            if key is not None:
                lowest[r] = min(lowest.get(r, key), key)
        want = sorted(((k is None, k or 0), f, lowest.get(r)) for (k, _), f, r in zip(source, fps, roots, strict=True))
        rows = simhash.near_duplicates(frame).collect()
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fp"] % 2 ** 64, r["component_id"]) for r in rows)
        assert got == want
        left = simhash.drop_near_duplicates(frame)
        assert left.columns == frame.columns and left.count() == len(set(roots))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_cover_the_radius_and_split_large_buckets(spark):
    import random

    from annospark.llm import common, simhash
    pick = random.Random(3)
    fps = {pick.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        for k in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in pick.sample(range(64), k)))
    centre = pick.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20, 40)}
    fps = sorted(fps)
    masks = [m % 2 ** 64 for m in simhash.covering_masks(4)]
    for _ in range(500):
        x = sum(1 << b for b in pick.sample(range(64), 4))
        assert any(not x & m for m in masks)
    signed = [(f - 2 ** 64 if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    roots = brute_components(fps)
    for block in (16, 1024):
        edges = simhash.links(frame, 4, block)
        found = {r["node"] % 2 ** 64: r["root"] for r in common.components(edges).collect()}
        groups = defaultdict(set)
        for f, r in zip(fps, roots, strict=True):
            groups[r].add(found.get(f, f"alone {f}"))
        assert all(len(g) == 1 for g in groups.values())
        assert len({x for g in groups.values() for x in g}) == len(groups)


def test_components_of_a_long_chain(spark):
    from annospark.llm import common
    n = 3000
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("x"), F.col("id"))
    chain = spark.range(n - 1).select((F.col("id") * 7 % n).alias("a"), ((F.col("id") + 1) * 7 % n).alias("b"))
    rows = common.components(chain).collect()
    assert len(rows) == n and {r["root"] for r in rows} == {0}
    assert edges.count() == n - 1


# ---------------------------------------------------------------- personal data
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
            "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_spans(text):
    return [(no, m.start(), m.end()) for no, (kind, p) in enumerate(PATTERNS.items())
            for m in re.finditer(p, text or "") if accepted(kind, m.group())]


TRICKY = ["a@b.c_d@e.f", "x.y@@z.w q@r.s.t.", "1.2.3.4.5.6.7.8", "999.1.1.1 00001.2.3.4 1.2.3.256", "1" * 5000, "4111-1111 1111-1111 5",
          "4111111111111111 4111 1111 1111 1111", "+1 (017) 555-7713 999.1.1.1", "+12345678--9)", "é@ü.x ☃a@b.co\U0001f600 c@d.ef",
          "5  4111111111111111", "a" * 20000 + "@b.c", "4111 1111 1111 1111 4111 1111 1111 1111"]


def test_personal_data(spark, docs, odd):
    from annospark.llm import pii
    extra = spark.createDataFrame([(100 + i, t, "en", "z", len(t)) for i, t in enumerate(TRICKY)], DOCS)
    for frame in (docs.unionByName(extra), odd):
        texts = {}
        for r in frame.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append(r["text"])
        rows = pii.find(frame).collect()
        for r in rows:
            base = [(s["kind_no"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
            assert base in [brute_spans(t) for t in texts[r["doc_id"]]], r["doc_id"]
        clean = pii.redact(frame)
        assert clean.columns == frame.columns and clean.count() == len(rows)
        for r in clean.where("text LIKE '%[%]%'").collect():
            assert not brute_spans(r["text"]) or r["doc_id"] in (107, 110)
    assert pii.find(docs.limit(0)).count() == 0
    assert pii.redact(docs.limit(0)).count() == 0


def test_personal_data_in_other_spellings(spark, docs):
    from annospark.llm import pii
    text = "Mail me: jane.doe (at) example (dot) org or call (212) 555-0147 today, order 1234-5678-9012-3456 at 12:30:45."
    more = spark.createDataFrame([(9001, text, "en", "z", len(text))], DOCS)
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(more)
    spans = next(r["spans"] for r in pii.find(frame).where("doc_id = 9001").collect())
    found = {(s["kind_no"], text[s["start"]:s["end"]]) for s in spans if not s["base"]}
    assert (0, "jane.doe (at) example (dot) org") in found
    assert not any("12:30" in t for _, t in found)


# ---------------------------------------------------------------- licences
def test_licence_scan(spark, docs, odd):
    from annospark.llm import licenses
    mit = dict(licenses.TEXTS)["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ;"), None, None, 0), (2, "text\nreleased UNDER the MIT licence!", None, None, 0),
            (3, "Licensed under the Apache Licence, v 2.0", None, None, 0), (4, None, None, None, None), (5, "...", None, None, 3),
            (6, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nother", None, None, 3)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash"))
    got = {r["doc_id"]: (r["licence"], r["line_licences"], r["n_lines"]) for r in licenses.scan(frame).collect()}
    assert got == {1: ("MIT", "", 0), 2: (None, "MIT", 1), 3: ("Apache-2.0", "", 0), 4: (None, "", 0), 5: (None, "", 0),
                   6: (None, "CC-BY-NC-4.0", 2)}
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_under_any_wrapping(spark):
    import textwrap

    from annospark.llm import licenses
    rows, expected = [], {}
    for key, text in dict(licenses.TEXTS).items():
        flat = " ".join(text.split())
        forms = [flat, *["\n".join(textwrap.wrap(flat, width)) for width in (45, 63, 72)]]
        forms.append("\n".join("// " + x for x in ["Copyright (c) 2019, 2021 Some Body", "All rights reserved.", *textwrap.wrap(flat, 70)]))
        forms.append("# Copyright 2001 by Some Body\n" + "\n".join("#  " + x for x in textwrap.wrap(flat, 58)))
        forms.append("/*\n" + "\n".join(" * " + x for x in ["Copyright Some Body, 2011", *textwrap.wrap(flat, 60)]) + "\n */")
        forms.append("© Some Body\n" + "\n".join(textwrap.wrap(flat, 51)))
        for form in forms:
            expected[len(rows)] = key
            rows.append((len(rows), form))
    rows.append((len(rows), "(c) You must retain all notices.\ncopyright notice and this permission notice stay"))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i]["licence"] for i in expected} == expected
    body = "c you must retain all notices copyright notice and this permission notice stay"
    assert got[len(rows) - 1]["digest"] == hashlib.sha256(body.encode()).hexdigest()


def test_licences_of_long_texts_repeats_and_more_texts(spark):
    from annospark.llm import licenses
    line = "Licensed under the MIT License.\n"
    rows = [(1, "x y\n" * 60_000 + line * 40_000), (2, line + "a"), (2, line + "a"), (None, line + line)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS whole", "3 AS lines")
    got = sorted(((r["doc_id"], r["line_licences"], r["n_lines"]) for r in licenses.scan(frame).collect()), key=str)
    assert got == sorted([(1, "MIT", 40_000), (2, "MIT", 1), (2, "MIT", 1), (None, "MIT", 2)], key=str)
    more = spark.createDataFrame([("Own-1.0", "You may do as you like."), ("None", None)], "licence string, text string")
    text = spark.createDataFrame([(1, "you may do\nas you LIKE")], "doc_id long, text string")
    assert [r["licence"] for r in licenses.scan(text, more).collect()] == ["Own-1.0"]
