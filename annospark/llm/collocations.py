"""Phrase collocations by counting in HAT-tries.

Phrases are counted inside the tasks in a burstable trie: under a shallow trie
of word ids hang hash containers from the rest of a phrase to its count.  A
container that grows too large bursts into one container for each next word.
When a task's trie holds too many phrases, its largest subtrees are emitted
whole as sorted runs.  The runs are written, dealt by range of (language,
phrase), that is by prefix, so that a hot prefix spans many partitions, and
merged there.

A phrase that counts has only parts that count.  So words are counted first,
then hashes of pairs of words that count; a pair occurs at most as often as its
hash.  Phrases are counted only where all their words and pairs may count.  The
tasks know both by bit tables of bounded size: a false hit costs a count, never
a result.  Counts are exact.

Defined results: null, empty and white-space texts have no words; a null lang
is ``und``; repeated rows count each; ties are in the order given; an empty
table gives no rows; columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annospark.llm.common import written

LONGEST, LEAST, SHARE, FIRST = 4, 30, (80, 100), 2000
SCALE = 2_000_000
#: Phrases in a task's trie before it spills; words of a task before all is spilled; entries before a container bursts.
HELD, VOCABULARY, BURST = 300_000, 250_000, 20_000
#: Bytes of text split at once.
SLICE = 1 << 21
#: Bits of the table of an earlier level: 16 for each phrase, up to 8 MB.
BITS, MOST_BITS = 16, 26
#: Groups in which a language is ranked first.
SALTS = 64

_ID = 21
_CUT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)
#: Stands for a cut; no lower-cased text holds it.
_BREAK = b"A"
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bits of a pair's hash; pairs with equal hashes are counted together before the exact count.
PAIR_BITS = 40
#: Pair hashes of a task before they are emitted.
PAIRS_HELD = 500_000
RUNS = "lang string, phrase string, k int, f long"


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * _ODD1 + right
    return ((mixed ^ (mixed >> np.uint64(29))) * _ODD2) >> np.uint64(64 - PAIR_BITS)


class Bits:
    """A table of 2^log bits, two of them set for each key."""

    def __init__(self, log: int, packed: np.ndarray):
        self.log, self.packed = log, packed

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.log)
        return (keys * _ODD1) >> shift, ((keys + _ODD1) * _ODD2) >> shift

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, two = (self.packed[at >> np.uint64(6)] >> (at & np.uint64(63)) for at in self.places(keys))
        return one & two & np.uint64(1) == 1

    def has_one(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])


class Words(dict):
    """word -> id for one language; words outside the table of counted words are -1."""

    def __init__(self, task: Task, lang: bytes):
        super().__init__({_BREAK: -1})
        self.task, self.lang = task, lang

    def learn(self, parts: list[bytes]) -> None:
        """Ids for the new ones among ``parts``."""
        task = self.task
        new = [w for w in set(parts) if w not in self]
        if not new:
            return
        if task.words is not None:
            hashes = np.array([word_hash(self.lang, w) for w in new], np.uint64)
            known = task.words.has(hashes)
            self.update((w, -1) for w, k in zip(new, known.tolist(), strict=True) if not k)
            new = [w for w, k in zip(new, known.tolist(), strict=True) if k]
            task.hashes = np.concatenate([task.hashes, hashes[known]])
        self.update(zip(new, range(len(task.names), len(task.names) + len(new)), strict=True))
        task.names += new
        task.langs += [self.lang] * len(new)


class Task:
    """The trie of one task: first word -> container, or -> next word -> container."""

    def __init__(self, lengths: tuple[int, ...], words: Bits | None, pairs: Bits | None,
                 held: int = HELD, vocabulary: int = VOCABULARY, burst: int = BURST):
        self.lengths, self.words, self.pairs = lengths, words, pairs
        self.held, self.vocabulary, self.burst = held, vocabulary, burst
        self.clear()

    def clear(self) -> None:
        self.root: dict[int, dict] = {}
        self.burst_nodes: set[int] = set()
        self.names: list[bytes] = []
        self.langs: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.split: dict[bytes, Words] = {}
        self.singles = np.zeros(0, np.int64)
        self.hashed: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def known(self) -> int:
        return sum(map(len, self.split.values()))

    def ids(self, lang: bytes, words: list[bytes | None]) -> np.ndarray:
        known = self.split.setdefault(lang, Words(self, lang))
        known.learn([w for w in words if w is not None])
        return np.array([-1 if w is None else known[w] for w in words], np.int64)

    def add(self, lang: bytes, text: bytes, before: np.ndarray) -> np.ndarray:
        """Count the phrases of a slice that end in it; ``before``: the last ids of the same text."""
        words = self.split.get(lang)
        if words is None:
            words = self.split[lang] = Words(self, lang)
        parts = text.lower().translate(_CUT).replace(b"\n", b" A ").split()
        words.learn(parts)
        ids = np.concatenate([before, np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))])
        if self.lengths == (1,):
            seen = np.bincount(ids[len(before):] + 1, minlength=len(self.names) + 1)[1:]
            seen[:len(self.singles)] += self.singles
            self.singles = seen
        else:
            self.count(ids, len(before))
        keep = max(self.lengths) - 1
        return np.concatenate([before, ids])[-keep:] if keep else before

    def count(self, ids: np.ndarray, before: int) -> None:
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.flatnonzero(joined)
        hashes = pair_hash(self.hashes[ids[at]], self.hashes[ids[at + 1]])
        if self.pairs is None:   # only hashes of pairs are counted
            keys, times = np.unique(hashes[at + 2 > before], return_counts=True)
            self.hashed.append((keys, times))
            self.size += len(keys)
            return
        joined[at] = self.pairs.has(hashes)
        firsts, rests = [], []
        good = joined
        for k in range(2, max(self.lengths) + 1):
            if k > 2:
                good = good[:-1] & joined[k - 2:]
            if k not in self.lengths:
                continue
            at = np.flatnonzero(good)
            at = at[at + k > before]
            rest = np.zeros(len(at), np.int64)
            for j in range(1, k):
                rest |= (ids[at + j] + 1) << (_ID * (3 - j))
            firsts.append(ids[at])
            rests.append(rest)
        first, rest = np.concatenate(firsts), np.concatenate(rests)
        if not len(first):
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.append(True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1]))
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(first))).tolist()
        first, rest = first[heads], rest[heads]
        groups = np.flatnonzero(np.append(True, first[1:] != first[:-1])).tolist()
        names, rest = first[groups].tolist(), rest.tolist()
        for name, lo, hi in zip(names, groups, [*groups[1:], len(rest)], strict=True):
            self.insert(name, rest[lo:hi], times[lo:hi])

    def insert(self, name: int, rest: list[int], times: list[int]) -> None:
        node = self.root.get(name)
        if node is None:
            self.root[name] = dict(zip(rest, times, strict=True))
            self.size += len(rest)
        elif name in self.burst_nodes:
            for r, n in zip(rest, times, strict=True):
                child = node.setdefault(r >> 2 * _ID, {})
                old = len(child)
                child[r] = child.get(r, 0) + n
                self.size += len(child) - old
        else:
            old, get = len(node), node.get
            for r, n in zip(rest, times, strict=True):
                node[r] = get(r, 0) + n
            self.size += len(node) - old
            if len(node) > self.burst:
                children: dict[int, dict[int, int]] = {}
                for r, n in node.items():
                    children.setdefault(r >> 2 * _ID, {})[r] = n
                self.root[name] = children
                self.burst_nodes.add(name)

    def spilled(self, least: int) -> Iterator[pa.RecordBatch]:
        """Emit whole subtrees, the largest first, until at most ``least`` phrases are left."""
        leaves = []
        for name, node in self.root.items():
            if name in self.burst_nodes:
                leaves += [(len(child), name, second) for second, child in node.items()]
            else:
                leaves.append((len(node), name, -1))
        leaves.sort(reverse=True)
        taken, held = [], 0
        for size, name, second in leaves:
            if self.size <= least:
                break
            if second < 0:
                container = self.root.pop(name)
            else:
                container = self.root[name].pop(second)
                if not self.root[name]:
                    del self.root[name]
                    self.burst_nodes.discard(name)
            self.size -= size
            taken.append((name, container))
            held += size
            if held > 200_000:
                yield self.run(taken)
                taken, held = [], 0
        if taken:
            yield self.run(taken)

    def run(self, taken: list[tuple[int, dict[int, int]]]) -> pa.RecordBatch:
        """One sorted run of whole subtrees."""
        names, langs = pa.array(self.names, pa.binary()), pa.array(self.langs, pa.binary())
        sizes = [len(c) for _, c in taken]
        total = sum(sizes)
        rest = np.fromiter((r for _, c in taken for r in c), np.int64, total)
        times = np.fromiter((n for _, c in taken for n in c.values()), np.int64, total)
        ids = [np.repeat(np.array([name for name, _ in taken], np.int64), sizes)]
        ids += [((rest >> _ID * (2 - j)) & ((1 << _ID) - 1)) - 1 for j in range(3)]
        words = [names.take(pa.array(i, mask=i < 0)) for i in ids]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()), null_handling="skip")
        k = sum((i >= 0).astype(np.int32) for i in ids)
        return _sorted(langs.take(pa.array(ids[0])), phrase, k, times)

    def all_spilled(self) -> Iterator[pa.RecordBatch]:
        if self.lengths == (1,):
            if self.names:
                yield _sorted(pa.array(self.langs, pa.binary()), pa.array(self.names, pa.binary()),
                              np.ones(len(self.names), np.int32), self.singles)
        elif self.hashed:
            keys = np.concatenate([h for h, _ in self.hashed])
            times = np.concatenate([n for _, n in self.hashed])
            order = np.argsort(keys)
            keys = keys[order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
            if len(heads):
                yield pa.RecordBatch.from_arrays([pa.array(keys[heads].astype(np.int64)),
                                                  pa.array(np.add.reduceat(times[order], heads))], ["h", "f"])
        else:
            yield from self.spilled(0)
        self.clear()


def _sorted(lang: pa.Array, phrase: pa.Array, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    run = pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(k), pa.array(f)],
                                     ["lang", "phrase", "k", "f"])
    return run.take(pc.sort_indices(run, [("lang", "ascending"), ("phrase", "ascending")]))


def slices(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[bytes, bool]]:
    """Texts joined by a cut up to ``size``, and longer ones in slices: (bytes, goes on with the slice before)."""
    joined, held = [], 0
    for text in texts:
        if len(text) <= size:
            joined.append(text)
            held += len(text)
            if held > size:
                yield b"\n".join(joined), False
                joined, held = [], 0
            continue
        at = 0
        while at < len(text):
            stop = text.find(b" ", at + size)
            stop = len(text) if stop < 0 else stop
            yield text[at:stop], at > 0
            at = stop
    if joined:
        yield b"\n".join(joined), False


def counted_runs(docs: DataFrame, lengths: tuple[int, ...], words: Broadcast | None = None, pairs: Broadcast | None = None,
                 held: int = HELD, vocabulary: int = VOCABULARY, burst: int = BURST) -> DataFrame:
    """Sorted runs (lang, phrase, k, f) of the tasks; a phrase may come in many.  With ``words`` but without
    ``pairs``: (h, f) of the hashes of pairs."""
    only_hashes = words is not None and pairs is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(lengths, words and words.value, pairs and pairs.value, held, vocabulary, burst)
        none = np.zeros(0, np.int64)
        for batch in batches:
            by_lang: dict[bytes, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    by_lang.setdefault(lang.encode(), []).append(text.as_buffer().to_pybytes())
            for lang, texts in by_lang.items():
                last = none
                for part, goes_on in slices(texts):
                    last = last if goes_on else none
                    if task.known() > task.vocabulary or (only_hashes and task.size > PAIRS_HELD):
                        held_back = [task.names[i] if i >= 0 else None for i in last.tolist()]
                        yield from task.all_spilled()
                        last = task.ids(lang, held_back)
                    last = task.add(lang, part, last)
                    if not only_hashes and task.size > task.held:
                        yield from task.spilled(task.held // 2)
        yield from task.all_spilled()
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "h long, f long" if only_hashes else RUNS)


def merged(runs: DataFrame) -> DataFrame:
    """One row for each phrase: the runs dealt by prefix range and merged there."""
    return runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("f").alias("f"))


def word_hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [word_hash(lang.encode(), w.encode())
                    for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], ["h"])
    return words.select("lang", "phrase").mapInArrow(run, "h long")


def bit_table(keys: DataFrame) -> Broadcast:
    """Bit table of the keys in column h, of bounded size."""
    spark = keys.sparkSession
    log = min(MOST_BITS, max(16, (BITS * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Bits(log, np.zeros(0, np.uint64))
        for batch in batches:
            at = np.unique(np.concatenate(table.places(batch.column(0).to_numpy().view(np.uint64)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["place", "bit"])
    rows = (keys.select("h").mapInArrow(run, "place long, bit long")
            .groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow())   # at most 2^MOST_BITS / 64 rows
    packed = np.zeros(1 << (log - 6), np.uint64)
    packed[rows["place"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(Bits(log, packed))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words with f >= least, and (lang, n)."""
    if not 2 <= longest <= 4:
        raise ValueError("phrases have 2 to 4 words")
    singles = written(counted_runs(docs, (1,), **sizes), "phrase-words")
    totals = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    often = written(merged(singles).where(F.col("f") >= least), "phrase-1")
    words = bit_table(word_hashes(often))
    hashes = counted_runs(docs, (2,), words, **sizes).groupBy("h").agg(F.sum("f").alias("f"))
    pairs = bit_table(written(hashes.where(F.col("f") >= least).select("h"), "phrase-hashes"))
    runs = written(counted_runs(docs, tuple(range(2, longest + 1)), words, pairs, **sizes), "phrase-runs")
    longer = written(merged(runs).where(F.col("f") >= least), "phrase-longer")
    return often.unionByName(longer), totals


def _stretch(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: tuple[int, int] = SHARE,
                 first: int = FIRST, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``first`` best phrases of each language."""
    counts, totals = phrase_counts(docs, longest, least, **sizes)
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = phrases.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", _stretch(F.col("words"), F.lit(1), F.col("cut")).alias("left"),
                     _stretch(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = counts.where(F.col("k") < longest)
    lefts = part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    exact = f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    scored = (cut.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
              .withColumn("score", F.expr(exact))
              .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    kept = scored
    if longest > 2:
        inner = [F.struct(_stretch(F.col("words"), F.lit(s), F.lit(m)).alias("phrase"), F.lit(m).alias("m"), F.lit(s).alias("s"))
                 for m in range(2, longest) for s in range(1, longest - m + 2)]
        longer = (phrases.where("k > 2").select("lang", "k", "a", F.explode(F.array(*inner)).alias("part"))
                  .where("part.m < k AND part.s + part.m - 1 <= k")
                  .groupBy("lang", F.col("part.phrase").alias("phrase")).agg(F.max("a").alias("most")))
        held = "CAST({} AS DECIMAL(19,0)) * CAST({} AS DECIMAL(9,0))"
        kept = (scored.join(longer, ["lang", "phrase"], "left")
                .where(f"most IS NULL OR {held.format('most', share[1])} < {held.format('a', share[0])}"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    flat = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score",
                       F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    near = flat.withColumn("own", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("own") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))
