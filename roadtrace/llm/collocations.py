"""Phrase collocation mining: minimal perfect hashes over Apriori-safe candidates, counted in numpy arrays by slot.

1. Texts become arrays of word hashes. Words that occur often enough get slots (level 1).
2. Level by level, phrases of k words: a place is open where the phrases of k - 1 words that begin there and one word on
   are both frequent. Mappers bincount open places' keys into a table of hashed counters, whose tree-sum rules out most keys that
   can't be frequent; the distinct keys that are left are the candidates. None that is frequent can be missing.
3. A minimal perfect hash gives each candidate a slot, and the key stored at the slot tells candidates from all else. Keys are
   exact: the slot of a phrase's first k - 1 words and that of its last word.
4. Mappers look places up and bincount slots into numpy arrays, which a tree of sums adds up.
5. Counts of all beginnings and ends of a phrase, and so those of its cuts, are read by slot.

Keys are dealt into parts of about PART, each hashed by one task. Lookups take as many passes over the texts as groups of
GROUP keys are needed, and counting as many as there are groups of GROUP slots, so that no task or broadcast holds more.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, tidied, written

UPPER, BREAKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\x0a\x0b\x0c\x0d"
PLAIN = bytes.maketrans(UPPER + BREAKS + b"\t", UPPER.lower() + b"\n" * len(BREAKS) + b" ")
#: Keys of one minimal perfect hash; keys or slots that one pass holds, in eights; places of one array that tasks hand over.
PART, GROUP, SLICE = 1 << 16, 8_000_000, 1 << 16
#: Arrays that one task adds up.
FAN = 32
#: Words that one row of the state holds.
CHUNK = 1 << 19
#: Hashed counters: one for every 16 words, between these powers of two, so at most 8 MB as bits.
FEWEST_BITS, MOST_BITS = 16, 26


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1: levels of bit sets, in each of which keys that meet no other settle; a key's slot is the rank of its bit.

    find() gives -1 for what isn't a key, by the key stored at the slot.
    """

    def __init__(self, keys: np.ndarray, seed: int = 1):
        self.seed, self.sizes, words, left = seed, [], [], keys.astype(np.int64)
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = (_mix(left, seed + len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            left = left[~alone[at]]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.zeros(len(keys), np.int64)
        self.keys[self._slots(keys)] = keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (_mix(keys[todo], self.seed + level) % np.uint64(size)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            todo, base = todo[~hit], base + size // 64
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        return np.where((slots >= 0) & (self.keys[np.maximum(slots, 0)] == keys), slots, -1) if len(self.keys) else slots


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(keys, 77) % np.uint64(parts)).astype(np.int64)


class Slots:
    """Perfect hashes of some of all parts, each with the first of its slots."""

    def __init__(self, parts: int, tables: dict[int, tuple[int, PerfectHash]]):
        self.parts, self.tables = parts, tables

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, part = np.full(len(keys), -1, np.int64), _part(keys, self.parts)
        for p, (first, table) in self.tables.items():
            at = np.flatnonzero(part == p)
            found = table.find(keys[at])
            out[at] = np.where(found >= 0, found + first, -1)
        return out


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a line feed for every break between pieces and at the end."""
    raw = (text or "").encode().translate(PLAIN).replace(b"\n", b" \n ")
    return [w for w in raw.split(b" ") if w] + [b"\n"]


def _chunked(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[np.ndarray]:
    """Word hashes of the texts, CHUNK or more at a time, with 0 for a break; equal words of different languages differ."""
    known: dict[str, dict[bytes, int]] = {}
    rows, size = [], 0
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            if sum(map(len, known.values())) > 200_000:
                known.clear()
            ids = known.setdefault(lang, {b"\n": 0})
            rows.append(np.array([ids[w] if w in ids else ids.setdefault(w, word_hash(lang, w, seed)) for w in words_of(text)], np.int64))
            size += len(rows[-1])
            if size >= CHUNK:
                yield np.concatenate(rows)
                rows, size = [], 0
    if rows:
        yield np.concatenate(rows)


def word_hash(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed) - (1 << 63) or 1


@tidied
def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n) of some texts; a task holds a bounded number of words and hands counts over as often as it takes."""
    counts: dict[str, Counter] = {}

    def out() -> pd.DataFrame:
        rows = [(lang, w.decode(), n) for lang, c in counts.items() for w, n in c.items() if w != b"\n"]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > 500_000:
                yield out()
    yield out()


def _with_hash(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(key=[word_hash(x, w.encode(), seed) for x, w in zip(b["lang"], b["word"])])

    return run


def _slotted(slots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(slot=slots.value.find(b["key"].to_numpy(np.int64)))
            yield b.loc[b["slot"] >= 0, ["slot", "lang", "word", "f"]]

    return run


def _packed(a: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(a.max(initial=0)))
    return kind.char.encode() + zlib.compress(a.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), data[:1].decode()).astype(np.int64)


def _arrays(size: int, places, cap: int | None = None):
    """Iterator function: bincounts the numbers in the arrays that places(batch) gives into one array of size, handed over in slices. With cap, no count exceeds it."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.uint8 if cap else np.int64)
        for b in batches:
            for x in places(b):
                at, n = np.unique(x, return_counts=True)
                total[at] = np.minimum(total[at] + n, cap) if cap else total[at] + n
        yield handed(total)

    return run


def handed(total: np.ndarray) -> pd.DataFrame:
    rows = [(lo // SLICE, _packed(total[lo : lo + SLICE])) for lo in range(0, len(total), SLICE) if total[lo : lo + SLICE].any()]
    return pd.DataFrame(rows, columns=["slice", "counts"]).assign(task=TaskContext.get().partitionId())


def tree_summed(df: DataFrame, run, cap: int | None = None) -> DataFrame:
    """(slice, counts): the arrays of run over df, added up FAN at a time."""
    return added(df.mapInPandas(run, "slice long, counts binary, task long"), df.rdd.getNumPartitions(), cap)


def added(out: DataFrame, tasks: int, cap: int | None = None) -> DataFrame:
    def add(b: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unpacked(c) for c in b["counts"])
        return pd.DataFrame({"slice": b["slice"][:1], "counts": [_packed(np.minimum(total, cap) if cap else total)], "task": b["task"][:1] // FAN})

    while True:
        out = out.withColumn("node", F.expr(f"task div {FAN}")).groupBy("slice", "node").applyInPandas(add, "slice long, counts binary, task long")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return out.select("slice", "counts")


def _bits(sums: DataFrame, size: int, least: int) -> np.ndarray:
    """Which of size counts reach least, as packed bits: size / 8 bytes in all pass through the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"slice": b["slice"], "bits": [np.packbits(_unpacked(c) >= least).tobytes() for c in b["counts"]]})

    out = np.zeros(-(-size // 8), np.uint8)
    for r in sums.mapInPandas(run, "slice long, bits binary").toLocalIterator():
        at = r.slice * SLICE // 8
        out[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set; none is at negative ones."""
    return (at >= 0) & (bits[np.maximum(at, 0) >> 3] >> (7 - (np.maximum(at, 0) & 7)) & 1 == 1) if len(bits) else np.zeros(len(at), bool)


def _blob(a: np.ndarray) -> bytes:
    """Slots, -1 for none, in the narrowest of 2 and 4 bytes."""
    return b"h" + a.astype("<i2").tobytes() if a.max(initial=0) < 1 << 15 else b"i" + a.astype("<i4").tobytes()


def _flat(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i2" if blob[:1] == b"h" else "<i4", offset=1).astype(np.int64)


def _open(w: np.ndarray, s: np.ndarray, k: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a phrase of k words may be frequent, their keys, and the slots of the phrase without its first word."""
    good = _set(frequent, s)
    at = np.flatnonzero(good[:-1] & good[1:])
    at = at[at + k - 1 < len(w)]
    return at, s[at] << 32 | w[at + k - 1], s[at + 1]


def _places(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for w, s in zip(b["w"], b["s"]):
        yield _flat(w), _flat(s)


def _shortened(w: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The state without words that no phrase of k words covers; one place stays for each run of them, as a break."""
    cover = s >= 0
    for j in range(1, k):
        cover[j:] |= s[: max(0, len(s) - j)] >= 0
    keep = cover.copy()
    keep[1:] |= cover[:-1]
    return np.where(cover, w, -1)[keep], s[keep]


def _candidates(k: int, sent, bits: int, parts: int):
    """(part, task, data): distinct open keys whose counter doesn't rule them out, as pairs of key and suffix slot."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, counters = sent.value
        keys, sufs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_index=True)
            suf = np.concatenate(sufs)[at]
            keys[:], sufs[:] = [key], [suf]
            return key, suf

        def out() -> pd.DataFrame:
            key, suf = merged()
            keys[:], sufs[:] = [key[:0]], [suf[:0]]
            return _dealt(key, suf, parts).assign(task=TaskContext.get().partitionId())

        for b in batches:
            for w, s in _places(b):
                _, key, suf = _open(w, s, k, frequent)
                may = _set(counters, (_mix(key, 5) >> np.uint64(64 - bits)).astype(np.int64))
                keys.append(key[may])
                sufs.append(suf[may])
            if sum(map(len, keys)) > 4_000_000 and len(merged()[0]) > 2_000_000:
                yield out()
        yield out()

    return run


def _dealt(key: np.ndarray, suf: np.ndarray, parts: int) -> pd.DataFrame:
    part = _part(key, parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    both = np.stack([key, suf], axis=1)[order]
    rows = [(p, both[ends[p] : ends[p + 1]].tobytes()) for p in range(parts) if ends[p] < ends[p + 1]]
    return pd.DataFrame(rows, columns=["part", "data"])


def _pairs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, 2)


def tree_merged(out: DataFrame, tasks: int) -> DataFrame:
    """(part, data): the distinct pairs of each part, merged FAN tasks at a time."""

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([_pairs(d) for d in b["data"]])
        _, at = np.unique(both[:, 0], return_index=True)
        return pd.DataFrame({"part": b["part"][:1], "data": [both[at].tobytes()], "task": b["task"][:1] // FAN})

    while True:
        out = out.withColumn("node", F.expr(f"task div {FAN}")).groupBy("part", "node").applyInPandas(merge, "part long, data binary, task long")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return out.select("part", "data")


def _built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each part's pairs in the order of their slots."""
    for b in batches:
        both = [_pairs(d) for d in b["data"]]
        data = [x[np.argsort(PerfectHash(x[:, 0]).find(x[:, 0]))].tobytes() for x in both]
        yield pd.DataFrame({"part": b["part"], "size": [len(x) for x in both], "data": data})


def _sliced(slots: np.ndarray, lo: int, size: int) -> np.ndarray:
    return slots[(slots >= lo) & (slots < lo + size)] - lo


class Level:
    """The candidates of one length, by parts: each part's keys lie in the order of their slots."""

    def __init__(self, dealt: DataFrame, parts: int):
        """dealt: (part, data), pairs of key and one more number, distinct by key."""
        self.spark, self.parts = dealt.sparkSession, parts
        self.hashes = written(dealt.mapInPandas(_built, "part long, size long, data binary"), "hashes")
        self.groups, first, size = [{}], 0, 0
        for part, n in sorted(map(tuple, self.hashes.select("part", "size").collect())):
            if size + n > GROUP and self.groups[-1]:
                self.groups.append({})
                size = 0
            self.groups[-1][part] = first
            first, size = first + n, size + n
        self.count = first
        if self.count >= 1 << 31:
            raise ValueError("slots are 31-bit numbers")

    def sent(self, group: dict[int, int]):
        """The group's perfect hashes as a broadcast of GROUP keys at most, where a part holds less."""
        rows = self.hashes.where(F.col("part").isin(list(group))).select("part", "data").toLocalIterator()
        return self.spark.sparkContext.broadcast(Slots(self.parts, {r["part"]: (group[r["part"]], PerfectHash(_pairs(bytes(r["data"]))[:, 0])) for r in rows}))

    def listed(self, frequent: np.ndarray) -> DataFrame:
        """(slot, pre, last, suf) of the slots whose bits are set."""
        sent = self.spark.sparkContext.broadcast(({p: first for g in self.groups for p, first in g.items()}, frequent))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first, bits = sent.value
            for b in batches:
                for p, data in zip(b["part"], b["data"]):
                    both = _pairs(data)
                    slot = first[p] + np.arange(len(both))
                    own = _set(bits, slot)
                    key, suf = both[own].T
                    yield pd.DataFrame({"slot": slot[own], "pre": key >> 32, "last": key & 0xFFFFFFFF, "suf": suf})

        return self.hashes.select("part", "data").mapInPandas(run, "slot long, pre long, last long, suf long")

    def placed(self, state: DataFrame, k: int, frequent: np.ndarray) -> DataFrame:
        """state (w, s) with the slots of this level as s; each group's pass adds what it finds."""
        old = self.spark.sparkContext.broadcast(frequent)

        def run(slots, first: bool, last: bool):
            @tidied
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    rows = []
                    for i, (w, s) in enumerate(_places(b)):
                        new = np.full(len(w), -1, np.int64) if first else _flat(b["t"].iloc[i])
                        at, key, _ = _open(w, s, k, old.value)
                        new[at] = np.maximum(new[at], slots.value.find(key))
                        if last:
                            w, new = _shortened(w, new, k)
                            rows.append((_blob(w), _blob(new), None))
                        else:
                            rows.append((_blob(w), _blob(s), _blob(new)))
                    yield pd.DataFrame(rows, columns=["w", "s", "t"])

            return run

        for i, group in enumerate(self.groups):
            state = written(state.mapInPandas(run(self.sent(group), i == 0, i + 1 == len(self.groups)), "w binary, s binary, t binary"), "state")
        return state.select("w", "s")

    def read(self, docs: DataFrame, seed: int) -> DataFrame:
        """The texts' first state: each word's slot, or -1. The hashes are kept where they need several passes."""

        def looked(slots, h: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
            new = np.where(h != 0, slots.value.find(h), -1)
            return new if old is None else np.maximum(new, old)

        def texts(slots, keep: bool):
            @tidied
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for h in _chunked(batches, seed):
                    yield pd.DataFrame({"h": [h.tobytes() if keep else None], "w": [_blob(looked(slots, h))]})

            return run

        def hashes(slots):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield b.assign(w=[_blob(looked(slots, np.frombuffer(h, np.int64), _flat(w))) for h, w in zip(b["h"], b["w"])])

            return run

        schema, several = "h binary, w binary", len(self.groups) > 1
        state = written(docs.mapInPandas(texts(self.sent(self.groups[0]), several), schema), "state")
        for group in self.groups[1:]:
            state = written(state.mapInPandas(hashes(self.sent(group)), schema), "state")
        return state.select("w", F.col("w").alias("s"))

    def counts(self, state: DataFrame) -> list[tuple[int, int, DataFrame]]:
        """(first slot, slots, sums) for each GROUP of slots."""
        out = []
        for lo in range(0, self.count, GROUP):
            size = min(GROUP, self.count - lo)
            places = lambda b, lo=lo, size=size: (_sliced(_flat(s), lo, size) for s in b["s"])
            out.append((lo, size, written(tree_summed(state, _arrays(size, places)), "counts")))
        return out


def _listed(first: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, c in zip(b["slice"], b["counts"]):
                n = _unpacked(c)
                at = np.flatnonzero(n >= least)
                yield pd.DataFrame({"slot": first + s * SLICE + at, "f": n[at]})

    return run


def phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, from one word on, and (lang, n) of all words.

    Each length's table: (slot, lang, phrase, f, fl, fr): counts of its beginnings and of its ends, from one word on, f included.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = written(docs.mapInPandas(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = written(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(FEWEST_BITS, (every // 16).bit_length()))
    seed = 0
    while True:
        hashed = counted.mapInPandas(_with_hash(seed), "lang string, word string, f long, key long")
        if hashed.groupBy("key").count().where("count > 1").isEmpty():  # no word is taken for another
            break
        seed += 1
    often = written(hashed.where(F.col("f") >= least), "frequent")
    parts = max(1, -(-often.count() // PART))
    dealt = lambda batches: (_dealt(b["key"].to_numpy(np.int64), np.zeros(len(b), np.int64), parts).assign(task=TaskContext.get().partitionId()) for b in batches)
    level = Level(tree_merged(often.select("key").mapInPandas(dealt, "part long, data binary, task long"), often.rdd.getNumPartitions()), parts)
    state = level.read(docs, seed)
    slots = None
    for group in level.groups:
        rows = often.mapInPandas(_slotted(level.sent(group)), "slot long, lang string, word string, f long")
        slots = rows if slots is None else slots.union(rows)
    one = written(slots.select("slot", "lang", F.col("word").alias("phrase"), "f", F.array("f").alias("fl"), F.array("f").alias("fr")), "phrases")
    found, frequent = [one], np.full(-(-level.count // 8), 255, np.uint8)
    for k in range(2, longest + 1):
        sent = spark.sparkContext.broadcast(frequent)
        places = lambda b, k=k, sent=sent: ((_mix(_open(w, s, k, sent.value)[1], 5) >> np.uint64(64 - bits)).astype(np.int64) for w, s in _places(b))
        counters = _bits(tree_summed(state, _arrays(1 << bits, places, least), least), 1 << bits, least)
        parts = max(1, -(-int(np.bitwise_count(counters).sum()) // PART))
        keys = state.mapInPandas(_candidates(k, spark.sparkContext.broadcast((frequent, counters)), bits, parts), "part long, data binary, task long")
        level = Level(tree_merged(keys, state.rdd.getNumPartitions()), parts)
        if not level.count:
            break
        state = level.placed(state, k, frequent)
        counts = level.counts(state)
        frequent = np.concatenate([_bits(sums, size, least) for _, size, sums in counts])
        f = None
        for lo, _, sums in counts:
            rows = sums.mapInPandas(_listed(lo, least), "slot long, f long")
            f = rows if f is None else f.union(rows)
        known = level.listed(frequent).join(f, "slot")
        pre = found[-1].select(F.col("slot").alias("pre"), "lang", F.col("phrase").alias("head"), "fl")
        suf = found[-1].select(F.col("slot").alias("suf"), "fr")
        last = one.select(F.col("slot").alias("last"), F.col("phrase").alias("word"))
        known = known.join(pre, "pre").join(suf, "suf").join(last, "last")
        grown = lambda c: F.array_append(c, F.col("f")).alias(c)
        found.append(written(known.select("slot", "pre", "suf", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "f", grown("fl"), grown("fr")), "phrases"))
    return found, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of 2 to longest words of each language.

    docs: (lang, text, ...); other columns aren't looked at, and rows that repeat count as often. A null lang is `und`; null and empty texts hold no words. A phrase
    is a run of words between breaks (`.,;:!?` and line ends) that occurs least times or more. Its score is the lowest of
    1000 * a * n / (l * r), rounded down, over its cuts, the first of equal ones. A phrase goes if a longer candidate holds it
    and occurs as often. Ties go by a, then by the phrase's bytes. Without candidates the result is empty.
    """
    found, totals = phrases(docs, least, longest)
    rows = None
    for k, t in enumerate(found[1:], 2):
        if k < len(found):
            # An occurrence of a longer phrase is one of each phrase in it, so equal counts show one word further already.
            longer = found[k]
            same = longer.select(F.col("pre").alias("slot"), "f").union(longer.select("suf", "f")).distinct()
            t = t.join(same, ["slot", "f"], "left_anti")
        t = t.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
        whole = lambda c: F.col(c).cast("decimal(19,0)")
        at = F.sequence(F.lit(1), F.lit(k - 1))
        t = t.withColumn("an", (F.lit(1000).cast("decimal(4,0)") * whole("f")).cast("decimal(22,0)") * whole("n").cast("decimal(16,0)"))
        cuts = F.transform(at, lambda j: F.struct(j.alias("j"), F.col("fl")[j - 1].alias("l"), F.col("fr")[F.lit(k - 1) - j].alias("r")))
        t = t.withColumn("cuts", cuts).withColumn("cut", F.expr("array_min(transform(cuts, c -> named_struct('score', an div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0))), 'j', c.j, 'l', c.l, 'r', c.r)))"))
        t = t.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        rows = t if rows is None else rows.union(t)
    if rows is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, unnest(range(1, k)) AS j, string_split(g, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.g, c.f, j, x.f AS l, y.f AS r, n.n, 1000::HUGEINT * c.f * n.n // (x.f::HUGEINT * y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[j + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.f >= 100 * b.f AND contains(' ' || f.g || ' ', ' ' || b.g || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, g) AS rank, g AS phrase, f AS a, l, r, n, CAST(score AS BIGINT) AS score
FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, g) <= 2000
"""
