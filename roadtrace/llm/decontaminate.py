"""Benchmark decontamination by the q-gram lemma.

A benchmark item's windows start at each of its characters. A window of w characters within e edits of a piece of text shares at
least w - q + 1 - q * e of its q-grams with it, at text-minus-window offsets (diagonals) that differ by e at most. So shared
q-grams are counted in overlapping bands of diagonals, sums of them slide along the item, windows that meet the lemma's
bound are kept, and a banded alignment verifies them. Besides, a run of 13 words of an item counts, as a passage of so many
words may be shorter than a window. An item too short for q-grams counts where it stands letter by letter between word edges.

A text is searched slice by slice, cut where so many shared q-grams have been met; slices overlap by more than a window.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied, written

Q = 10
WINDOW = 100
EDITS = 0.08  # of a window's characters
RUN = 13  # words that are enough without edits, however short
ROWS = 4096  # windows that are aligned together
STRIDE = 32  # characters for which one window is aligned first
SHARED = 1_000_000  # shared q-grams that one slice of a text holds
#: Benchmark text is broadcast in parts of at most so many characters; each part is one pass over the documents.
PART = 4_000_000

_LOWER: list[np.ndarray] = []


def lowered(text: str) -> np.ndarray:
    """Code points in lower case, one for one; every white space is a space."""
    if not _LOWER:
        low = np.arange(1 << 16, dtype=np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isspace():
                low[i] = 32
            elif len(c.lower()) == 1:
                low[i] = ord(c.lower())
        _LOWER.append(low)
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(a < 1 << 16, _LOWER[0][np.minimum(a, (1 << 16) - 1)], a)


def _grams(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q characters."""
    h = np.zeros(len(a) - q + 1, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : len(a) - q + 1 + j]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Chars:
    """The characters of each window, made when asked for."""

    def __init__(self, index: Index):
        self.index = index

    def __len__(self) -> int:
        return int(self.index.starts.sum())

    def __getitem__(self, w: int) -> np.ndarray:
        if not 0 <= w < len(self):
            raise IndexError(w)
        k = int(np.searchsorted(self.index.before, w, side="right")) - 1
        s = w - int(self.index.before[k])
        return self.index.texts[k][s : s + int(self.index.size[k])]


class Index:
    """The q-grams of some items, whose windows start at every character, and their runs of words.

    Items of under q characters have no windows; they are looked up whole.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, edits: float = EDITS, run: int = RUN):
        self.q, self.run, self.items, self.texts, owner, size, grams, place = q, run, [i for i, _ in items], [], [], [], [], []
        self.words: dict[str, int] = {}
        runs, run_of = [], []
        self.short: dict[int, dict[bytes, list[int]]] = {}  # by length, the items of under q characters
        for k, (_, text) in enumerate(items):
            a = np.array([self.words.setdefault(x, len(self.words)) for x in (text or "").lower().split()], np.int64)
            if len(a) >= run:
                runs.append(_grams(a.astype(np.uint64), run))
                run_of.append(np.full(len(a) - run + 1, k))
            a = lowered(text or "")
            a = a[np.flatnonzero(a != 32)[0] : np.flatnonzero(a != 32)[-1] + 1] if (a != 32).any() else a[:0]
            w = min(window, len(a))
            self.texts.append(a)
            size.append(w)
            if 0 < len(a) < q:
                self.short.setdefault(len(a), {}).setdefault(a.astype("<u4").tobytes(), []).append(k)
            if len(a) >= q:
                grams.append(_grams(a, q))
                owner.append(np.full(len(a) - q + 1, k))
                place.append(np.arange(len(a) - q + 1))
        self.size = np.array(size, np.int64)
        long = self.size >= q
        self.starts = np.where(long, np.array([len(a) for a in self.texts], np.int64) - self.size + 1, 0)  # windows of each item
        self.before = np.cumsum(self.starts) - self.starts
        self.allowed = np.where(long, np.minimum((self.size * edits).astype(np.int64), (self.size - q) // q), 0)
        self.least = np.where(long, self.size - q + 1 - q * self.allowed, 1)
        self.band = int(self.allowed.max(initial=0)) + 1
        self.gram, (self.owner, self.place) = _sorted(grams, owner, place)
        self.keys, self.first, self.count = np.unique(self.gram, return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 23, bool)  # a first test of text q-grams
        self.bits[self.keys >> np.uint64(41)] = True
        self.overlap = int(self.size.max(initial=0)) + 4 * self.band + q
        self.run_key, (self.run_of,) = _sorted(runs, run_of)

    @property
    def chars(self) -> Chars:
        return Chars(self)

    @property
    def item(self) -> np.ndarray:
        """The item of each window."""
        return np.repeat(np.arange(len(self.items)), self.starts)

    @property
    def edits(self) -> np.ndarray:
        """The edits that each window may have."""
        return np.repeat(self.allowed, self.starts)

    def slices(self, a: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(offset, piece of a, places of q-grams in it that items have, their numbers in keys) of slices that are worth a look.

        Each piece of text of a window's length lies whole in one of them. A slice that is as one before it is left out.
        """
        if len(a) < self.q or not len(self.keys):
            return
        h = _grams(a, self.q)
        pos = np.flatnonzero(self.bits[h >> np.uint64(41)])
        at = np.searchsorted(self.keys, h[pos]).clip(max=len(self.keys) - 1)
        hit = self.keys[at] == h[pos]
        pos, at = pos[hit], at[hit]
        total = np.cumsum(self.count[at])
        first, known = 0, set()
        while first < len(pos) and len(pos) - first >= self.least.min():
            lo = int(pos[first])
            last = int(np.searchsorted(total, (total[first - 1] if first else 0) + SHARED, side="right"))
            last = max(last, int(np.searchsorted(pos, lo + 2 * self.overlap)))
            ends = last >= len(pos)
            start, stop = max(0, lo - self.overlap), len(a) if ends else int(pos[last])
            piece = a[start : min(len(a), stop + self.overlap)]
            if (name := xxhash.xxh3_128_digest(piece.tobytes())) not in known:
                known.add(name)
                yield start, piece, pos[first:last] - start, at[first:last]
            if ends:
                return
            first = int(np.searchsorted(pos, stop - self.overlap))

    def regions(self, pos: np.ndarray, at: np.ndarray, done: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, smallest diagonal of a band, places, diagonals) of bands of a slice that share enough q-grams with some of the item.

        Items that are done are left out.
        """
        n = self.count[at]
        text_pos = np.repeat(pos, n)
        which = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        if done.any():
            left = ~done[self.owner[which]]
            text_pos, which = text_pos[left], which[left]
        if not len(which):
            return
        item, place = self.owner[which], self.place[which]
        diagonal = text_pos - place
        # Bands [b * band, b * band + 2 * band): any diagonals that differ by less than band lie in one of them.
        low = diagonal // self.band
        key = np.concatenate([item * (1 << 40) + (low + (1 << 30)), item * (1 << 40) + (low - 1 + (1 << 30))])
        keys, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        enough = count >= self.least[keys >> 40]
        mine = np.flatnonzero(enough[inverse])
        mine = mine[np.argsort(inverse[mine], kind="stable")]
        for some in np.split(mine, np.cumsum(count[enough])[:-1]) if len(mine) else ():
            k = key[some[0]]
            some = some % len(item)
            if done[int(k >> 40)]:
                continue
            yield int(k >> 40), (int(k & (1 << 40) - 1) - (1 << 30)) * self.band, place[some], diagonal[some]

    def windows(self, item: int, place: np.ndarray, diagonal: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, diagonals) of the item's windows that are letter by letter in a band, and starts of others that meet the lemma's bound.

        skip: the windows that need no other place.

        Those of the first kind have all of their q-grams on one diagonal.
        """
        starts, all_of = int(self.starts[item]), int(self.size[item]) - self.q + 1

        def slid(p: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(np.bincount(p, minlength=starts + all_of - 1))])
            return sums[all_of:] - sums[:starts]

        enough = slid(place) >= self.least[item]
        if skip is not None:
            enough &= ~skip
        found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if enough.any():
            ds, n = np.unique(diagonal, return_counts=True)
            for d in ds[n >= all_of]:
                same = np.flatnonzero((slid(place[diagonal == d]) == all_of) & enough)
                enough[same] = False
                found.append(same)
                at.append(np.full(len(same), d))
        return np.concatenate(found), np.concatenate(at), np.flatnonzero(enough)

    def verified(self, a: np.ndarray, item: np.ndarray, start: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, fewest edits) of the windows, ordered by item, band and start, that lie in their bands within the edits allowed.

        A window t characters on has at most t edits fewer. So a few windows are aligned first, and spare most of the others.
        """
        edits = np.full(len(item), -1, np.int64)
        group = np.cumsum(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(low) != 0) | (np.diff(start) > STRIDE)])) - 1
        head = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        # The middle of each block of STRIDE characters.
        block = (start - start[head[group]]) // STRIDE
        ahead = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(block) != 0)]))
        until = np.append(ahead[1:], len(item))
        middle = ahead + (until - ahead) // 2
        edits[middle] = self.aligned(a, item[middle], start[middle], low[middle])
        of = np.repeat(middle, until - ahead)
        # That isn't sure where the band reaches past the text.
        first = start + low - self.band // 2
        inside = (first >= 0) & (first + 3 * self.band + 1 + self.size[item] <= len(a))
        left = np.flatnonzero((edits < 0) & ((edits[of] - np.abs(start - start[of]) <= self.allowed[item]) | ~inside[of]))
        for i in range(0, len(left), ROWS):
            some = left[i : i + ROWS]
            edits[some] = self.aligned(a, item[some], start[some], low[some])
        good = np.flatnonzero((edits >= 0) & (edits <= self.allowed[item]))
        return good, edits[good]

    def aligned(self, a: np.ndarray, item: np.ndarray, start: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Fewest edits between each window and some piece of text in its region, along the band's diagonals.

        All windows advance together, a character at a time. Cell d stands for the text after diagonal low + d, and holds its cost less d.
        """
        width, big, size = 3 * self.band + 1, np.int32(1 << 20), self.size[item]
        longest = int(size.max())
        pattern = np.full((len(item), longest), 0xFFFFFFFF, np.uint32)
        for r, (k, s, w) in enumerate(zip(item.tolist(), start.tolist(), size.tolist(), strict=True)):
            pattern[r, :w] = self.texts[k][s : s + w]
        shift = (start + low - self.band // 2)[:, None] + np.arange(width + longest)[None, :]
        text = np.concatenate([np.full(1, 0xFFFFFFFE, np.uint32), a, np.full(1, 0xFFFFFFFE, np.uint32)])[shift.clip(-1, len(a)) + 1]
        outside = (shift < 0) | (shift >= len(a))
        far = np.where(outside, big, 0).astype(np.int32) if outside.any() else None
        steps = np.arange(width, dtype=np.int32)
        cost = np.where((shift[:, :width] >= 0) & (shift[:, :width] <= len(a)), 0, big).astype(np.int32) - steps
        best, ends = np.zeros(len(item), np.int64), set(size.tolist())
        for i in range(longest):
            new = cost + (text[:, i : i + width] != pattern[:, i : i + 1])  # this character meets a text character
            if far is not None:
                np.maximum(new, far[:, i : i + width] - steps, out=new)
            np.minimum(new[:, :-1], cost[:, 1:] + 2, out=new[:, :-1])  # or none
            cost = np.minimum.accumulate(new, axis=1)  # or text characters are left out
            if i + 1 in ends:
                best[size == i + 1] = (cost + steps).min(axis=1)[size == i + 1]
        return best

    def word_runs(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of runs of words that the text has in common with an item, letter by letter but for case."""
        if not len(self.run_key):
            return
        ids = np.fromiter(map(self.words.get, text.lower().split(), itertools.repeat(-1)), np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        if len(ids) < self.run or not (at := np.flatnonzero(known[self.run :] - known[: -self.run] == self.run)).size:
            return
        h = _grams(ids.astype(np.uint64), self.run)[at]
        first, last = np.searchsorted(self.run_key, h), np.searchsorted(self.run_key, h, side="right")
        if not (last > first).any():
            return
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        for p, x, y in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
            for k in set(self.run_of[x:y].tolist()):
                yield k, spans[p][0], spans[p + self.run - 1][1]

    def whole(self, a: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the short items where they stand in text a between word edges."""
        if not self.short or not len(a):
            return
        letter = np.concatenate([[False], np.fromiter((chr(c).isalnum() for c in a.tolist()), bool, len(a)), [False]])
        for n, items in self.short.items():
            if len(a) < n:
                continue
            at = np.flatnonzero(~(letter[: len(a) - n + 1] & letter[1 : len(a) - n + 2]) & ~(letter[n : len(a) + 1] & letter[n + 1 :]))
            pieces = np.lib.stride_tricks.sliding_window_view(a, n)[at]
            names = np.ascontiguousarray(pieces, "<u4").view(f"V{4 * n}").ravel()
            for i, name in zip(at.tolist(), names.tolist()):
                for k in items.get(name, ()):
                    yield k, i, i + n

    def search(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, windows found, fewest edits, start, end) per item that text holds a window or a run of words of; code points of the text.

        Once an item has a window letter by letter, windows that have been found aren't looked for at other places.
        """
        a = lowered(text or "")
        found: dict[int, list] = {}  # item -> windows found, fewest edits, start, end
        done = np.zeros(len(self.items), bool)

        def add(k: int, starts: list[int], edits: int, begin: int, end: int) -> None:
            x = found.setdefault(k, [np.zeros(int(self.starts[k]), bool), edits, begin, end])
            x[0][starts] = True
            x[1:] = min(x[1], edits), min(x[2], begin), max(x[3], end)
            done[k] = x[1] == 0 and bool(x[0].all()) and len(x[0]) > 0

        for offset, piece, pos, at in self.slices(a):
            near = []
            for k, low, place, diagonal in self.regions(pos, at, done):
                known = found.get(k)
                same, on, left = self.windows(k, place, diagonal, known[0] if known and known[1] == 0 else None)
                if len(same):
                    add(k, same.tolist(), 0, offset + int((on + same).min()), offset + int((on + same).max() + self.size[k]))
                if len(left):
                    near.append((np.full(len(left), k), left, np.full(len(left), low)))
            if near:
                item, start, low = (np.concatenate(x) for x in zip(*near, strict=True))
                for r, e in zip(*(x.tolist() for x in self.verified(piece, item, start, low)), strict=True):
                    k, place = int(item[r]), offset + int(low[r] + start[r])
                    add(k, [int(start[r])], e, max(0, place), min(len(a), place + 2 * self.band + int(self.size[k])))
        for k, begin, end in itertools.chain(self.word_runs(text or ""), self.whole(a)):
            add(k, [], 0, begin, end)
        return [(self.items[k], int(x[0].sum()), *x[1:]) for k, x in found.items()]


def _sorted(keys: list[np.ndarray], *others: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys in order, and what goes with them."""
    if not keys:
        return np.zeros(0, np.uint64), [np.zeros(0, np.int64) for _ in others]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order], [np.concatenate(x)[order] for x in others]


HITS = "doc_id long, item_id long, n_windows int, edits int, region_start int, region_end int"


def parts(benchmark: DataFrame, text: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The distinct item texts with their SHA-256, in parts of at most PART characters; a longer text is a part by itself.

    The driver holds one part, and what goes with it by hash, at a time.
    """
    items = benchmark.where(F.length(F.trim(text)) > 0).select(F.sha2(text, 256).alias("name"), F.col(text).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = -(-total // (PART // 2))
    for p in range(dealt):
        part, size = [], 0
        for r in sorted(map(tuple, items.where(F.pmod(F.xxhash64("name"), F.lit(dealt)) == p).collect())):
            if part and size + len(r[1]) > PART:
                yield part
                part, size = [], 0
            part.append(r)
            size += len(r[1])
        if part:
            yield part


_indexes: dict[str, Index] = {}


def _index(name: str, part: list[tuple[str, str]]) -> Index:
    """One per worker process and part."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(part)
    return _indexes[name]


def _shared(spark: SparkSession, part: list[tuple[str, str]]):
    """A function that gives the part's index on a worker."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(part)
    return lambda: _index(name, sent.value)


def _found(get):
    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = get()
        for b in batches:
            hits = [(k, *h) for k, t in zip(b["k"], b["t"], strict=True) for h in index.search(t)]
            yield pd.DataFrame(hits, columns=["k", "name", "n_windows", "edits", "region_start", "region_end"])

    return run


def _holds(get):
    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = get()
        for b in batches:
            yield pd.Series([bool(index.search(t)) for t in b], dtype=bool)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """HITS: a row per document and benchmark item of which it holds a window (any 100 characters, or all of a shorter item)
    within 8 percent edits, or a run of 13 words. Case and kinds of white space don't count, nor does the amount of it
    between words of a run. n_windows counts the windows by their starts in the item; 0 if there is only a run of words, or
    an item of under 10 characters, which counts where it stands letter by letter between word edges. The region is where they lie, to within a band.

    Null and empty texts and items match nothing; null ids stay null. An empty table gives an empty result. Documents
    or items that repeat give rows each. The benchmark's distinct texts are read in parts of at most PART characters, each
    broadcast for one pass over the documents and let go, so its size isn't bound by memory.
    """
    spark, found = docs.sparkSession, []
    small_batches(spark)
    # Ids travel as text: pandas would turn whole numbers beside nulls into doubles.
    asked = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    for part in parts(benchmark):
        hits = asked.mapInPandas(_found(_shared(spark, part)), "k string, name string, n_windows int, edits int, region_start int, region_end int")
        if found:
            found[-1] = written(found[-1], "hits")
        found.append(hits)
    if not found:
        return spark.createDataFrame([], HITS)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.sha2("text", 256).alias("name"))
    every = reduce(DataFrame.union, found).join(items, "name")
    return every.select(F.col("k").cast("long").alias("doc_id"), "item_id", "n_windows", "edits", "region_start", "region_end")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no passage by the rules of contaminated(), whatever their ids and other columns.

    Each part of the benchmark is one filter; a row that one takes out doesn't reach the next.
    """
    small_batches(docs.sparkSession)
    for part in parts(benchmark):
        docs = docs.where(~F.pandas_udf(_holds(_shared(docs.sparkSession, part)), "boolean")(F.col(text)))
    return docs


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
