"""SentencePiece encoding and decoding for BPE models with byte fallback.

Encoding stores, for each prefix of a text, the one token that the encoding of that prefix ends with. An automaton over
the pieces gives the tokens that end at a position; of those, the one is right that forms a valid pair with the last
token of the prefix before it. The ids are then read backwards from the end.

Fixed values of the format: U+2581 stands for the space, and byte pieces are named <0x00> to <0xFF>.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

SPACE = "▁"
#: A unit: a word up to the next space, tab or line feed, with one space before it; a run of spaces, up to that one; a tab or
#: line feed. No piece but those of spaces reaches over its edges, and spaces merge after everything else (checked on load).
UNIT = re.compile(f"[\\t\\n]|{SPACE}?[^{SPACE}\\t\\n]+|{SPACE}+(?={SPACE}[^{SPACE}\\t\\n])|{SPACE}+")
#: Longer units are encoded one by one, others many at once.
LONG = 64


class Table:
    """Non-negative int64 keys to int32 values: open addressing in arrays, so that many keys are looked up at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while left.size:
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def put(self, keys: list[int], values: list[int]) -> None:
        """Adds keys that are new and differ."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            full = self.keys >= 0
            keys, values = [*keys, *self.keys[full].tolist()], [*values, *self.values[full].tolist()]
            while len(keys) * 3 > 1 << self.bits:
                self.bits += 1
            self.__init__(self.bits)
        mask, table = len(self.keys) - 1, self.keys
        for at, k, v in zip(self._slot(np.array(keys, np.int64)).tolist(), keys, values, strict=True):
            while table[at] >= 0:
                at = at + 1 & mask
            table[at], self.values[at] = k, v
        self.n += len(keys)


class Model:
    """Tables of one .model file. Up to about twice cache_units recent units are remembered."""

    def __init__(self, path: str, cache_units: int = 40_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model needs byte fallback")
        if sp.encode("a", out_type=str) != [SPACE + "a"] and sp.encode("a", out_type=str)[0] != SPACE:
            raise ValueError("the model needs a dummy prefix")
        self.ids = {self.pieces[i]: i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]|[\t\n]", p) for p in self.ids):
            raise ValueError("a piece reaches over a unit's edge")
        self.rank = {i: -sp.get_score(i) for i in normal}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.spaces()
        # Pieces that merging never makes stay out.
        self.build([(p, i) for p, i in self.ids.items() if len(p) == 1 or self.parts(i) is not None])
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ways: dict[tuple[int, str], int] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.cache_units = cache_units
        self.head, self.tail = (array.array("I", [i]).tobytes() for i in (self.bos, self.eos))
        # What each id decodes to.
        self.out = [b""] * n
        for i in normal:
            self.out[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        self.bytes_ids = set(self.byte.values())
        self.out[self.unk] = sp.decode([self.unk]).encode()
        self.marks = {self.bos, self.eos}
        self.led = {i for i in normal if self.pieces[i].startswith(SPACE)}

    def spaces(self) -> None:
        """The last token's length of each run of spaces up to twice the longest such piece and more, from which longer runs repeat."""
        runs = [i for p, i in self.ids.items() if not p.strip(SPACE)]
        most = max(len(self.pieces[i]) for i in runs)
        if max((self.rank[i] for p, i in self.ids.items() if p.strip(SPACE)), default=0) > min(self.rank[i] for i in runs if len(self.pieces[i]) > 1 or most == 1):
            raise ValueError("spaces must merge last")
        self.last_space, self.most_spaces = [0], most
        for n in range(1, 4 * most + 1):
            symbols = self.merged([SPACE] * n)
            self.last_space.append(len(symbols[-1]))
            if n > most and symbols[0] != SPACE * most:
                raise ValueError("runs of spaces must begin with their longest piece")
        self.lone = array.array("I", [self.ids[SPACE]]).tobytes()

    def run(self, n: int) -> bytes:
        """Ids of n spaces, read backwards from the end by the last token of each prefix."""
        whole = max(0, n - 2 * self.most_spaces) // self.most_spaces
        n -= whole * self.most_spaces
        out = []
        while n:
            out.append(self.ids[SPACE * self.last_space[n]])
            n -= self.last_space[n]
        return array.array("I", [self.ids[SPACE * self.most_spaces]] * whole + out[::-1]).tobytes()

    def build(self, pieces: list[tuple[str, int]]) -> None:
        """The automaton: trie moves, fall-back states, and for each state the tokens that end there, longest first."""
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        own: dict[int, tuple[int, int]] = {}
        for p, i in pieces:
            at = 0
            for c in p:
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.ends.append(())
                at = self.moves[at][c]
            own[at] = (i, len(p))
        self.back = [0] * len(self.moves)
        level = list(self.moves[0].values())
        for at in level:
            self.ends[at] = (own[at],) if at in own else ()
        while level:
            below = []
            for at in level:
                for c, to in self.moves[at].items():
                    f = self.back[at]
                    while f and c not in self.moves[f]:
                        f = self.back[f]
                    self.back[to] = self.moves[f].get(c, 0)
                    self.ends[to] = ((own[to],) if to in own else ()) + self.ends[self.back[to]]
                    below.append(to)
            level = below
        flat = [e for ends in self.ends for e in ends]
        self.end_id, self.end_size = (np.array(x, np.int32) for x in zip(*flat, strict=True))
        self.end_from = np.concatenate([[0], np.cumsum([len(e) for e in self.ends])])
        self.steps, self.pairs = Table(), Table()  # moves through fall-back states and tests of pairs, as texts need them

    def step(self, at: int, c: str) -> int:
        while at and c not in self.moves[at]:
            at = self.back[at]
        return self.moves[at].get(c, 0)

    def moved(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        keys = at.astype(np.int64) << 21 | c
        to = self.steps.get(keys)
        if (to < 0).any():
            new = np.unique(keys[to < 0]).tolist()
            self.steps.put(new, [self.step(k >> 21, chr(k & (1 << 21) - 1)) for k in new])
            to = self.steps.get(keys)
        return to

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        ok = self.pairs.get(keys)
        if (ok < 0).any():
            if self.pairs.n > 400_000:
                self.pairs = Table()
            new = np.unique(keys[ok < 0] if self.pairs.n else keys).tolist()
            self.pairs.put(new, [int(self.fits(k >> 20, k & (1 << 20) - 1)) for k in new])
            ok = self.pairs.get(keys)
        return ok > 0

    def merged(self, symbols: list[str], stop: int = 1) -> list[str]:
        """Plain merging, best score first and leftmost of equals: makes the pieces' own trees, and short runs of spaces, on load."""
        while len(symbols) > stop:
            best, at = float("inf"), -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and self.rank[i] < best:
                    best, at = self.rank[i], k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def parts(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i; None for a character, or a piece that merging never makes."""
        if i not in self.split:
            self.split[i] = None
            p = self.pieces[i]
            if len(p) > 1 and all(c in self.chars for c in p):
                symbols = self.merged(list(p), 2)
                if len(symbols) == 2:
                    self.split[i] = (self.ids[symbols[0]], self.ids[symbols[1]])
        return self.split[i]

    def spine(self, i: int, right: bool) -> list[tuple[int, float]]:
        """Tokens on the right (or left) edge of token i's tree from the leaf up, each with the rank that ends it."""
        found = self.spines.get((i, right))
        if found is None:
            chain = [i]
            while (two := self.parts(chain[-1])) is not None:
                chain.append(two[1] if right else two[0])
            chain.reverse()
            found = self.spines[i, right] = [(t, self.rank[chain[k + 1]] if k + 1 < len(chain) else float("inf")) for k, t in enumerate(chain)]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text leaves exactly these two: no merge across the edge comes first."""
        a, b = self.spine(left, True), self.spine(right, False)
        x = y = 0
        while True:
            (t, until), (u, till) = a[x], b[y]
            m = self.ids.get(self.pieces[t] + self.pieces[u])
            if m is not None:
                r = self.rank[m]
                if r < until and r <= till:
                    return False
            if until == float("inf") and till == float("inf"):
                return True
            if until <= till:
                x += 1
            else:
                y += 1

    def words(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word by its prefixes' last tokens, all words a character at a time; None where the model lacks one."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        sizes = np.array([len(words[k]) for k in order])
        codes = np.frombuffer("".join([words[k] for k in order]).encode("utf-32-le"), "<u4").astype(np.int64)
        start = np.cumsum(sizes) - sizes
        n, longest = len(words), int(sizes[0])
        last, size = np.full((longest + 1, n), -1, np.int32), np.zeros((longest + 1, n), np.int32)
        at = np.zeros(n, np.int32)
        for end in range(1, longest + 1):
            live = int(np.searchsorted(-sizes, -end, "right"))
            at = self.moved(at[:live], codes[start[:live] + end - 1])
            first, rest = self.end_from[at], self.end_from[at + 1] - self.end_from[at]
            open_, k = np.flatnonzero(rest), 0
            while open_.size:
                i, length = self.end_id[first[open_] + k], self.end_size[first[open_] + k]
                p = last[end - length, open_]
                ok = length == end
                test = np.flatnonzero(p >= 0)
                ok[test] = self.fit(p[test], i[test])
                last[end, open_[ok]], size[end, open_[ok]] = i[ok], length[ok]
                k += 1
                open_ = open_[~ok]
                open_ = open_[rest[open_] > k]
        # Backwards from the ends.
        bad, pos, back, rows = np.zeros(n, bool), sizes.copy(), [], np.arange(n)
        while rows.size:
            i = last[pos[rows], rows]
            bad[rows[i < 0]] = True
            rows, i = rows[i >= 0], i[i >= 0]
            back.append((rows, i))
            pos[rows] -= size[pos[rows], rows]
            rows = rows[pos[rows] > 0]
        count = np.zeros(n, np.int64)
        for r, _ in back:
            count[r] += 1
        stop = np.cumsum(count)
        flat = np.empty(int(stop[-1]), "<u4")
        for k, (r, i) in enumerate(back):
            flat[stop[r] - 1 - k] = i
        raw, out = flat.tobytes(), [None] * n
        for k, b, lo, hi in zip(order, bad.tolist(), ((stop - count) * 4).tolist(), (stop * 4).tolist(), strict=True):
            if not b:
                out[k] = raw[lo:hi]
        return out

    def long(self, s: str) -> bytes:
        """Ids of one long word of characters that the model has, by the same table, a character at a time."""
        last, size, at = [-1] * (len(s) + 1), [0] * (len(s) + 1), 0
        if len(self.ways) > 300_000 or len(self.fitting) > 300_000:
            self.ways, self.fitting = {}, {}
        ways, fitting, ends = self.ways, self.fitting, self.ends
        for end, c in enumerate(s, 1):
            to = ways.get((at, c))
            if to is None:
                to = ways[at, c] = self.step(at, c)
            at = to
            for i, length in ends[at]:
                if length < end:
                    p = last[end - length]
                    ok = fitting.get((p, i))
                    if ok is None:
                        ok = fitting[p, i] = p >= 0 and self.fits(p, i)
                    if not ok:
                        continue
                last[end], size[end] = i, length
                break
        out, end = [], len(s)
        while end:
            out.append(last[end])
            end -= size[end]
        return array.array("I", out[::-1]).tobytes()

    def unit(self, s: str) -> bytes:
        """Ids of any unit. Characters that the model lacks become their bytes."""
        if not s.strip(SPACE):
            return self.run(len(s))
        parts = []
        for known, group in itertools.groupby(s, self.chars.__contains__):
            run = "".join(group)
            parts.append(self.long(run) if known else array.array("I", map(self.byte.__getitem__, run.encode())).tobytes())
        return b"".join(parts)

    def learn(self, units: set[str]) -> None:
        """Remembers the ids of units."""
        plain = [u for u in units if len(u) <= LONG and u.strip(SPACE)]
        if plain:
            self.young.update((u, ids) for u, ids in zip(plain, self.words(plain), strict=True) if ids is not None)
        self.young.update((u, self.unit(u)) for u in units if u not in self.young)

    def joined(self, units: list[str]) -> bytes:
        """Ids of a text's units. A run of spaces takes in the space before the next word where that merges with nothing else."""
        parts = [*map(self.young.__getitem__, units)]
        for k, u in enumerate(units[:-1]):
            if u[-1] == SPACE and units[k + 1][0] == SPACE and parts[k + 1].startswith(self.lone):
                parts[k], parts[k + 1] = self.run(len(u) + 1), parts[k + 1][4:]
        return b"".join([self.head, *parts, self.tail])

    def encode_all(self, texts: list[str | None], chars: int = 500_000) -> Iterator[bytes]:
        """encode() for many texts, some chars' worth at a time."""
        k = 0
        while k < len(texts):
            group, n = [], 0
            while k < len(texts) and (not group or n < chars):
                group.append(UNIT.findall(SPACE + texts[k].replace(" ", SPACE)) if texts[k] else [])
                n += len(texts[k] or "")
                k += 1
            units = set().union(*group)
            if len(self.young) > self.cache_units:
                self.young, self.old = {}, self.young
            young, old = self.young, self.old
            new = units - young.keys()
            if old:
                again = new & old.keys()
                young.update((u, old[u]) for u in again)
                new -= again
            self.learn(new)
            for g in group:
                yield self.joined(g)
            for u in new:
                if len(u) > LONG:
                    del young[u]

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers; null and empty texts have just those two."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """Text of ids: begin, end and the first piece's space go; bytes that are no UTF-8 become U+FFFD, one for each."""
        a = array.array("I", ids)
        raw = b"".join(map(self.out.__getitem__, a))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(_utf8(b"".join(map(self.out.__getitem__, g))) for _, g in itertools.groupby(a, self.bytes_ids.__contains__))
        first = next((i for i in a if self.out[i] or i not in self.marks), self.bos)
        return text[1:] if first in self.led else text


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(raw):
        for n in (4, 3, 2, 1):
            try:
                out.append(raw[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One per worker process."""
    return Model(path)


def tokenize(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids `ids` (array<int>) and `decoded`.

    A null text counts as empty: its ids are begin and end, and it decodes to the empty text. Rows may repeat.
    path: the .model file; each executor needs it at that place.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            rows = []
            for ids in m.encode_all(b["t"].tolist()):
                back = m.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").astype("i4"), back) if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", b["k"].array)
            yield out
        m.young, m.old = {}, {}

    # Ids travel as text: pandas would turn whole numbers beside nulls into doubles.
    out = docs.select(F.col(key).cast("long").cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), default_model(), with_ids=False)
