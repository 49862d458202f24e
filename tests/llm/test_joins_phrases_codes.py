"""The n-gram join, phrase mining and vector codes against plain brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from roadtrace.llm import collocations, jaccard_join, vector_codes

from .conftest import brute_components, near_texts


def join(frame, docs, width=5, schema="doc_id long, text string"):
    return jaccard_join.similar(frame(docs, schema), width)


@pytest.mark.parametrize("width", [2, 5])
def test_join_is_brute_force(frame, width):
    docs = near_texts(11)
    rows = join(frame, [(*d, "x", 1) for d in docs], width, "doc_id long, text string, set string, rep int").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(docs, width) and len(rows) == len(docs)


def test_join_of_hot_groups(frame, monkeypatch):
    """Two groups of near copies that a chain links, with blocks of four entries, and a passage that all share."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(4)
    passage = [f"p{i}" for i in range(12)]
    docs = []
    for g in range(3):
        base = [f"g{g}v{i}" for i in range(100)]
        for _ in range(25):
            docs.append(" ".join([w if r.random() > 0.012 else f"n{r.randrange(99)}" for w in base] + passage))
    chain = [f"c{i}" for i in range(90)]
    for i in range(20):
        chain[4 * i] = f"d{i}"
        docs.append(" ".join(chain))
    docs = list(enumerate(docs))
    r.shuffle(docs)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in join(frame, docs, 5).collect()}
    want = brute_components(docs, 5)
    assert got == want and len({c for _, c in want.values()}) < len(docs) // 2


def test_join_lists_no_texts_of_their_own(frame, monkeypatch):
    """Texts that share some passages each, but differ in most words, enter no list; keys that are dealt in small chunks and ranges give the same groups."""
    made = {}

    def kept(df, name):
        made[name] = written(df, name)
        return made[name]

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    monkeypatch.setattr(jaccard_join, "HELD", 300, raising=False)
    monkeypatch.setattr(jaccard_join, "RANGE", 200, raising=False)
    docs = [(i, " ".join([f"w{i}x{k}" for k in range(60)] + [f"p{j}q{k}" for j in (i % 20, 20 + i // 3) for k in range(12)])) for i in range(60)]
    got = {x.doc_id: x.component_id for x in join(frame, docs).collect()}
    assert got == {i: i for i in range(60)} and made["lists"].count() == 0
    docs += [(100 + i, docs[i][1].replace(f"w{i}x5 ", "n ")) for i in range(0, 60, 3)] + [(200, docs[0][1])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in join(frame, docs).collect()}
    assert got == brute_components(docs, 5) and sum(c == d for d, (_, c) in got.items()) == 60


def test_derived_answers(frame):
    """Bounds from bases decide like full sets; pairs that they leave open are verified."""
    r = random.Random(6)
    sets = {i: sorted(r.sample(range(60), 40 + i % 9)) for i in range(30)}
    rows = frame(list(sets.items()), "rep long, `all` array<long>")
    near = {i: max((j for j in sets if j != i), key=lambda j: len({*sets[i]} & {*sets[j]})) for i in sets if i % 3}
    both = lambda i, j: len({*sets[i]} & {*sets[j]})
    bases = frame([(i, j, len(sets[i]) - both(i, j), len(sets[j]) - both(i, j)) for i, j in near.items()], "rep long, base long, more long, less long")
    pairs = frame([(i, len(sets[i]), j, len(sets[j])) for i in sets for j in sets if i < j], "a long, n long, b long, m long")
    got = {(x.a, x.b) for x in jaccard_join._derived(pairs, bases, lambda ids: rows.join(ids, "rep", "left_semi"), 55).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and 100 * both(i, j) >= 55 * len({*sets[i]} | {*sets[j]})} and got


def test_join_edges(frame):
    """Repeated ids, null ids, empty texts, short texts and an empty table."""
    docs = [(9, "a b"), (3, "a  B"), (4, "a b c"), (None, "a b"), (None, "q"), (7, None), (8, " \t"), (9, "k l m n o p"), (5, "k l m n o p"), (9, "a b")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join(frame, docs).collect()), key=repr)
    assert got == sorted([(9, 1, 3), (3, 1, 3), (4, 1, 4), (None, 1, 3), (None, 1, None), (7, 0, 7), (8, 0, 8), (9, 2, 3), (5, 2, 3), (9, 1, 3)], key=repr)
    assert join(frame, []).count() == join(frame, [(1, None)]).where("component_id <> 1").count() == 0


def brute_phrases(docs, least, longest, top):
    counts, total, out = Counter(), Counter(), {}
    for lang, text in docs:
        lang = lang or "und"
        for c in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").replace(c, "\n")
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {p: f for p, f in counts.items() if f >= least}
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        holds = lambda q, w=w: any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1))
        if any(q[0] == lang and len(q) - 1 > len(w) and f >= a and holds(q) for q, f in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def texts(seed, n=160):
    r = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "é", "ÉA", "a\x00b", "x", " ", "\x1c"]
    rows = [(None, None), ("und", ""), ("en", " \t\n. ,"), ("en", "x x x x x x x")]
    for _ in range(n):
        t = ""
        for _ in range(r.randrange(60)):
            t += r.choice(["new york city of", "x x x", *words]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", ":"])
        rows.append((r.choice(["en", "en", "de", None, "und"]), t))
    return rows


@pytest.mark.parametrize(("part", "group"), [(1_000_000, 8_000_000), (7, 24)])
def test_phrases_are_brute_force(frame, monkeypatch, part, group):
    """In one pass, and with small parts in many passes."""
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "GROUP", group)
    docs = texts(1)
    got = {tuple(r) for r in collocations.collocations(frame([(*d, 1) for d in docs], "lang string, text string, slot int").repartition(5), 6, 5, 40).collect()}
    want = brute_phrases(docs, 6, 5, 40)
    assert got == want and len(want) > 60


def test_phrases_without_candidates(frame):
    assert collocations.collocations(frame([], "lang string, text string")).count() == 0
    assert collocations.collocations(frame([("en", "a b c " * 30)], "lang string, text string")).count() == 0
    long = collocations.collocations(frame([(None, "ab cd " * 200_000)], "lang string, text string")).collect()
    assert [(r.phrase, r.a) for r in long][-1:] == [("ab cd ab cd ab", 199_998)] or {r.phrase: r.a for r in long}["ab cd ab cd"] == 199_999


def test_perfect_hash():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 5000):
        keys = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        h = collocations.PerfectHash(keys)
        assert sorted(h.find(keys).tolist()) == list(range(len(keys))) and (h.keys[h.find(keys)] == keys).all()
        other = np.setdiff1d(r.integers(-(2**63), 2**63 - 1, 2000), keys)
        assert (h.find(other) == -1).all()


def brute_codes(vectors, cuts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error) by plain whole numbers, and the codebooks."""
    kept = sorted(((i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda p: p[0])
    size = len(kept[0][1]) // cuts
    parts = {i: [v[p * size : (p + 1) * size] for p in range(cuts)] for i, v in kept}
    books = [[parts[i][p] for i, _ in kept[:entries]] for p in range(cuts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), c) for c, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(cuts):
            own = [[] for _ in books[p]]
            for i in parts:
                own[near(p, parts[i][p])[1]].append(parts[i][p])
            new.append([[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(own, books[p])])
        books = new
    found = {i: [near(p, x[p]) for p in range(cuts)] for i, x in parts.items()}
    return {i: ("".join(f"{c:02x}" for _, c in f), sum(d for d, _ in f)) for i, f in found.items()}


@pytest.mark.parametrize("big", [1.0, 3e5, 1e11])
def test_codes_are_brute_force(frame, big):
    """Ordinary components, such whose products pass 32 bits, and such whose errors pass 64."""
    r = random.Random(2)
    pool = [[r.gauss(0, 0.2) * big for _ in range(16)] for _ in range(40)]
    rows = [(i, r.choice(pool)[:8] + r.choice(pool)[8:], r.choice([None, 1, 2])) for i in range(3, 120)]
    rows += [(1, None, 1), (2, [None] * 16, 1), (200, [float("nan")] * 16, 1), (201, [float("-inf")] * 16, 2), (500, pool[0], 7)] + [(300 + i, pool[0], 2) for i in range(50)]
    got = vector_codes.compressed(frame([(*x, 1, 1) for x in rows], "vec_id long, embedding array<double>, label int, w int, code int").repartition(4)).collect()
    want = brute_codes([x[:2] for x in rows])
    label = {x[0]: x[2] for x in rows}
    held = lambda e: e if e < 1 << 63 else None
    assert {x.vec_id: (x.code, x.error) for x in got} == {i: (c, held(e)) for i, (c, e) in want.items()} and len(got) == len(want)
    for x in got:
        total = sum(want[i][1] for i in want if label[i] == label[x.vec_id])
        assert x.label_error == (total if total < 1 << 63 and all(held(want[i][1]) is not None for i in want if label[i] == label[x.vec_id]) else None)


def test_codes_edges(frame):
    """Few vectors, other lengths, repeated rows, null ids, huge components and an empty table."""
    schema = "vec_id long, embedding array<float>, label int"
    v = [0.5] * 8
    got = vector_codes.compressed(frame([(4, v, 1), (4, v, 1), (None, v, None), (5, [0.1] * 7, 1), (6, [3e38] * 8, 2)], schema)).collect()
    assert sorted(((x.vec_id, x.code, x.error) for x in got), key=repr) == sorted([(4, "00" * 8, 0), (4, "00" * 8, 0), (None, "00" * 8, 0), (5, None, None), (6, "02" * 8, 0)], key=repr)
    assert vector_codes.compressed(frame([], schema)).count() == 0
    assert [x.code for x in vector_codes.compressed(frame([(1, [0.1] * 7, 1), (2, [], None)], schema)).collect()] == [None, None]


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(5)
    for n in (1, 40, 900, 5000):
        s = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        for k in (0, 1, n // 9, n):
            t = np.unique(np.concatenate([s[k:], r.integers(-(2**63), 2**63 - 1, k)]))
            differ = int(np.bitwise_count((jaccard_join._parities(s) ^ jaccard_join._parities(t)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(s, t)) and (k == 0) == (differ == 0 and len(s) == len(t) and (s == t).all())
