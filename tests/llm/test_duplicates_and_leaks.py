import random
import time

import numpy as np
import pytest

from roadtrace.llm import common, decontaminate, near_dedup

from .conftest import brute_components, near_texts


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_is_brute_force(frame, width):
    docs = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame([(*d, "x") for d in docs], "doc_id long, text string, set string"), width=width).collect()}
    assert got == brute_components(docs, width)


def test_near_dedup_long_lists(frame):
    """A hot group of near copies beside a chain that is linked through it."""
    r = random.Random(1)
    base = [f"v{i}" for i in range(120)]
    docs = [(i, " ".join(w if r.random() > 0.01 * (i % 12) else f"n{r.randrange(9)}" for w in base)) for i in range(60)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(frame(docs), width=2).collect()}
    assert got == brute_components(docs, 2)


def test_near_dedup_edges(frame):
    rows = near_dedup.near_duplicates(frame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "lone text"), (9, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [(5, 5, True), (5, 5, True), (9, 9, True)]
    assert sorted(((r.component_id, r.kept) for r in rows if r.doc_id is None), key=repr) == sorted([(5, False), (None, True)], key=repr)
    assert near_dedup.near_duplicates(frame([])).count() == 0


def fewest_edits(pattern, text):
    """Edit distance of pattern to the nearest piece of text, by the whole table."""
    row = np.zeros(len(text) + 1, int)
    pattern, text = list(pattern), list(text)
    for c in pattern:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j in range(1, len(row)):
            new[j] = min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def test_decontamination_is_brute_force(frame):
    r = random.Random(5)
    letters = "abcdefgh ijklmnop"
    text = lambda n: "".join(r.choice(letters) for _ in range(n)).strip()
    items = [(1, text(260)), (2, text(40)), (3, "Tiny"), (4, None), (5, text(120)), (None, text(90)), (6, " "), (7, "c++")]

    def edited(s, n):
        for _ in range(n):
            k = r.randrange(len(s))
            s = r.choice([s[:k] + s[k + 1 :], s[:k] + "z" + s[k:], s[:k] + "z" + s[k + 1 :]])
        return s

    docs = [(0, None), (1, ""), (2, text(300)), (3, "a tiny\none"), (4, "destiny, tinys"), (None, "x " + items[1][1]), (5, items[5][1]), (6, "in C++."), (7, "c")]
    for n in (0, 1, 3, 6, 9, 14, 25):
        docs += [(10 + n, text(50) + edited(items[0][1], n) + text(30)), (50 + n, edited(items[1][1], n)), (90 + n, text(5) + edited(items[4][1][:110].upper(), n))]
    got = {(h.doc_id, h.item_id) for h in decontaminate.contaminated(frame([(*d, 1) for d in docs], "doc_id long, text string, item_id long"), frame(items, "item_id long, text string")).collect()}
    # Windows, edits and word edges by plain rules.
    want = set()
    for d, t in docs:
        a = [" " if c.isspace() else c.lower() for c in t or ""]
        for i, item in items:
            w = [" " if c.isspace() else c.lower() for c in (item or "").strip()]
            if 0 < len(w) < 10:
                edge = lambda k: not 0 < k < len(a) or not (a[k - 1].isalnum() and a[k].isalnum())
                hit = any(a[k : k + len(w)] == w and edge(k) and edge(k + len(w)) for k in range(len(a) - len(w) + 1))
            else:
                size = min(100, len(w))
                hit = size > 0 and any(fewest_edits(w[k : k + size], a) <= min(int(size * 0.08), (size - 10) // 10) for k in range(len(w) - size + 1))
            if hit:
                want.add((d, i))
    assert got == want and len(want) > 12 and {(3, 3), (None, 2), (5, None), (6, 7)} <= want and not {(4, 3), (7, 7)} & want
    rows = frame([(*d, 1) for d in docs], "doc_id long, text string, x_score int")
    left = [(r.doc_id, r.text) for r in decontaminate.clean(rows, frame(items, "item_id long, text string")).collect()]
    assert sorted(left, key=repr) == sorted((d for d in docs if d[0] not in {x for x, _ in want}), key=repr)
    none = frame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(docs), none).count() == decontaminate.contaminated(frame([]), frame(items, "item_id long, text string")).count() == 0


def test_decontamination_of_excerpts_at_all_offsets():
    """Excerpts as long as a window, copied or with a few edits, and runs of words, wherever they are cut."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    item = " ".join(word() for _ in range(50))
    index = decontaminate.Index([(7, item), (8, " ".join(word() for _ in range(50)))])
    around = lambda s: " ".join(word() for _ in range(9)) + "\n" + s + "\t" + " ".join(word() for _ in range(9))
    for s in range(len(item) - 99):
        cut = item[s : s + 100]
        for text in (cut, around(cut)):
            assert [h[0] for h in index.search(text)] == [7], s
        for k in range(8, 92, 14):  # six letters are replaced
            cut = cut[:k] + "#" + cut[k + 1 :]
        for text in (cut, around(cut)):
            assert [h[0] for h in index.search(text)] == [7], s
    words = item.split()
    for s in range(len(words) - 12):
        text = around("  ".join(words[s : s + 13]).upper())
        (hit,) = index.search(text)
        assert hit[0] == 7 and text[hit[3] : hit[4]].lower().split() == words[s : s + 13] or hit[1] > 0
        assert not index.search(around(" ".join(words[s : s + 6])))


def test_repetitive_texts_in_linear_time():
    index = decontaminate.Index([(1, "ab" * 500), (2, "ab" * 300 + " and an end that is nowhere in the text")])
    began = time.perf_counter()
    found = {h[0]: h[1:3] for h in index.search("ab" * 500_000)}
    assert found[1] == (901, 0) and found[2][1] == 0 and time.perf_counter() - began < 60
    assert index.search("x" * 1_000_000) == [] and index.search("ab" * 40) == []


def test_slices_lose_no_window(monkeypatch):
    """Texts cut into many slices give what one slice gives."""
    r = random.Random(3)
    item = "".join(r.choice("abcd ") for _ in range(400))
    text = "".join(r.choice("abcd ") for _ in range(3000)) + item[:250] + "z" + item[100:] + "".join(r.choice("abcd ") for _ in range(3000))
    index = decontaminate.Index([(1, item)])
    whole = index.search(text)
    monkeypatch.setattr(decontaminate, "SHARED", 10)
    assert [h[:3] for h in index.search(text)] == [h[:3] for h in whole] and whole[0][1] == 301


def test_components_in_rounds(spark, monkeypatch):
    """Small packs force the distributed rounds; chains, stars and cycles settle on their smallest node."""
    monkeypatch.setattr(common, "PACK", 40)
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 100)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(90)]
    label = {x: x for p in links for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = common.components(common.written(spark.createDataFrame(links, "a long, b long"), "links")).collect()
    assert dict(map(tuple, got)) == {x: y for x, y in label.items() if any(x in p and p[0] != p[1] for p in links)} and len(got) == len({g[0] for g in got})


def test_near_dedup_lists_on_both_sides_of_short(frame):
    """Lists of 16 and of 17 members, the longest that pair directly and the shortest that don't."""
    r = random.Random(9)
    for n in (near_dedup.SHORT, near_dedup.SHORT + 1):
        base = [f"u{i}" for i in range(100)]
        docs = [(i, " ".join(w if r.random() > 0.012 * i else f"n{r.randrange(7)}" for w in base)) for i in range(n)]
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(frame(docs), width=2).collect()}
        assert got == brute_components(docs, 2)
