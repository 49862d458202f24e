import itertools
import random

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows, schema="doc_id long, text string": spark.createDataFrame(rows, schema)


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_components(docs, width, percent=80):
    """doc_id -> (set size, smallest reachable id) by all pairs and label spreading."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in sets.items()}


def near_texts(seed=7):
    """Copies, near copies, short texts and rows without words."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = [None, "", " \t", "one", "one", "ONE", "one two", "Two one", "one two three"]
    for n in (3, 5, 8, 20, 60, 300):
        for _ in range(4):
            base = [r.choice(vocabulary) for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(6):
                new = list(base)
                for _ in range(r.randrange(0, max(2, n // 12))):
                    new[r.randrange(n)] = r.choice(vocabulary)
                out.append("  ".join(new))
    return list(enumerate(out))
