"""The counts of values that sets share travel as a few blobs a range, and leave the same sets as plain counting does."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from roadtrace.llm import jaccard_join as jj


@pytest.mark.parametrize("targets", [1, 3])
def test_counts_of_shared_values(monkeypatch, targets):
    monkeypatch.setattr(jj, "HELD", 300)
    r = random.Random(9)
    own = [[f"t{i}x{k}" for k in range(r.randrange(20, 60))] for i in range(60)]
    texts = [" ".join(w + own[r.randrange(60)][: r.randrange(60)]) for w in own] + [" ".join([*w[:-1], "n"]) for w in own[:20]]
    reps, sets = [7 * i + (i % 3 << 33) for i in range(len(texts))], [jj.shingles(t, 5) for t in texts]
    b = pd.DataFrame({"rep": reps, "set": [jj.digest(s) for s in sets], "text": texts})
    dealt = pd.concat(jj._dealt(5, 80, 10)(iter([b])))
    shared = [jj._shared(targets)(g) for _, g in dealt.groupby("part")]
    assert len(shared) == 10 and max(map(len, shared)) <= targets
    left = [jj._left(g) for _, g in pd.concat(shared).groupby("part")]
    keys = [{k for k in (s.view(np.uint64) >> np.uint64(64 - jj.KEY)).tolist() if k < jj._sixteenths(80) << jj.KEY - 4} for s in sets]
    often = Counter(k for s in keys for k in s)
    want = {rep for rep, s, k in zip(reps, sets, keys) if sum(often[x] > 1 for x in k) > len(k) - jj._asked(len(s), 80)}
    assert {x for f in left for x in f["rep"]} == want and sum(map(len, left)) == len(want) and 20 < len(want) < len(reps)
