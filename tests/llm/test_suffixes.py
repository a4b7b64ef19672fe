import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pulsewatch.llm import suffixes
from tests.llm.helpers import AWKWARD, frame, noisy


def brute(rows, k):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[j : j + k] for t in texts for j in range(len(t) - k + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = {x for j in range(len(t) - k + 1) if seen[t[j : j + k]] > 1 for x in range(j, j + k)}
        kept = bytes(b for j, b in enumerate(t) if j not in gone)
        runs = sum(x - 1 not in gone for x in gone)
        out.append((i, len(t), len(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,m,hot", [(20, 6, 1000), (20, 6, 1), (9, 9, 2), (35, 8, 3)])
def test_matches_brute_force(spark, k, m, hot):
    rows = noisy(k, vocabulary=12) + AWKWARD
    got = suffixes.remove_repeats(frame(spark, rows), length=k, m=m, hot_segments=hot)
    assert sorted(((*r[:5], bytes(r[5])) for r in got.collect()), key=repr) == brute(rows, k)


def test_periodic_and_long_texts(spark):
    rows = [(1, "ab" * 3_000), (2, "x" + "ab" * 150), (3, "\0" * 250), (4, "é" * 99), (5, "q" * 200), (6, "\0" * 199)]
    got = suffixes.remove_repeats(frame(spark, rows))
    assert sorted(((*r[:5], bytes(r[5])) for r in got.collect()), key=repr) == brute(rows, 200)


def test_empty_table(spark):
    assert suffixes.remove_repeats(frame(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_merged_starts_match_counting(seed):
    pick = random.Random(seed)
    strings = list({bytes(pick.choice(b"ab\0c") for _ in range(pick.randint(3, 60))) for _ in range(pick.randint(1, 12))})
    counts = np.array([pick.choice([1, 1, 2]) for _ in strings], float)
    for length in (3, 8, 11):
        seen = Counter()
        for s, c in zip(strings, counts):
            for j in range(len(s) - length + 1):
                seen[s[j : j + length]] += c
        want = [[j for j in range(len(s) - length + 1) if seen[s[j : j + length]] > 1] for s in strings]
        got = suffixes.repeated_starts(strings, counts, length, shard_count=pick.randint(1, 5))
        assert [g.tolist() for g in got] == want
