import hashlib
from collections import Counter

import pytest

from pulsewatch.llm import substrings
from tests.llm.helpers import AWKWARD, frame, noisy


def brute(rows, k):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[j : j + k]) for w in words for j in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {x for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for x in range(j, j + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,m,hot", [(5, 2, 1000), (5, 2, 1), (8, 3, 4), (3, 3, 2)])
def test_matches_brute_force(spark, k, m, hot):
    rows = noisy(k) + AWKWARD
    got = substrings.remove_repeats(frame(spark, rows), k=k, m=m, hot_segments=hot)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k)


def test_long_and_periodic_texts(spark):
    rows = [(1, "a " * 50_000), (2, "b " + "a b " * 40), (3, "x " * 34), (4, "y " * 35)]
    got = substrings.remove_repeats(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 35)


def test_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, []).limit(0)).collect() == []
