import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pulsewatch.llm import files, ranking
from tests.llm.helpers import AWKWARD, frame, noisy

ITEMS = "item_id long, text string, doc_id long, terms string"


def found_terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k=10):
    held = [(i, found_terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, terms in {(i, tuple(sorted(set(found_terms(t))))) for i, t in items}:
        scored = []
        for i, t in held:
            m = 100 - 90 + (90 * len(t) * n_docs) // n_terms
            tf = Counter(t)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
                for w in terms
                if tf[w]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)


@pytest.mark.parametrize("seed, leaf, size", [(0, 1, 1 << 20), (1, 4, 600), (2, 512, 2000), (3, 2, 200)])
def test_against_scoring_everything(spark, seed, leaf, size):
    docs = noisy(seed, n=70, vocabulary=40, words=25) + AWKWARD + [(5000, "w1 " * 30_000), (5001, "ü2-W1.w3_w5" * 50)]
    docs += [(i, "w1 w3 same copy") for i in range(6000, 6030)]
    items = [(i, t) for i, t in noisy(seed + 50, n=12, vocabulary=40)] + [(90, None), (91, ""), (92, "unseen"), (None, "w1 w3"), (93, "W1 same")]
    items += [items[0], (items[0][0], "w5 copy")]
    got = ranking.rank_documents(frame(spark, docs), asked(spark, items), segment_bytes=size, leaf=leaf)
    assert rows(got) == brute(docs, items)


@pytest.mark.parametrize("seed", range(4))
def test_range_maxima(seed):
    pick = np.random.default_rng(seed)
    sizes = pick.integers(1, 40, 6)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    docs = np.concatenate([np.sort(pick.choice(50, n, replace=False)) for n in sizes])
    impacts = pick.integers(1, 6, len(docs))
    lists = ranking.Lists(np.arange(6), starts, ends, docs, impacts, 50)
    for _ in range(200):
        i = pick.integers(0, 6)
        low = pick.integers(starts[i], ends[i])
        high = pick.integers(low + 1, ends[i] + 1)
        top = lists.maxima(np.array([low]), np.array([high]))[0]
        assert top == low + impacts[low:high].argmax()


def test_bounds_save_scoring(monkeypatch):
    """With few good documents among many the search scores only some of them."""
    pick = np.random.default_rng(5)
    n = 20_000
    docs = np.concatenate([np.arange(n), np.arange(0, n, 2)])
    impacts = np.concatenate([pick.integers(1, 50, n), pick.integers(1, 50, n // 2)])
    good = pick.choice(n, 12, replace=False)
    impacts[good] += 1000
    lists = ranking.Lists(np.arange(2), np.array([0, n]), np.array([n, len(docs)]), docs, impacts, n)
    seen = []
    real = lists.maxima
    monkeypatch.setattr(lists, "maxima", lambda low, high: seen.append(1) or real(low, high))
    weights = np.array([3, 2])
    scores = np.zeros(n, np.int64)
    np.add.at(scores, docs, np.repeat(weights, [n, n // 2]) * impacts)
    want = sorted(((int(-s), d) for d, s in enumerate(scores)))[:10]
    got = ranking.search(lists, np.arange(2), weights, 10, leaf=16)
    assert [(-s, d) for s, d in got] == want
    assert len(seen) < 200
    assert ranking.search(lists, np.arange(2), weights, 10, floor=10**6) == []


def test_shared_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/t")
    for uri in (f"{tmp_path}/t", f"file:{tmp_path}/t", f"file://{tmp_path}/t"):
        assert list(files.parquet_batches(uri[:-1] + "absent", ["id"], 7)) == []
        got = [x for b in files.parquet_batches(uri, ["id"], 7) for x in b.column(0).to_pylist()]
        assert sorted(got) == list(range(100))


def test_empty_tables(spark):
    docs, items = frame(spark, noisy(1, 5)), asked(spark, [(1, "w1")])
    assert rows(ranking.rank_documents(docs.limit(0), items)) == []
    assert rows(ranking.rank_documents(docs, items.limit(0))) == []
