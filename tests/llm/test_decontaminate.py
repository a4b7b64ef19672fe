import random

import pytest

from pulsewatch.llm import decontaminate
from tests.llm.helpers import AWKWARD, frame


def brute_best(item, text, limit):
    """(distance, first end, shortest start) by the full edit matrix."""
    row = [(i, 0) for i in range(len(item) + 1)]
    best = (len(item), 0, 0) if len(item) <= limit else None
    for at, c in enumerate(text, 1):
        new = [(0, at)]
        for i, p in enumerate(item, 1):
            options = [(row[i - 1][0] + (p != c), -row[i - 1][1]), (row[i][0] + 1, -row[i][1]), (new[i - 1][0] + 1, -new[i - 1][1])]
            d, s = min(options)
            new.append((d, -s))
        row = new
        if row[-1][0] <= limit and (best is None or row[-1][0] < best[0]):
            best = (row[-1][0], at, row[-1][1])
    return best


def edited(pick, text, edits):
    out = list(text)
    for _ in range(edits):
        at = pick.randrange(len(out))
        pick.choice([lambda: out.pop(at), lambda: out.insert(at, pick.choice("abc ")), lambda: out.__setitem__(at, "z")])()
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_distance_matches_the_matrix(seed):
    pick = random.Random(seed)
    item = "".join(pick.choice("abc") for _ in range(pick.randint(1, 90)))
    text = "".join(pick.choice("abc") for _ in range(30)) + edited(pick, item, pick.randint(0, 6)) + "".join(pick.choice("abc") for _ in range(30))
    limit = pick.randint(0, 12)
    want = brute_best(item, text, limit)
    assert decontaminate.best_end(item, text, limit) == (want and want[:2])


def case(seed):
    pick = random.Random(seed)
    word = [f"{a}{b}ly" for a in ("th", "er", "in", "é") for b in ("on", "at", "es")]
    items = [(n, " ".join(pick.choice(word) for _ in range(pick.randint(4, 30)))) for n in range(12)]
    items += [(50, None), (51, ""), (52, "  "), (None, "an item without id that is found"), (53, items[0][1])]
    docs = []
    for i in range(60):
        text = " ".join(pick.choice(word) for _ in range(40))
        if i % 3 == 0:
            leak = pick.choice([t for _, t in items if t and t.strip()])
            text += " " + edited(pick, leak, pick.choice([0, 0, 1, 3, 9])).upper() + "\n" + text[:50]
        docs.append((i, text))
    return docs + AWKWARD + [(70, "x\tan item  without ID\nthat is found")], items


def brute(docs, items, rate):
    out = []
    for d, text in docs:
        for i, item in items:
            t, p = decontaminate.plain(text), decontaminate.plain(item)
            if p and t:
                best = brute_best(p, t, int(len(p) * rate))
                if best:
                    out.append((d, i, best[0], best[2], best[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,rate,most", [(1, 0.08, 1 << 20), (2, 0.15, 300)])
def test_matches_brute_force(spark, seed, rate, most):
    docs, items = case(seed)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.find_items(frame(spark, docs), bench, rate=rate, most_bytes=most)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == brute(docs, items, rate) and got
    kept = decontaminate.clean(frame(spark, docs), bench, rate=rate, most_bytes=most)
    hit = {r[0] for r in got}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in hit), key=repr)
    assert kept.columns == frame(spark, docs).columns


def test_equal_items_and_very_long_texts(spark):
    """An item a thousand times over is searched once and told of a thousand times."""
    item = "a benchmark item that many rows of the benchmark hold word for word"
    bench = spark.createDataFrame([(1, item)] * 1000 + [(2, "absent altogether")], "item_id long, text string")
    docs = [(1, "word " * 100_000 + item), (2, "clean " * 50_000)]
    found = decontaminate.find_items(frame(spark, docs), bench, most_bytes=200)
    assert found.groupBy("doc_id", "item_id", "distance").count().collect() == [(1, 1, 0, 1000)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some item")], "item_id long, text string")
    assert decontaminate.find_items(frame(spark, []).limit(0), bench).collect() == []
    assert decontaminate.find_items(frame(spark, AWKWARD), bench.limit(0)).collect() == []
    assert decontaminate.clean(frame(spark, AWKWARD), bench.limit(0)).count() == len(AWKWARD)
