import random

import pytest

from pulsewatch.llm import jaccard
from tests.llm.helpers import AWKWARD, frame


def brute(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc, len(near[i])))
    return sorted(out, key=repr)


def families(seed, words=60, groups=12, most=9):
    """Groups of texts that differ in a few words, over a vocabulary with frequent phrases."""
    pick = random.Random(seed)
    word = [f"w{i}" for i in range(40)]
    phrase = "the common phrase of many texts here".split()
    rows = []
    for _ in range(groups):
        base = [pick.choice(word) for _ in range(pick.randint(1, words))]
        if pick.random() < 0.5:
            at = pick.randint(0, len(base))
            base[at:at] = phrase
        for _ in range(pick.randint(1, most)):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
                copy[pick.randrange(len(copy))] = pick.choice(word)
            rows.append((len(rows) * 3 % 101 * 1000 + len(rows), " ".join(copy).title()))
    return rows


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=repr)


@pytest.mark.parametrize(
    "seed,width,num,den,frequent,tile,small",
    [(1, 3, 90, 100, 64, 512, 64), (2, 3, 90, 100, 2, 4, 3), (3, 2, 80, 100, 3, 5, 2), (4, 5, 80, 100, 1, 512, 2), (5, 1, 75, 100, 4, 3, 5)],
)
def test_matches_brute_force(spark, monkeypatch, seed, width, num, den, frequent, tile, small):
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 7)
    rows = families(seed) + AWKWARD + [(905, "A B"), (904, "a b"), (906, "a b a")]
    found = jaccard.jaccard_join(frame(spark, rows), width=width, num=num, den=den, frequent=frequent, tile=tile, small=small)
    assert got(found) == brute(rows, width, num, den)


def test_one_large_family_is_cut_into_tiles(spark):
    rows = families(7, words=50, groups=2, most=60) + families(8, words=90, groups=1, most=40)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = jaccard.jaccard_join(frame(spark, rows), width=3, num=90, den=100, frequent=5, tile=8)
    assert got(found) == brute(rows, 3, 90, 100)


def test_empty_table(spark):
    assert jaccard.jaccard_join(frame(spark, []).limit(0)).collect() == []


def test_one_row_of_each_component_stays(spark):
    rows = families(9) + AWKWARD + [(905, "a b"), (905, "a b"), (904, "a b"), (3, "x y z"), (3, "x y z"), (None, "p q"), (None, "p q")]
    docs = frame(spark, rows)
    kept = jaccard.keep_one(docs, width=3, num=90, den=100)
    assert kept.columns == docs.columns
    found = jaccard.jaccard_join(docs, width=3, num=90, den=100)
    components = found.where("component is not null").select("component").distinct().count()
    blank = sum(not (t or "").split() for _, t in rows)
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(out) == components + blank
    again = jaccard.jaccard_join(kept, width=3, num=90, den=100).agg({"n_links": "sum"}).first()[0]
    assert again == 0 and set(out) <= set(rows)


def paragraphs(n, seed=1):
    """Texts of four paragraphs out of a pool that grows with them: much is shared and nothing links."""
    pick = random.Random(seed)
    pool = [" ".join(f"p{i}w{pick.randrange(10**6)}" for _ in range(25)) for i in range(n // 4)]
    return [(i, " ".join(pick.sample(pool, 4))) for i in range(n)]


def test_shared_paragraphs_do_not_bring_everything_together(spark, monkeypatch):
    """Compared pairs and shipped sets grow with the texts, not with the square of what hangs together."""
    seen = {}
    plain = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, label: seen.__setitem__(label, plain(df, label)) or seen[label])
    sizes = []
    for n in (400, 1600):
        found = jaccard.jaccard_join(frame(spark, paragraphs(n)), width=3, num=90, den=100)
        assert found.agg({"n_links": "sum"}).first()[0] == 0
        sizes.append([seen[k].count() for k in ("pairs", "members")])
    assert sizes[1][0] <= 6 * max(1, sizes[0][0]) and sizes[1][1] <= 6 * max(1, sizes[0][1])


def test_own_names_of_columns(spark):
    docs = frame(spark, families(9)).selectExpr("*", "7 AS _key", "8 AS _id", "9 AS _once", "1 AS component")
    kept = jaccard.keep_one(docs, width=3, num=90, den=100)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.select("_key", "_id", "_once", "component").collect()} == {(7, 8, 9, 1)}


def test_very_long_texts(spark):
    pick = random.Random(4)
    long = " ".join(f"w{pick.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "short"), (4, long[: len(long) // 2])]
    found = jaccard.jaccard_join(frame(spark, rows), width=3, num=90, den=100)
    assert got(found) == brute(rows, 3, 90, 100)


def test_no_plan_is_large(spark, monkeypatch):
    """The driver holds a plan with all versions it takes on; one of 187 lines took it past its memory."""
    lines, plain = {}, jaccard.stored

    def stored(df, label):
        lines[label] = max(lines.get(label, 0), len(df._jdf.queryExecution().executedPlan().toString().splitlines()))
        return plain(df, label)

    monkeypatch.setattr(jaccard, "stored", stored)
    jaccard.keep_one(frame(spark, families(3) + AWKWARD))
    assert {"near", "mixed", "across", "judged"} <= lines.keys() and max(lines.values()) <= 80, lines


def test_sets_in_many_pairs_are_copied(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 2)
    sets = [(f"s{i}", list(range(i % 3, 20))) for i in range(9)]
    pairs = [(a, b) for a, _ in sets[:3] for b, _ in sets] + [("s8", "s0"), ("s7", "s8")]
    found = jaccard.verified(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(sets, "digest string, shingles array<long>"), 95, 100)
    of = {n: set(x) for n, x in sets}
    want = [(a, b) for a, b in pairs if 100 * len(of[a] & of[b]) >= 95 * len(of[a] | of[b])]
    assert sorted(map(tuple, found.collect())) == sorted(want)
