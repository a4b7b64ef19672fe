import random

import numpy as np
import pytest

from pulsewatch.llm import quality
from tests.llm.helpers import AWKWARD, frame

GOOD = "the quick brown fox jumps over a lazy dog while seven wizards make toxic free brews".split()
BAD = "vile rude nasty".split()


def corpus(seed, n=400):
    pick = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [pick.choice(GOOD) for _ in range(pick.randint(20, 60))]
        good, toxic = pick.random() < 0.75, pick.random() < 0.3
        if not good:
            words = [w + pick.choice(["###", "$$$", "&&&"]) for w in words]
        if toxic:
            words[pick.randrange(len(words))] = pick.choice(BAD)
            words[pick.randrange(len(words))] = pick.choice(BAD)
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = corpus(1)
    told = spark.createDataFrame(labels[:200] + [(5000, 1, 0), (None, 0, 1), (901, None, None)], LABELS)
    found = quality.classify(frame(spark, docs + AWKWARD), told)
    out = {}
    for r in found.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(docs) + len(AWKWARD)
    right = sum(out[i][0]["kept"] == bool(q and not t) for i, q, t in labels[200:])
    assert right >= 0.95 * 200
    assert len({tuple(r) for r in out[903]}) == 1
    kept = quality.reject(frame(spark, docs + AWKWARD), told)
    assert kept.columns == frame(spark, docs).columns
    assert kept.count() == sum(r["kept"] for own in out.values() for r in own)


def test_without_labels_nothing_is_rejected(spark):
    docs, labels = corpus(2, 20)
    for told in ([], [(1, 1, 0)], labels[:1] * 9):
        found = quality.classify(frame(spark, docs), spark.createDataFrame(told, LABELS)).collect()
        assert len(found) == 20 and all(r["kept"] and r["p_quality"] is None for r in found)
    assert quality.classify(frame(spark, []).limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_views_lend_each_other_rows():
    """With two labelled rows a class and views that agree, the free rows decide."""
    rng = np.random.default_rng(3)
    y = np.repeat([0.0, 1.0], 8)
    free = np.repeat([0, 1], 150)
    bag = lambda c: np.unique(rng.choice(np.arange(10) + 10 * int(c), 6))
    shapes = rng.normal(size=(16, 3)) + 4 * y[:, None]
    free_shapes = rng.normal(size=(300, 3)) + 4 * free[:, None]
    model = quality.co_train([bag(c) for c in y], shapes, y, [bag(c) for c in free], free_shapes, least_docs=1)
    test = np.repeat([0, 1], 100)
    p = model.probability([bag(c) for c in test], rng.normal(size=(200, 3)) + 4 * test[:, None])
    assert ((p >= 0.5) == test).mean() >= 0.97


@pytest.mark.parametrize("seed", range(3))
def test_fit_reaches_a_flat_gradient(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(60, 4)), (rng.random(60) < 0.4).astype(float)
    w = quality.fit(x, y, penalty=1.0)
    x1 = np.hstack([x, np.ones((60, 1))])
    slope = x1.T @ (quality.sigmoid(x1 @ w) - y) + np.r_[np.ones(4), 1e-3] * w
    assert np.abs(slope).max() < 1e-4


def test_every_unlabelled_document_lends(spark, monkeypatch):
    """The sums over the unlabelled documents cover all of them, labelled ones and null ids left out."""
    docs, labels = corpus(4, 300)
    seen = []
    plain = quality.summed
    monkeypatch.setattr(quality, "summed", lambda free, asks: seen.append(free.count()) or plain(free, asks))
    told = spark.createDataFrame(labels[:100], LABELS)
    models = quality.train(frame(spark, [*docs, (None, "a b")]), told, confident=0.5)
    assert set(seen) == {200} and all(m.joint is not None for m in models.values())


def test_sums_over_tasks_are_those_in_memory(spark):
    docs, labels = corpus(5, 300)
    told = spark.createDataFrame(labels[:100], LABELS)
    models = quality.train(frame(spark, docs).repartition(7), told)
    bags = [quality.words(t.encode()) for _, t in docs]
    seen = (("en",), ("src0",))
    shapes = np.array([quality.shape(t.encode(), "en", "src0", seen) for _, t in docs])
    assert models["quality"].seen == seen
    y = [float(q) for _, q, _ in labels[:100]]
    order = range(100)
    want = quality.co_train([bags[i] for i in order], shapes[order], [y[i] for i in order], bags[100:], shapes[100:])
    assert np.allclose(models["quality"].text, want.text, atol=1e-5) and np.allclose(models["quality"].joint, want.joint, atol=1e-4)


def test_columns_named_like_labels(spark):
    """Documents with columns `quality` and `toxic` give the same probabilities."""
    docs, labels = corpus(6, 200)
    told = spark.createDataFrame(labels[:100], LABELS)
    plain = quality.classify(frame(spark, docs), told)
    wide = frame(spark, docs).selectExpr("*", "'x' AS quality", "1.5 AS toxic", "0 AS kept", "1 AS p_quality", "2 AS _t")
    assert sorted(map(tuple, quality.classify(wide, told).collect())) == sorted(map(tuple, plain.collect()))
    kept = quality.reject(wide, told)
    assert kept.columns == wide.columns and kept.count() == plain.where("kept").count()


def test_a_repeated_id_is_one_row_of_training(spark, monkeypatch):
    docs, labels = corpus(7, 200)
    told = spark.createDataFrame(labels[:100], LABELS)
    seen = []
    plain = quality.arrays
    monkeypatch.setattr(quality, "arrays", lambda *a: seen.append(plain(*a)) or seen[-1])
    quality.train(frame(spark, docs + docs[:1] * 300 + [(docs[0][0], "another text")]), told)
    assert len(seen[0]) == 100 == len({r["doc_id"] for r in seen[0]})


def test_own_mark_of_every_seen_value():
    rows = [{"_l": "en", "_s": "good"}] * 5 + [{"_l": None, "_s": "junk"}] * 5 + [{"_l": "fr", "_s": "rare"}] * 4
    seen = quality.seen_values(rows)
    assert seen == (("", "en"), ("good", "junk"))
    assert quality.marks("en", "junk", seen) == [0, 1, 0, 0, 1, 0]
    assert quality.marks(None, "new", seen) == quality.marks("", "rare", seen) == [1, 0, 0, 0, 0, 1]
    assert len(quality.shape(b"some text", "xx", None, seen)) == len(quality.outline(b"")) + 6


def test_very_long_and_empty_texts(spark):
    docs, labels = corpus(8, 200)
    told = spark.createDataFrame(labels[:100], LABELS)
    found = quality.classify(frame(spark, docs + [(7000, "fox " * 200_000), (7001, ""), (7002, None)]), told)
    assert {r["doc_id"] for r in found.collect()} >= {7000, 7001, 7002}


def test_hashes_come_to_the_driver_as_32_bits(spark):
    texts = [(i, " ".join(f"word{i * j}" for j in range(40))) for i in range(20)]
    rows = spark.createDataFrame([(i, t, "en", "src0") for i, t in texts], "doc_id long, _t string, _l string, _s string")
    found = quality.features(rows, ["doc_id"])
    assert dict(found.dtypes)["bag"] == "array<int>"
    got = quality.arrays(found.toArrow(), ["doc_id"])
    assert [r["bag"].tolist() for r in got] == [quality.words(t.encode()).tolist() for _, t in texts]
    assert max(r["bag"].max() for r in got) >= 1 << 31


def test_words_that_tell_classes_apart():
    bags = [np.array(x, np.uint32) for x in ([1, 2, 4_000_000_000], [1, 2, 3], [], [1, 4_000_000_000], [1, 3])]
    y = np.array([1.0, 0, 1, 1, 0])
    assert quality.choose_words(bags, y, 2, 2).tolist() == [3, 4_000_000_000]
    assert quality.choose_words(bags, y, 9, 2).tolist() == [1, 2, 3, 4_000_000_000]
    assert quality.choose_words([bags[2]], y[:1], 9, 1).tolist() == []
