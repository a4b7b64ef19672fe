import os
import random
from itertools import combinations

import numpy as np
import pytest

from pulsewatch.llm import common, pieces
from tests.llm.helpers import AWKWARD, frame, noisy

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
TEXTS = [
    "hello  world\n x   y", " a", "a\tb ﬁ é", "  hi  there ", "日本語 text 🙂 ok", "x" * 3_000, "ab" * 700 + " end",
    " " * 70, "▁", "<s> </s> <unk> <0x41>", "é‍ z\x00\x1f\r\n", "Donaudampfschifffahrt " * 50, "é" * 1_500,
]


@needs_model
def test_ids_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    pick = random.Random(1)
    letters = "aeiouthnsr  \n.,ü日0"
    texts = TEXTS + ["".join(pick.choice(letters) for _ in range(pick.randint(0, 80))) for _ in range(300)] + [t for _, t in noisy(1)]
    model = pieces.load()
    flat, sizes = pieces.Encoder(model).encode(texts)
    at = 0
    for text, n in zip(texts, sizes.tolist()):
        ids = flat[at : at + n].tolist()
        at += n
        assert ids == library.encode(text), text[:50]
        assert pieces.decode_ids(model, ids) == library.decode(ids)


@needs_model
def test_round_trip_through_spark(spark):
    rows = list(enumerate(TEXTS)) + AWKWARD
    found = pieces.encode(frame(spark, rows))
    out = found.collect()
    assert len(out) == len(rows)
    assert all(r["round_trip"] == (r["doc_id"] != 8) for r in out)
    assert all(r["n_ids"] == len(r["ids"] or []) for r in out)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(found).collect()}
    assert all(back[i] == t for i, t in rows if i != 8)
    assert pieces.encode(frame(spark, []).limit(0)).collect() == []


def every_cut(word):
    for n in range(len(word)):
        for inner in combinations(range(1, len(word)), n):
            yield [0, *inner, len(word)]


def small_model(seed, kind):
    pick = random.Random(seed)
    found = {"".join(pick.choice("abc▁") for _ in range(pick.randint(1, 4))) for _ in range(30)} | {"a", "b", "▁"}
    names = ["<unk>", *sorted(found)]
    scores = [0.0] + [round(-pick.random() * 9, 3) for _ in found]
    return pieces.Model(names, scores, [pieces.UNKNOWN] + [pieces.NORMAL] * len(found), kind)


@pytest.mark.parametrize("seed", range(10))
def test_viterbi_reaches_the_best_total(seed):
    model = small_model(seed, pieces.UNIGRAM)
    pick = random.Random(seed)
    least = min(model.scores) - pieces.UNKNOWN_PENALTY

    def score(word, cuts):
        total = 0.0
        for a, b in zip(cuts, cuts[1:]):
            i = model.by_string.get(word[a:b])
            total += model.scores[i] if i is not None else least if b - a == 1 else float("-inf")
        return total

    words = ["".join(pick.choice("abcd") for _ in range(8)) for _ in range(20)]
    for word, ids in zip(words, pieces.Words(model, words).viterbi()):
        best = max(score(word, c) for c in every_cut(word))
        assert sum(model.scores[i] if i else least for i in ids) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(10))
def test_joining_matches_one_pair_at_a_time(seed):
    model = small_model(seed, pieces.BPE)
    pick = random.Random(seed)

    def slow(word):
        parts = list(word)
        while True:
            pairs = [(-model.scores[model.by_string[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.by_string]
            if not pairs:
                return [model.by_string.get(p, 0) for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = ["".join(pick.choice("abcd") for _ in range(12)) for _ in range(40)]
    matrix = pieces.Words(model, words)
    assert matrix.joined() == [slow(w) for w in words]
    assert [matrix.spell(r, pieces.join_long(model, w)) for r, w in enumerate(words)] == [slow(w) for w in words]


@needs_model
def test_workers_get_batches_of_bounded_bytes(spark, monkeypatch):
    """Long rows come a few at a time, not 10,000 at once."""
    seen = []
    monkeypatch.setattr(pieces, "small_batches", lambda s: (common.small_batches(s, 100_000), seen.append(1)))
    docs = spark.createDataFrame([(i, "some words " * 1_000) for i in range(100)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        assert pieces.encode(docs).where("round_trip").count() == 100 and seen
        most = docs.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id long").count()
        assert most > 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_words_of_known_pieces_are_spelled_together(monkeypatch):
    """Only words with a character that has no piece are spelled one by one."""
    model, alone, spell = small_model(3, pieces.BPE), [], pieces.Words.spell
    monkeypatch.setattr(pieces.Words, "spell", lambda words, row, cuts: (alone.append(row), spell(words, row, cuts))[1])
    words = ["abab", "baab", "abda", "aaaa"]
    found = pieces.Words(model, words).joined()
    assert alone == [2]
    monkeypatch.undo()
    assert found == [pieces.Words(model, [w]).spell(0, pieces.join_long(model, w)) for w in words]


def test_units_that_come_again_are_kept(monkeypatch):
    """When the places are full, units of several batches stay and are not encoded anew."""
    monkeypatch.setattr(pieces, "MOST_CACHED", 40)
    model, pick, learned = small_model(4, pieces.BPE), random.Random(4), []
    encoder = pieces.Encoder(model)
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda units: (learned.extend(units), learn(units)))
    common = ["ab", "abc", "ca", "cab"]
    for _ in range(30):
        texts = [" ".join(common)] + ["".join(pick.choice("abcd") for _ in range(9)) for _ in range(15)] + ["", None]
        flat, sizes = encoder.encode(texts)
        fresh = pieces.Encoder(model).encode(texts)
        assert flat.tolist() == fresh[0].tolist() and sizes.tolist() == fresh[1].tolist()
        assert len(encoder.number) <= 40 + 20
    assert all(learned.count(u) == 1 for u in encoder.units(" ".join(common)))


def test_probes_find_the_places_of_binary_search(monkeypatch):
    """Also where many keys share their leading bits, for the first and last keys, and without any."""
    monkeypatch.setattr(pieces, "LEADING", 3)
    model = small_model(5, pieces.BPE)
    words = ["".join(x) for n in (1, 2, 3) for x in combinations("abcd▁" * 2, n)]
    for length in (1, 2, 3):
        own = pieces.Words(model, [w for w in words if len(w) == length])
        found = own.probe(np.arange(len(own.strings)), 0, length)
        assert [model.ids[i] for i in found] == [model.by_string.get(w, -1) for w in own.strings]
    assert 0 < model.steps < len(model.by_string)
    none = pieces.Model(["<unk>"], [0.0], [pieces.UNKNOWN], pieces.BPE)
    assert pieces.Words(none, ["ab", "b "]).joined() == [[0, 0], [0, 0]]
