import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pulsewatch.llm import trie
from pulsewatch.operators import ordered

SCHEMA = "conv_id long, turn long, role string, text string, depth long, said string"


def brute(rows):
    """The tree by making every rebuilt conversation and all of its prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * words
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], sha))
    return sorted(out, key=repr)


def check(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in trie.prefix_tree(frame, **more).collect()), key=repr)
    assert got == brute(rows)


def noisy(seed, convs=45, longest=7):
    pick = random.Random(seed)
    rows = []
    for c in range(-5, convs):
        if c % 11 == 3:
            continue
        for t in range(pick.randint(1, longest)):
            rows.append((c, t, pick.choice(["user", "assistant", None]) if pick.random() < 0.1 else "user", pick.choice(["a", "a b", "ü c d", ""])))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_prefixes(spark, seed):
    check(spark, noisy(seed))


def test_awkward_rows(spark):
    rows = noisy(7, 20)
    rows += [(None, 0, "user", "no id"), (1000, None, None, None), (1000, None, "", ""), (1000, 3, "a", "x"), (1000, 3, "a", "x")]
    rows += [(2001, 0, "user", "w " * 60_000), (2000, 0, "user", "w " * 60_000), (2000, 1, "user", "w"), (2041, 0, "u", "base is absent")]
    check(spark, rows)


def test_hot_conversation_and_hot_group(spark, monkeypatch):
    rows = [(3, t, "user", f"turn {t % 5}") for t in range(300)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(3)] + noisy(1, 20)[:30]
    monkeypatch.setattr(ordered, "GROUP_ROWS", 40)
    monkeypatch.setattr(trie, "HOT_CHILDREN", 3)
    monkeypatch.setattr(trie, "CHUNK_CHARS", 12)
    check(spark, [r for r in rows if r[0] != 3] + [r for r in rows if r[0] == 3][:300])


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    """Bases that give all turns one term must not get past the check of the stored turns."""
    real = trie.turn_terms
    tried = []

    def terms(seed):
        tried.append(seed)
        if seed == 0:
            from pyspark.sql import functions as F

            return lambda *_: F.struct(F.lit(1).cast("long").alias("t1"), F.lit(1).cast("long").alias("t2"))
        return real(seed)

    monkeypatch.setattr(trie, "turn_terms", terms)
    check(spark, noisy(2, 20))
    assert tried == [0, 1]


def test_products_by_whole_numbers():
    pick = random.Random(3)
    a, b = ([pick.randrange(trie.PRIME) for _ in range(500)] + [0, 1, trie.PRIME - 1] for _ in "ab")
    got = trie.times(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % trie.PRIME for x, y in zip(a, b)]
    base = trie.bases(0)[0]
    assert trie.powers(base, np.arange(60)).tolist() == [pow(base, k, trie.PRIME) for k in range(60)]


def test_empty_table(spark):
    assert trie.prefix_tree(spark.createDataFrame([], SCHEMA)).collect() == []
