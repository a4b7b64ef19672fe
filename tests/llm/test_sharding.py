import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from pulsewatch.llm import sharding
from tests.llm.helpers import AWKWARD, frame


def brute_capacity(sizes, shards):
    """Smallest capacity of a cut of the list into at most `shards` runs, by dynamic programming."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], total[i] - total[j]) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_minimax_at_any_depth_of_prefixes(seed):
    pick = random.Random(seed)
    keys = sorted({"".join(pick.choice("ab") for _ in range(9)) for _ in range(pick.randint(1, 60))})
    size = {k: pick.randint(1, 40) for k in keys}
    shards = pick.randint(1, 9)

    def summed(length, within=None):
        out = defaultdict(lambda: [0, 0])
        for k in keys:
            if within is None or any(k.startswith(p) for p in within):
                out[k[:length]][0] += size[k]
                out[k[:length]][1] += 1
        return [(p, b, n) for p, (b, n) in sorted(out.items())]

    def refine(prefixes):
        return [x for length in {len(p) for p in prefixes} for x in summed(length + 1, [p for p in prefixes if len(p) == length])]

    capacity, starts = sharding.minimax_cuts(summed(2), shards, refine)
    assert capacity == brute_capacity([size[k] for k in keys], shards)
    filled = defaultdict(int)
    for k in keys:
        filled[sum(k >= s for s in starts)] += size[k]
    assert max(filled.values()) <= capacity and len(starts) < shards


def check(rows, found, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("prefix,slot_rows", [(1, 3), (3, 1000)])
def test_shards_hold_every_row_once(spark, prefix, slot_rows):
    pick = random.Random(5)
    rows = [(i, "x" * pick.randint(0, 60) + str(i % 50)) for i in range(200)] + [(i, "hot text " * 9) for i in range(300, 360)] + AWKWARD
    found = sharding.shard(frame(spark, rows), shards=8, first_prefix=prefix, slot_rows=slot_rows).collect()
    check(rows, found, 8)
    text = dict(rows)
    homes = defaultdict(set)
    for r in found:
        homes[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    # The hot text outgrows a fair share: it stands alone, and the rest is cut minimax.
    (hot,) = homes["hot text " * 9]
    load = defaultdict(int)
    for r in found:
        load[r["shard"]] += r["size"]
    groups = defaultdict(int)
    for i, t in rows:
        if t != "hot text " * 9:
            groups["" if t is None else sha256(t.encode()).hexdigest()] += len((t or "").encode()) + 16
    rest = [groups[k] for k in sorted(groups)]
    assert max(v for s, v in load.items() if s != hot) == brute_capacity(rest, 7)


def test_few_and_no_rows(spark):
    check([(1, "a")], sharding.shard(frame(spark, [(1, "a")])).collect(), 40)
    assert sharding.shard(frame(spark, []).limit(0)).collect() == []
