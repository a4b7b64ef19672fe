import math

import numpy as np
import pytest

from pulsewatch.llm import neighbours


def brute(rows, threshold):
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        v = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((name, len(near[i]), least, name is not None and name == least))
    return sorted(out, key=repr)


def vectors(seed, groups=25, dim=16):
    pick = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = pick.standard_normal(dim)
        for _ in range(int(pick.integers(1, 30))):
            rows.append((len(rows) * 7 % 1009, (base + pick.choice([0, 0.15, 0.3]) * pick.standard_normal(dim)).tolist()))
    return rows


AWKWARD = [
    (2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15),
    (2005, [float("inf")] * 16), (None, [1.0] * 16), (2006, [2.0] * 16), (2007, [1.0, 2.0]), (2008, [1.0, 2.0]), (2008, [1.0, 2.0]),
    (2009, [1e-300] * 16), (2010, [3e38] * 16),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")


@pytest.mark.parametrize("seed,k,tile", [(1, 12, 1024), (2, 4, 8)])
def test_finds_the_links_of_brute_force(spark, monkeypatch, seed, k, tile):
    monkeypatch.setattr(neighbours.tiled_links, "__defaults__", (tile,))
    monkeypatch.setattr(neighbours, "MOST_BUCKET", 64)
    rows = vectors(seed) + AWKWARD
    found = neighbours.near_duplicates(frame(spark, rows), k=k)
    got = sorted(map(tuple, found.collect()), key=repr)
    want = brute(rows, 0.95)
    assert len(got) == len(want)
    wrong = sum(a != b for a, b in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert wrong <= 0.03 * len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_no_and_one_vector(spark):
    assert neighbours.near_duplicates(frame(spark, []).limit(0)).collect() == []
    assert list(map(tuple, neighbours.near_duplicates(frame(spark, [(5, [1.0, 0.0])])).collect())) == [(5, 0, 5, True)]


def tight_groups(dim=64):
    """Two groups of 40 with cosines of 0.96 to 0.97 between them and more within, and a hot group."""
    pick = np.random.default_rng(11)
    turn = np.linalg.qr(pick.standard_normal((dim, dim)))[0]
    near = lambda base, n: [(base + 0.001 * pick.standard_normal(dim)).tolist() for _ in range(n)]
    tilt = math.acos(0.965)
    out = near(turn[0], 40) + near(math.cos(tilt) * turn[0] + math.sin(tilt) * turn[1], 40) + near(turn[2], 400)
    return list(enumerate(out + near(-turn[2], 30)))


def test_saturated_lists_reach_other_components(spark):
    rows = tight_groups()
    found = neighbours.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 0.95)


def test_pieces_and_blocks_of_pivots_reach_other_components(spark, monkeypatch):
    monkeypatch.setattr(neighbours.outer_edges, "__defaults__", (16,))
    monkeypatch.setattr(neighbours.near_pieces, "__defaults__", (8,))
    rows = tight_groups()
    found = neighbours.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 0.95)


@pytest.mark.parametrize("step", [1, 50])
def test_audit_counts_every_query_alike(spark, step):
    """A hot group found in full hides no small ones; without an id to ask others are asked."""
    pick = np.random.default_rng(5)
    rows = [np.eye(32)[0] + 0.001 * pick.standard_normal(32) for _ in range(60)]
    for axis in range(1, 31):
        rows += [np.eye(32)[axis] + 0.001 * pick.standard_normal(32) for _ in range(2)]
    units = [(r / np.linalg.norm(r)).tolist() for r in rows]
    # Ids are 50, 100, ... or none that 50 divides.
    ids = [(i + 1) * 50 + (0 if step == 50 else 1) for i in range(len(units))]
    nodes = spark.createDataFrame(
        [(i, u, 32, n, 1, n % 50 == 0) for i, (u, n) in enumerate(zip(units, ids))], "node long, unit array<double>, dim int, least long, copies long, asked boolean"
    )
    hot = [(i, (i + 1) % 60, 59) for i in range(60)]
    found = spark.createDataFrame(hot, "src long, dst long, links long")
    assert neighbours.recall(nodes, found) < 0.9


def test_audit_asks_all_rows_in_blocks(spark):
    """More queries than one block: the share is over all of them."""
    pick = np.random.default_rng(6)
    units = [v / np.linalg.norm(v) for v in pick.standard_normal((40, 32))]
    units = [u.tolist() for v in units for u in (v, (v + 1e-4) / np.linalg.norm(v + 1e-4))]
    nodes = spark.createDataFrame(
        [(i, u, 32, i * 50, 1, True) for i, u in enumerate(units)], "node long, unit array<double>, dim int, least long, copies long, asked boolean"
    )
    found = spark.createDataFrame([(i, i ^ 1, 1) for i in range(40)], "src long, dst long, links long")
    assert neighbours.recall(nodes, found, block=16) == pytest.approx(0.5)
