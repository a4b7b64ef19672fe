import random

import pytest

from pulsewatch.llm import chats


def brute(rows, part_turns):
    talks = {}
    first = lambda x: (x is not None, x if x is not None else 0)
    for c, t, r, x in sorted(rows, key=lambda v: (first(v[1]), (v[2] is not None, v[2] or ""), (v[3] is not None, v[3] or ""))):
        talks.setdefault(c, []).append((r, x))
    out = []
    for c, turns in talks.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in talks.values()):
            continue
        same = [d for d, o in talks.items() if o == turns]
        if min(same, key=lambda d: (d is None, d or 0)) != c:
            continue
        for p in range(0, len(turns), part_turns):
            text = "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in turns[p : p + part_turns])
            out.append((c, p // part_turns, len(turns), len(same), text))
    return sorted(out, key=repr)


def talks(seed):
    pick = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(pick.randint(1, 5)):
            rows.append((c, t, pick.choice(["user", "user", None]), pick.choice(["a", "a", "a", "b", None, ""])))
    rows += [(None, 0, "user", "a"), (None, 1, None, "z"), (70, None, "user", "a"), (70, 3, "user", "a"), (70, 3, "user", "a")]
    rows += [(71, t, "user", f"long {t}") for t in range(40)] + [(72, t, "user", f"long {t}") for t in range(20)] + [(73, 5, "user", "x" * 100_000)]
    return rows


@pytest.mark.parametrize("seed,part", [(1, 256), (2, 3)])
def test_matches_brute_force(spark, seed, part):
    rows = talks(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos long, part string")
    found = chats.collapse(frame, part_turns=part)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, part)


def test_a_conversation_over_the_limit_is_cut(spark, monkeypatch):
    monkeypatch.setattr("pulsewatch.operators.ordered.GROUP_ROWS", 10)
    rows = talks(3)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chats.collapse(frame, part_turns=7)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 7)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chats.collapse(frame).collect() == []
