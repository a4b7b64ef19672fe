"""Small document tables with the awkward rows every operator has to take."""

import random

AWKWARD = [
    (900, None),
    (901, ""),
    (None, "a row without an id a row without an id"),
    (902, " \t\n "),
    (903, "one"),
    (903, "one"),
]


def frame(spark, rows):
    """Documents with further columns whose names operators like to use themselves."""
    wide = [(i, t, "en", "src0", 7, "x") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, block long, n string"
    return spark.createDataFrame(wide, schema)


def noisy(seed, n=40, vocabulary=6, words=30, shared=3):
    """Random texts over few words, with shared passages, copies and near copies."""
    pick = random.Random(seed)
    word = [f"w{i}" if i % 2 else f"ü{i}" for i in range(vocabulary)]
    passages = [[pick.choice(word) for _ in range(12)] for _ in range(shared)]
    out = []
    for i in range(n):
        text = [pick.choice(word) for _ in range(pick.randint(0, words))]
        if i % 3 == 0:
            at = pick.randint(0, len(text))
            text[at:at] = pick.choice(passages)
        if i % 7 == 6:
            text = out[-1][1].split()
            if text and i % 2:
                text[pick.randrange(len(text))] = "changed"
        out.append((i, pick.choice([" ", "  ", "\n"]).join(text)))
    return out
