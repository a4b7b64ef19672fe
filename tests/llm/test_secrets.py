import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pulsewatch.llm import secrets
from tests.llm.helpers import AWKWARD, frame

KEY = "AKIA" + "QX7ZP2LM9TRB4WNC"
HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
BLOB = "dGhpc0lzQVNlY3JldFZhbHVlMTIzNDU2Nzg5MA=="
TEXTS = [
    f'é password = "hunter22", then {KEY}.',
    "token=abc secret: abcdefg TOKEN:abc,api_key='x-y.z_=1' ApiKey  :  qwerty",
    "secret=token :abcdefgh",
    f"{HEX} {HEX[:23]} {HEX.upper()} {HEX}g",
    f"AKIA AKIA12 {KEY}AKIA{KEY} xAKIA{'A' * 16}",
    f"data {BLOB} und Donaudampfschifffahrtsgesellschaft 0123456789012345678901234567890",
    "ſecret=abcdefgh toKen=abcdefgh",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "Zx8" * 40_000,
]


def brute_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_base_spans_match_the_contract(spark):
    rows = list(enumerate(TEXTS)) + AWKWARD
    found = secrets.find_secrets(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for i, text in rows:
        base = brute_base(text)
        r = by_id[i]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert set(told.split(",")) <= set(r["spans"].split(",")) | {""}


@pytest.mark.parametrize("seed", range(20))
def test_high_windows_match_counting(seed):
    pick = random.Random(seed)
    text = bytes(pick.choice(b"abcdefgh"[: pick.randint(1, 8)]) for _ in range(pick.randint(5, 90)))
    for window, bits in ((5, 2.0), (8, 2.2), (4, 0.0)):
        covered = set()
        for j in range(len(text) - window + 1):
            if entropy(text[j : j + window]) >= bits - 1e-9:
                covered.update(range(j, j + window))
        got = {x for a, b in secrets.high_windows(text, window, bits) for x in range(a, b)}
        assert got == covered


def test_entropy_finds_blobs_and_leaves_prose_and_allowed_strings_alone():
    blob = f"value {BLOB} end".encode()
    assert any(k == "entropy_base64" for k, _, _ in secrets.entropy_spans(blob))
    for clean in (TEXTS[7], "Donaudampfschifffahrtsgesellschaftskapitän", "1234567890" * 5, "EXAMPLE" + BLOB[:20]):
        assert secrets.entropy_spans(clean.encode()) == []


def missed(make, before="", tries=400):
    """The share of random tokens of which no window is found."""
    pick = random.Random(11)
    lost = 0
    for _ in range(tries):
        token = make(pick)
        found = secrets.entropy_spans(f"see {before}{token} there".encode())
        begin = 4 + len(before)
        lost += not any(a < begin + len(token) and b > begin for _, a, b in found)
    return lost / tries


LETTERS = "abcdefghijklmnopqrstuvwxyz"
ANY = LETTERS + LETTERS.upper() + "0123456789"


@pytest.mark.parametrize(
    "alphabet, length, before, most",
    [
        (ANY + "+/", 40, "v1/example/", 0.03),
        (ANY + "+/", 40, "", 0.01),
        (LETTERS + "0123456789", 20, "", 0.04),
        (LETTERS + "0123456789", 32, "", 0.01),
        (ANY + "-_", 40, "", 0.01),
        (ANY, 20, "", 0.25),
    ],
)
def test_share_of_random_tokens_missed(alphabet, length, before, most):
    assert missed(lambda pick: "".join(pick.choice(alphabet) for _ in range(length)), before) <= most


def test_marked_parts_are_left_out_alone():
    key = "q7Zp2Lm9TrB4wNcX8sVd1KfG6hJ"
    for before, after in (("a/example/", ""), ("", "/EXAMPLE/x"), ("12345678/", "/abcdefgh")):
        text = (before + key + after).encode()
        spans = [(a, b) for k, a, b in secrets.entropy_spans(text) if k == "entropy_base64"]
        assert spans and all(a >= max(0, len(before) - 1) and b <= len(before) + len(key) + 1 for a, b in spans)
    assert secrets.entropy_spans(f"EXAMPLE{key}".encode()) == []


def test_redacted_documents(spark):
    rows = [(1, f"é token=abcdefg1 {HEX}!"), (2, None), (3, "plain")]
    found = secrets.redact_documents(frame(spark, rows).withColumnRenamed("block", "n_chars"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in found.collect()}
    assert got == {1: ("é [secret] [secret]!", 20), 2: (None, 7), 3: ("plain", 7)}


def test_redaction():
    assert secrets.redact(None) is None and secrets.redact("") == "" and secrets.redact("plain words") == "plain words"
    assert secrets.redact(f"é token=abcdefg1 {HEX}!") == "é [secret] [secret]!"


def test_empty_table(spark):
    assert secrets.find_secrets(frame(spark, []).limit(0)).collect() == []
