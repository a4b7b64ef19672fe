"""Secrets in texts: patterns, and high entropy in sliding windows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsewatch.llm.common import read, sha256

# Fixed values of the contract: the base patterns and the least lengths of their matches.
ASSIGN = rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
ASSIGN_VALUE = 6
ACCESS_LENGTH = 20
HEX_LENGTH = 24

KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
#: Character class -> (its characters, least bits a character in some window).
CLASSES = {
    "entropy_hex": (rb"[0-9a-fA-F]", 3.0),
    "entropy_base64": (rb"[A-Za-z0-9+/=]", 3.9),
    "entropy_lower": (rb"[a-z0-9]", 3.4),
    "entropy_token": (rb"[A-Za-z0-9_-]", 3.9),
}
#: Spans that are no secrets: no digit or no letter in them.
ALLOWED = (rb"[^0-9]+", rb"[^A-Za-z]+")
#: Parts of a run, between slashes, that are no secrets: counting rows of characters and marked
#: examples. What stands before and behind them is judged on its own.
MARKED = rb"(?i)(?:^|/)[^/]*(?:example|abcdefgh|01234567|12345678)[^/]*"


BASE_PATTERNS = (
    re.compile(ASSIGN, re.IGNORECASE),
    re.compile(ACCESS.replace(b"+", b"{%d,}" % (ACCESS_LENGTH - 4))),
    re.compile(HEX.replace(b"+", b"{%d,}" % HEX_LENGTH)),
)


def base_spans(text):
    """(kind, start, end) in bytes. A run of one character class is matched whole or not at
    all, so a least length in its pattern drops just the runs that are too short."""
    assign, access, hexes = BASE_PATTERNS
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in access.finditer(text)]
    out += [("hex", *m.span()) for m in hexes.finditer(text)]
    return out


def high_windows(candidate, window, bits):
    """Spans covered by windows with at least `bits` of Shannon entropy a character.

    With counts c, the entropy is log2(window) - sum(c log2 c) / window; moving a window by
    one changes two counts, and so two terms of the sum.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts = Counter(candidate[:window])
    total = sum(term[c] for c in counts.values())
    most = (math.log2(window) - bits) * window + 1e-9
    out = []
    for start in range(len(candidate) - window + 1):
        if start:
            gone, new = candidate[start - 1], candidate[start + window - 1]
            if gone != new:
                total -= term[counts[gone]] + term[counts[new]]
                counts[gone] -= 1
                counts[new] += 1
                total += term[counts[gone]] + term[counts[new]]
        if total <= most:
            if out and out[-1][1] >= start:
                out[-1][1] = start + window
            else:
                out.append([start, start + window])
    return out


def unmarked(run, marked):
    """(start, end) of the stretches of a run that hold no marked part."""
    at = 0
    for m in re.finditer(marked, run):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(run):
        yield at, len(run)


def entropy_spans(text, window=WINDOW, classes=None, allowed=ALLOWED, marked=MARKED):
    out = []
    for kind, (chars, bits) in (CLASSES if classes is None else classes).items():
        # The window of one class lies within a run of that class.
        for m in re.finditer(rb"%s{%d,}" % (chars, window), text):
            for low, high in unmarked(m[0], marked):
                for a, b in high_windows(m[0][low:high], window, bits):
                    part = m[0][low + a : low + b]
                    if not any(re.fullmatch(f, part, re.DOTALL) for f in allowed):
                        out.append((kind, m.start() + low + a, m.start() + low + b))
    return out


def in_code_points(text, found):
    """The same spans counted in characters."""
    if not found or text.isascii():
        return found
    raw = np.frombuffer(text, np.uint8)
    later = np.r_[0, np.cumsum((raw & 0xC0) == 0x80)]
    return [(k, a - int(later[a]), b - int(later[b])) for k, a, b in found]


def written(found, kinds):
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], order[x[0]], x[2])))


def scan(text, window=WINDOW, classes=None, allowed=ALLOWED, marked=MARKED):
    """Base spans and added spans of a UTF-8 text, in characters."""
    base = base_spans(text)
    added = entropy_spans(text, window, classes, allowed, marked)
    found = in_code_points(text, base + added)
    return found[: len(base)], found[len(base) :]


def find_secrets(docs, window=WINDOW, classes=None, allowed=ALLOWED, marked=MARKED, id_col="doc_id", text_col="text"):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Base spans are the contract's patterns over the whole text. Added spans are parts of runs of
    one character class that windows of `window` characters with enough entropy cover; windows
    do not reach into parts that `marked` finds, and spans that match an allowed pattern go. Spans are kind:start:end in code points, in order
    of start and kind. Null and empty texts have none; equal rows give equal rows, null ids
    are kept, further columns are ignored, and an empty table gives an empty result.
    """
    classes = dict(CLASSES if classes is None else classes)
    kinds = [*BASE_KINDS, *classes]

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, added = scan((text or "").encode(), window, classes, allowed, marked)
                n = Counter(k for k, _, _ in base)
                out.append((doc, *(n[k] for k in BASE_KINDS), sha256(written(base, kinds).encode()), written(base + added, kinds)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, [pa.int64()] * 4 + [pa.string()] * 2)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema)


def redact(text, mark="[secret]"):
    """The text with every found span replaced by a mark; None stays None."""
    if text is None:
        return None
    base, added = scan(text.encode())
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in base + added):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact_documents(docs, text_col="text", chars_col="n_chars", mark="[secret]"):
    """All rows and columns of `docs`, found secrets replaced by a mark; where a text changed and there
    is a column `n_chars`, it counts the new one. Null texts stay null; an empty table stays empty."""
    text_at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in batches:
            old = batch.column(text_at).to_pylist()
            new = [redact(t, mark) for t in old]
            columns = list(batch.columns)
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if chars_at is not None:
                chars = batch.column(chars_at).to_pylist()
                counted = [c if a == b else len(b) for c, a, b in zip(chars, old, new)]
                columns[chars_at] = pa.array(counted, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark, sf_dir):
    return find_secrets(read(spark, sf_dir, "documents"))
