"""Substring removal by words: windows of 35 words that occur twice (super-k-mers)."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pulsewatch.llm.common import mixed, read, sha256
from pulsewatch.llm.superkmers import BASE, HOT_SEGMENTS, INVERSE, powers, repeated

WINDOW = 35
MINIMISER = 5


@dataclass
class Tokens:
    data: bytes
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    lengths: list


@dataclass
class Words:
    """Words between ASCII white space; segments travel as words joined by one space."""

    k: int = WINDOW
    m: int = MINIMISER
    hot_segments: int = HOT_SEGMENTS
    texts: bool = False
    fingerprints_first: bool = False

    def tokens(self, texts):
        split = [t.split() for t in texts]
        lengths = [len(w) for w in split]
        data = b" ".join([b" ".join(w) for w in split if w])
        raw = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        words = sum(lengths)
        begin = np.r_[0, gaps + 1][:words].astype(np.int64)
        end = np.r_[gaps, len(raw)][:words].astype(np.int64)
        hashes = np.zeros(words, np.uint64)
        step = 1 << 20  # bytes for which powers are kept
        at = 0
        while at < words:
            low = begin[at]
            to = max(at + 1, int(np.searchsorted(end, low + step, "right")))
            part = raw[low : end[to - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
            b, e = begin[at:to] - low, end[at:to] - low
            hashes[at:to] = mixed((sums[e] - sums[b]) * powers(INVERSE, len(part))[b])
            at = to
        return Tokens(data, hashes, begin, end, lengths)

    def windows(self, string):
        return string.count(b" ") + 2 - self.k

    def repeats(self, groups):
        """For each string of each group, the spans of windows that occur more than once.

        All windows of a group are sorted; equal neighbours are repeats.
        """
        for group in groups:
            rows = []
            for i, (string, count) in enumerate(group):
                raw = np.frombuffer(string, np.uint8)
                gaps = np.flatnonzero(raw == 32)
                begin, end = np.r_[0, gaps + 1].tolist(), np.r_[gaps, len(raw)].tolist()
                for j in range(len(begin) - self.k + 1):
                    rows.append((string[begin[j] : end[j + self.k - 1]], i, j, count))
            rows.sort()
            hits = [[] for _ in group]
            at = 0
            while at < len(rows):
                to, total = at, 0
                while to < len(rows) and rows[to][0] == rows[at][0]:
                    total += rows[to][3]
                    to += 1
                if total > 1:
                    for _, i, j, _ in rows[at:to]:
                        hits[i].append(j)
                at = to
            yield [spans(sorted(x)) for x in hits]

    def result(self, text, mask):
        words = text.split()
        removed = int(mask.sum())
        if removed:
            words = [w for w, gone in zip(words, mask.tolist()) if not gone]
        return len(mask), removed, sha256(b" ".join(words)), b" ".join(words).decode() if self.texts else None


def spans(numbers):
    """Sorted numbers as half-open runs."""
    out = []
    for x in numbers:
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return out


SCHEMA = [
    pa.field("doc_id", pa.int64()),
    pa.field("n_words", pa.int64()),
    pa.field("n_removed", pa.int64()),
    pa.field("kept_sha256", pa.string()),
    pa.field("kept_text", pa.string()),
]


def remove_repeats(docs, k=WINDOW, m=MINIMISER, hot_segments=HOT_SEGMENTS, id_col="doc_id", text_col="text"):
    """Each text without the words that any window of k words covers which occurs twice.

    Returns one row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, kept_text.
    Words are runs of anything but ASCII white space, compared byte by byte. Null and empty
    texts have no words. A text shorter than k words keeps them all. Equal rows repeat each
    other, null ids are allowed and stay null, further columns are ignored, and an empty
    table gives an empty result. Windows are judged on the input.
    """
    scheme = Words(k, min(m, k), hot_segments, texts=True)
    return repeated(docs, scheme, SCHEMA, id_col, text_col)


def op2_substring_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return repeated(docs, Words(), SCHEMA).drop("kept_text")
