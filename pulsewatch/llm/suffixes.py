"""Substring removal by bytes: strings of 200 bytes that occur twice (merged suffix orders).

Texts are cut into segments that meet in the bucket of their minimiser (`superkmers`). A
segment nobody else shares is no repeat, and one that came several times is repeated
throughout. Different segments under one minimiser are dealt into shards; each shard gets
its own sorted rotations and Burrows-Wheeler symbols, and the shards' orders are merged by
refining one interleave, round by round, without sorting the suffixes of all of them.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pulsewatch.llm.common import read, sha256
from pulsewatch.llm.substrings import spans
from pulsewatch.llm.superkmers import HOT_SEGMENTS, repeated

LENGTH = 200
MINIMISER = 24
SHARDS = 4
MERGE_BYTES = 60_000


class Shifted:
    """numbers[i] = i + by, without the array."""

    def __init__(self, by):
        self.by = by

    def __getitem__(self, i):
        return i + self.by


@dataclass
class Tokens:
    data: bytes
    hashes: np.ndarray
    begin: Shifted
    end: Shifted
    lengths: list


def rotations(x, sigma):
    """The order of all rotations of a symbol array, by doubling the sorted depth."""
    n = len(x)
    depth = max(1, int(62 / np.log2(sigma)))
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key = key * np.uint64(sigma) + np.roll(x, -i).astype(np.uint64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]).astype(np.uint64)
        if depth >= n or int(rank[order[-1]]) == n - 1:
            return order
        key = rank * np.uint64(n) + np.roll(rank, -depth)
        depth *= 2


def stable_order(codes, most):
    """Stable order of small numbers, by halves of 16 bits."""
    if most < 1 << 16:
        return np.argsort(codes.astype(np.uint16), kind="stable")
    low = np.argsort(codes.astype(np.uint16), kind="stable")
    return low[np.argsort((codes >> 16).astype(np.uint16)[low], kind="stable")]


def merged_order(shards, sigma, depth):
    """Positions in the shards, laid end to end, in the order of their rotations' first `depth` symbols.

    A shard's Burrows-Wheeler symbols are widened to the `step` symbols before a rotation,
    as many as 62 bits hold, numbered in their order over all shards. A round sorts the
    interleaved symbols stably: the order known of rotations becomes that of the rotations
    `step` earlier, sorted `step` deeper. Only shard numbers move, as inside a shard the
    order stays as its own sort made it. The interleave is final when a round leaves it
    alone or the depth is reached.
    """
    step = max(1, int(62 / np.log2(sigma)))
    orders = [rotations(x, sigma) for x in shards]
    codes = []
    for x, order in zip(shards, orders):
        code = np.zeros(len(x), np.uint64)
        for i in range(step, 0, -1):
            code = code * np.uint64(sigma) + np.roll(x, i).astype(np.uint64)
        codes.append(code[order])
    known, symbols = np.unique(np.concatenate(codes), return_inverse=True)
    symbols = np.split(symbols.astype(np.uint32), np.cumsum([len(x) for x in shards])[:-1])
    weave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(x) for x in shards])
    before = np.empty(len(weave), np.uint32)
    for _ in range(-(-depth // step)):
        for s, own in enumerate(symbols):
            before[weave == s] = own
        after = weave[stable_order(before, len(known))]
        if np.array_equal(after, weave):
            break
        weave = after
    where = np.empty(len(weave), np.int64)
    base = 0
    for s, order in enumerate(orders):
        where[weave == s] = order + base
        base += len(order)
    return where


def equal_to_previous(raw, at, length):
    """For positions in sorted order: whether `length` bytes there equal those of the one before."""
    width = 8 if length >= 8 else 1
    padded = np.r_[raw, np.zeros(width, np.uint8)].astype(np.uint64)
    word = np.zeros(len(raw), np.uint64)
    for i in range(width):
        word |= padded[i : i + len(raw)] << np.uint64(8 * i)
    alive = np.arange(1, len(at))
    for step in [*range(0, length - width + 1, width), length - width]:
        alive = alive[word[at[alive] + step] == word[at[alive - 1] + step]]
    same = np.zeros(len(at), bool)
    same[alive] = True
    return same


def repeated_starts(strings, counts, length, shard_count=SHARDS):
    """For each string, the starts of substrings of `length` that occur more than once in all.

    `counts` says how often each (different) string occurs.
    """
    raw = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(sizes + 1) - sizes - 1
    used = np.zeros(257, bool)
    used[raw.astype(np.int64) + 1] = True
    used[0] = True
    dense = np.cumsum(used) - 1
    x = dense[raw.astype(np.int64) + 1]
    x[begin + sizes] = 0
    sigma = int(dense[-1]) + 1
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    cuts = sorted({int(begin[i]) for i in range(0, len(strings), max(1, -(-len(strings) // shard_count)))})
    where = merged_order(np.split(x, cuts[1:]), max(2, sigma), length)
    # Only starts from which a whole substring fits in the string count.
    inside = where - begin[owner[where]] <= (sizes - length)[owner[where]]
    at = where[inside]
    same = equal_to_previous(raw, at, length)
    interval = np.cumsum(~same) - 1
    weight = np.bincount(interval, counts[owner[at]], minlength=0 if not len(at) else interval[-1] + 1)
    hit = at[weight[interval] > 1] if len(at) else at
    hit = np.sort(hit)
    parts = np.split(hit, np.searchsorted(hit, begin)[1:])
    return [part - b for part, b in zip(parts, begin)]


@dataclass
class Bytes:
    k: int = LENGTH
    m: int = MINIMISER
    hot_segments: int = HOT_SEGMENTS
    texts: bool = False
    fingerprints_first: bool = True

    def tokens(self, texts):
        data = b"".join(texts)
        return Tokens(data, np.frombuffer(data, np.uint8), Shifted(0), Shifted(1), [len(t) for t in texts])

    def windows(self, string):
        return len(string) + 1 - self.k

    def repeats(self, groups):
        """For each string of each group, the spans of starts that occur more than once."""
        batch, size = [], 0
        for group in groups:
            batch.append(group)
            size += sum(len(s) for s, _ in group)
            if size >= MERGE_BYTES:
                yield from self.merged(batch)
                batch, size = [], 0
        if batch:
            yield from self.merged(batch)

    def merged(self, batch):
        flat = [x for group in batch for x in group]
        starts = iter(repeated_starts([s for s, _ in flat], np.array([c for _, c in flat], float), self.k))
        for group in batch:
            yield [spans(next(starts).tolist()) for _ in group]

    def result(self, text, mask):
        removed = int(mask.sum())
        if not removed:
            return len(text), 0, 0, sha256(text), text if self.texts else None
        runs = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
        return len(text), removed, runs, sha256(kept), kept if self.texts else None


SCHEMA = [
    pa.field("doc_id", pa.int64()),
    pa.field("n_bytes", pa.int64()),
    pa.field("n_removed", pa.int64()),
    pa.field("n_spans", pa.int64()),
    pa.field("kept_sha256", pa.string()),
    pa.field("kept", pa.binary()),
]


def remove_repeats(docs, length=LENGTH, m=MINIMISER, hot_segments=HOT_SEGMENTS, id_col="doc_id", text_col="text"):
    """Each text without the bytes that any string of `length` bytes covers which occurs twice.

    Returns one row per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and kept (the remaining bytes: cuts may fall inside a character).
    Null and empty texts have no bytes; a text shorter than `length` keeps all. Equal rows
    repeat each other, null ids stay null, further columns are ignored, and an empty table
    gives an empty result. Matches never cross texts and are judged on the input.
    """
    return repeated(docs, Bytes(length, min(m, length), hot_segments, texts=True), SCHEMA, id_col, text_col)


def op9_suffix_dedup(spark, sf_dir):
    return repeated(read(spark, sf_dir, "documents"), Bytes(), SCHEMA).drop("kept")
