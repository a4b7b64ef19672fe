"""Encoding and decoding with a SentencePiece model, words of equal length advancing together.

Texts are cut into units no piece can cross. The units a task has not seen yet are encoded
in batches of equal length, as numpy matrices of code points: the hash of any substring
comes from prefix sums and is looked up among the sorted hashes of the pieces.

- Unigram models: Viterbi. All words move to the next end together; for each piece length
  the best score so far plus the piece's is compared, and maxima and backpointers are kept.
- BPE models: their segmentation is not the one of the best total score, but the one that
  joining the best-scored neighbours, leftmost first, arrives at. All words join one pair a
  step, chosen as a vectorised maximum over the same probes.
"""

import gc
import heapq
import re
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsewatch.llm.common import mixed, read, received, shipped, small_batches
from pulsewatch.llm.superkmers import BASE, INVERSE, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG_UNIT = 1_000
MOST_CACHED = 200_000
#: Rows of a batch turned into strings at once.
SLICE_ROWS = 500
BATCH_CHARS = 1 << 20
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Hashes are looked up from the first key with the same leading bits on.
LEADING = 18


def messages(raw):
    """(field, value) of a protocol buffer message; numbers, 4 or 8 raw bytes, or bytes."""
    at = 0

    def number():
        nonlocal at
        shift = value = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces with scores and kinds, and how the text is prepared."""

    pieces: list
    scores: list
    kinds: list
    type: int
    dummy_prefix: bool = True

    def __post_init__(self):
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        strings = [self.pieces[i] for i in usable]
        keys = string_hashes(strings)
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.uint64(2**64 - 1)]
        self.ids = np.r_[np.array(usable, np.int64)[order], -1]
        leading = np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING)
        self.first = np.searchsorted(self.keys[:-1], leading)
        self.steps = int(np.diff(self.first, append=len(order)).max()) - 1
        self.key_scores = np.r_[np.array([self.scores[i] for i in usable])[order], -np.inf]
        self.longest = max(map(len, strings), default=1)
        self.by_string = dict(zip(strings, usable))
        self.bytes = {bytes([int(self.pieces[i][3:5], 16)]): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), -1)
        joined = {c for s in strings if len(s) > 1 for c in s}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        # Where no piece holds a blank after something else, a unit ends before blanks.
        if any(SPACE in s.lstrip(SPACE) for s in strings):
            unit = f"[^{alone}]+" if alone else "(?s:.+)"
        else:
            unit = f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+"
        self.units = re.compile(f"{unit}|[{alone}]" if alone else unit)
        self.out = [self.shown(i) for i in range(len(self.pieces))]

    def shown(self, i):
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()


def load(path=MODEL):
    """The model in a file. Only models that leave the text as it is are taken."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, kind, dummy = [], [], [], UNIGRAM, True
    for field, value in messages(raw):
        if field == 1:
            own = dict(messages(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif field == 2:
            kind = dict(messages(value)).get(3, UNIGRAM)
        elif field == 3:
            own = dict(messages(value))
            dummy = bool(own.get(3, 1))
            if own.get(2) or own.get(4, 1):
                raise ValueError("the model normalises its input, which is not supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError("neither a unigram nor a BPE model")
    return Model(pieces, scores, kinds, kind, dummy)


def code_points(strings):
    """Equal-length strings as a matrix of code points."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(strings), -1)


def prefix_hashes(codes):
    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, codes.shape[1]), axis=1, out=sums[:, 1:])
    return sums


def string_hashes(strings):
    """The hash of each string, strings of equal length at once."""
    by_length, out = {}, np.zeros(len(strings), np.uint64)
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for own in by_length.values():
        out[own] = mixed(prefix_hashes(code_points([strings[i] for i in own]))[:, -1].copy())
    return out


class Words:
    """Equal-length words and the pieces their substrings are."""

    def __init__(self, model, strings):
        self.model, self.strings = model, strings
        self.sums = prefix_hashes(code_points(strings))
        self.length = self.sums.shape[1] - 1
        self.back = powers(INVERSE, self.length + 1)

    def probe(self, rows, start, end):
        """Place among the piece keys of the substrings [start, end) of some words; the last one if none."""
        key = mixed((self.sums[rows, end] - self.sums[rows, start]) * self.back[start])
        at = self.model.first[key >> np.uint64(64 - LEADING)]
        for _ in range(self.model.steps):
            at += self.model.keys[at] < key
        return np.where(self.model.keys[at] == key, at, len(self.model.keys) - 1)

    def spell(self, row, cuts):
        """Piece ids of a word cut at the given places; a character without a piece by its bytes."""
        word, out = self.strings[row], []
        for a, b in zip(cuts, cuts[1:]):
            part = word[a:b]
            i = self.model.by_string.get(part)
            if i is not None:
                out.append(i)
            elif self.model.bytes:
                out += [self.model.bytes[bytes([x])] for x in part.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.model.unknown)
        return out

    def spellings(self, rows, cuts):
        """The same for many words, cut into equally many parts: those with a piece for each part at once."""
        ids = self.model.ids[self.probe(rows[:, None], cuts[:, :-1], cuts[:, 1:])]
        out = ids.tolist()
        for i in np.flatnonzero((ids < 0).any(axis=1)).tolist():
            out[i] = self.spell(rows[i], cuts[i].tolist())
        return out

    def joined(self):
        """BPE: all words join their best pair, leftmost first, until they have none."""
        n, rows = len(self.strings), np.arange(len(self.strings))
        cuts = np.tile(np.arange(self.length + 1), (n, 1))
        out = [None] * n
        score = self.pair_scores(rows, cuts, np.arange(self.length - 1)[None, :].repeat(n, 0)) if self.length > 1 else np.zeros((n, 0))
        while len(rows):
            if score.shape[1] == 0:
                done = np.ones(len(rows), bool)
            else:
                best = np.argmax(score, axis=1)
                done = np.isneginf(score[np.arange(len(rows)), best])
            if done.any():
                for r, ids in zip(rows[done].tolist(), self.spellings(rows[done], cuts[done])):
                    out[r] = ids
            if done.all():
                break
            rows, cuts, score, best = rows[~done], cuts[~done], score[~done], best[~done]
            at = np.arange(len(rows))
            width = cuts.shape[1]
            keep = np.ones((len(rows), width), bool)
            keep[at, best + 1] = False
            cuts = cuts[keep].reshape(len(rows), width - 1)
            keep = np.ones((len(rows), width - 2), bool)
            keep[at, best] = False
            score = score[keep].reshape(len(rows), width - 3)
            # The pairs left and right of the joined one are new.
            for pair in (best - 1, best):
                some = (pair >= 0) & (pair < width - 3)
                if some.any():
                    score[at[some], pair[some]] = self.pair_scores(rows[some], cuts[some], pair[some][:, None])[:, 0]
        return out

    def pair_scores(self, rows, cuts, pair):
        start, end = np.take_along_axis(cuts, pair, 1), np.take_along_axis(cuts, pair + 2, 1)
        return self.model.key_scores[self.probe(rows[:, None], start, end)]

    def viterbi(self):
        """Unigram: the segmentation of the best total score; of equal ones the one whose last piece is longest."""
        n, rows = len(self.strings), np.arange(len(self.strings))
        best = np.full((n, self.length + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((n, self.length + 1), np.int64)
        least = min(self.model.scores, default=0.0) - UNKNOWN_PENALTY
        for end in range(1, self.length + 1):
            starts = np.arange(max(0, end - self.model.longest), end)
            at = self.probe(rows[:, None], starts[None, :].repeat(n, 0), np.full((n, len(starts)), end))
            score = self.model.key_scores[at]
            one = score[:, -1]
            score[:, -1] = np.where(np.isneginf(one), least, one)
            total = best[:, starts] + score
            pick = np.argmax(total, axis=1)
            best[:, end] = total[rows, pick]
            came[:, end] = starts[pick]
        out = []
        for r in range(n):
            cuts = [self.length]
            while cuts[-1]:
                cuts.append(int(came[r, cuts[-1]]))
            out.append(self.spell(r, cuts[::-1]))
        return out


def join_long(model, word):
    """BPE of one long word by a heap of pairs: the same order, without a step for all pairs."""
    following = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    heap = []

    def push(a):
        b = following[a]
        if a >= 0 and b < len(word):
            i = model.by_string.get(word[a : following[b]]) if following[b] - a <= model.longest else None
            if i is not None:
                heapq.heappush(heap, (-model.scores[i], a, b, following[b]))

    for a in range(len(word)):
        push(a)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if not (alive[a] and following[a] == b and b < len(word) and alive[b] and following[b] == end):
            continue
        alive[b] = False
        following[a] = end
        if end < len(word):
            before[end] = a
        if before[a] >= 0:
            push(before[a])
        push(a)
    return [a for a in range(len(word)) if alive[a]] + [len(word)]


class Encoder:
    """Encodes units, keeping the ids of those seen; one in each task."""

    def __init__(self, model):
        self.model = model
        self.number = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)

    def forget(self):
        """Keep the units that came in more than one batch, at most half of all places; older uses count half."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > MOST_CACHED // 2:
            most = np.argsort(-self.uses[kept], kind="stable")[: MOST_CACHED // 2]
            kept = np.sort(kept[most])
        names = list(self.number)
        self.number = {names[i]: n for n, i in enumerate(kept.tolist())}
        begin, self.size, self.uses = self.begin[kept], self.size[kept], self.uses[kept] // 2
        ends = np.cumsum(self.size)
        self.begin = ends - self.size
        self.flat = self.flat[np.repeat(begin - self.begin, self.size) + np.arange(self.size.sum())]

    def learn(self, units):
        by_length = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        names, found = [], []
        for length, words in sorted(by_length.items()):
            names += words
            for low in range(0, len(words), max(1, BATCH_CHARS // length)):
                part = words[low : low + max(1, BATCH_CHARS // length)]
                matrix = Words(self.model, part)
                if self.model.type == UNIGRAM:
                    found += matrix.viterbi()
                elif length > LONG_UNIT:
                    found += [matrix.spell(r, join_long(self.model, w)) for r, w in enumerate(part)]
                else:
                    found += matrix.joined()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names))))
        self.begin, self.size = np.r_[self.begin, begins], np.r_[self.size, sizes]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))]
        self.uses = np.r_[self.uses, np.zeros(len(found), np.int32)]

    def units(self, text):
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        return self.model.units.findall(SPACE + marked if self.model.dummy_prefix else marked)

    def encode(self, texts):
        """(ids of all texts end to end, how many each has)."""
        cut = [self.units(t) for t in texts]
        if len(self.number) > MOST_CACHED:
            self.forget()
        new = set().union(*cut).difference(self.number) if cut else set()
        if new:
            self.learn(sorted(new))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        came = np.zeros(len(self.uses), bool)
        came[at] = True
        self.uses += came
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        place = np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        total = np.r_[0, ends][np.cumsum([0, *map(len, cut)])]
        return self.flat[place], np.diff(total)


def decode_ids(model, ids):
    """The text of piece ids; broken byte sequences become replacement characters."""
    raw = b"".join([model.out[i] for i in ids])
    if model.dummy_prefix and raw.startswith(b" "):
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


def batches_of(texts, chars):
    low = 0
    while low < len(texts):
        high, total = low, 0
        while high < len(texts) and (high == low or total + len(texts[high] or "") <= chars):
            total += len(texts[high] or "")
            high += 1
        yield low, high
        low = high


def encode(docs, model=MODEL, id_col="doc_id", text_col="text"):
    """doc_id, ids, n_ids and round_trip (whether decoding gives the text back) of every row.

    Null texts have null ids and count as given back; empty ones have none. Equal rows give
    equal rows, null ids are kept, further columns are ignored, and an empty table gives an
    empty result. A text that holds the blank's own sign (U+2581) comes back with blanks.
    `model` is a path the driver reads; the pieces, of which there is a fixed number, are
    broadcast.
    """
    small_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, load(model))

    def run(batches):
        known = received(shared)
        # What earlier steps of the same worker have left.
        gc.collect()
        pa.default_memory_pool().release_unused()
        encoder = Encoder(known)
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in batches_of(all_texts, BATCH_CHARS):
                texts = all_texts[low:high]
                flat, sizes = encoder.encode(texts)
                ends = np.cumsum(sizes)
                values = flat.tolist()
                same = [t is None or decode_ids(known, values[e - s : e]) == t for t, e, s in zip(texts, ends.tolist(), sizes.tolist())]
                none = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(all_ids[low:high], pa.int64()), lists, pa.array(sizes, pa.int64()), pa.array(same)],
                    ["doc_id", "ids", "n_ids", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded, model=MODEL, id_col="doc_id", ids_col="ids"):
    """doc_id and text of every row of ids; null ids give a null text."""
    shared = shipped(encoded.sparkSession, load(model))

    def run(batches):
        known = received(shared)
        for batch in batches:
            texts = [None if x is None else decode_ids(known, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark, sf_dir):
    return encode(read(spark, sf_dir, "documents"))
