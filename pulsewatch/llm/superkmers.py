"""Windows of k tokens that occur twice, found by minimisers.

Documents are dealt into blocks. In a block, consecutive windows with the same minimiser
become one segment (a super-k-mer), equal segments are merged, and each travels once as
a packed string to the bucket of its minimiser. A bucket decides which windows occur more
than once and answers block by block; a block finds its segments again and marks them.

With `fingerprints_first` segments announce themselves by 128 bits: the minimiser's hash
and one of their content. A segment alone under its minimiser is no repeat, and one that
came several times, alone, is repeated throughout; the strings of the others follow.

Equal windows have equal minimisers, so they meet in one bucket. A minimiser with more
than `HOT_SEGMENTS` segments is hot: its windows are keyed one by one by their whole
content instead, which spreads different contexts of a common phrase over all buckets,
while equal windows, merged in each block first, cost a bucket one row per block.
"""

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from pulsewatch.llm.common import block_count, block_rows, in_blocks, mixed, texts_of

HOT_SEGMENTS = 1_000
MOST_HOT = 1_000_000
CHUNK = 1 << 20
PIECE_BYTES = 2 * 1024 * 1024
REPEATED, SHARED = 1, 2
POSITION = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base, n):
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def grams(tokens, m):
    """A hash of each run of m tokens, from prefix sums of one polynomial."""
    n = len(tokens)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * powers(BASE, n), out=sums[1:])
    return mixed((sums[m:] - sums[:-m]) * powers(INVERSE, n - m + 1))


def sliding_min(x, width, n):
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def segments(tokens, lengths, k, m, hot=None):
    """Arrays (start, windows, key): the segments of token sequences of given lengths."""
    n = len(tokens)
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < k:
        return empty
    valid = np.zeros(n - k + 1, bool)
    at = 0
    for length in lengths:
        if length >= k:
            valid[at : at + length - k + 1] = True
        at += length
    found = [empty]
    for a in range(0, n - k + 1, CHUNK):
        ok = valid[a : a + CHUNK]
        if not ok.any():
            continue
        part = tokens[a : a + len(ok) + k - 1]
        g = grams(part, m)
        key = (g & ~POSITION) | np.arange(len(g), dtype=np.uint64)
        at_min = (sliding_min(key, k - m + 1, len(ok)) & POSITION).astype(np.int64)
        at_min[~ok] = -1
        starts = np.flatnonzero(np.r_[True, at_min[1:] != at_min[:-1]])
        sizes = np.diff(np.r_[starts, len(ok)])
        kept = at_min[starts] >= 0
        starts, sizes = starts[kept], sizes[kept]
        keys = g[at_min[starts]]
        if hot is not None and len(hot):
            where = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            is_hot = hot[where] == keys
            if is_hot.any():
                whole = grams(part, k)
                first, count = starts[is_hot], sizes[is_hot]
                single = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                starts = np.r_[starts[~is_hot], single]
                sizes = np.r_[sizes[~is_hot], np.ones(len(single), np.int64)]
                keys = np.r_[keys[~is_hot], whole[single]]
        found.append((starts + a, sizes, keys))
    return tuple(np.concatenate(x) for x in zip(*found))


class Block:
    """The segments of one block of texts, equal ones merged under one number."""

    def __init__(self, texts, scheme, hot):
        self.tokens = scheme.tokens(texts)
        t = self.tokens
        self.start, self.size, key = segments(t.hashes, t.lengths, scheme.k, scheme.m, hot)
        last = self.start + self.size + scheme.k - 2
        data, seen, number = t.data, {}, []
        for a, b in zip(t.begin[self.start].tolist(), t.end[last].tolist()):
            number.append(seen.setdefault(data[a:b], len(seen)))
        self.number = np.array(number, np.int64)
        self.contents = list(seen)
        self.count = np.bincount(self.number, minlength=len(seen)) if seen else np.zeros(0, np.int64)
        self.key = np.zeros(len(seen), np.uint64)
        self.key[self.number] = key
        self.windows = np.zeros(len(seen), np.int64)
        self.windows[self.number] = self.size

    def by_bucket(self, buckets, some=None):
        """(bucket, numbers of its segments); `some` limits the segments."""
        bucket = (self.key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        if some is not None:
            order = order[some[order]]
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        return [(int(bucket[part[0]]), part) for part in np.split(order, cuts)] if len(order) else []

    def announced(self, buckets):
        """(bucket, blob) of keys, content hashes and counts."""
        squeeze = zstandard.ZstdCompressor(level=1)
        for bucket, part in self.by_bucket(buckets):
            content = np.fromiter((xxhash.xxh3_64_intdigest(self.contents[i]) for i in part.tolist()), np.uint64, len(part))
            many = (self.count[part] > 1).astype(np.uint8)
            yield bucket, squeeze.compress(self.key[part].tobytes() + content.tobytes() + many.tobytes())

    def packed(self, buckets, some=None):
        """(bucket, blob) for each bucket that gets any of the segments."""
        squeeze = zstandard.ZstdCompressor(level=1)
        for bucket, part in self.by_bucket(buckets, some):
            strings = [self.contents[i] for i in part.tolist()]
            lengths = np.fromiter(map(len, strings), np.uint32, len(strings))
            head = struct.pack("<I", len(part)) + part.astype(np.uint32).tobytes() + self.key[part].tobytes()
            head += np.minimum(self.count[part], 2).astype(np.uint8).tobytes() + lengths.tobytes()
            yield bucket, squeeze.compress(head + b"".join(strings))

    def covered(self, verdicts, k):
        """Which tokens a repeated window covers; verdicts: rows (number, from, to)."""
        change = np.zeros(len(self.tokens.hashes) + 1, np.int64)
        if len(verdicts):
            order = np.argsort(self.number, kind="stable")
            first = np.searchsorted(self.number[order], verdicts[:, 0], "left")
            many = np.searchsorted(self.number[order], verdicts[:, 0], "right") - first
            row = np.repeat(np.arange(len(verdicts)), many)
            at = order[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]]
            np.add.at(change, self.start[at] + verdicts[row, 1], 1)
            np.add.at(change, self.start[at] + verdicts[row, 2] + k - 1, -1)
        return np.cumsum(change[:-1]) > 0


def sorted_out(blob):
    """(places, verdicts) of the segments a bucket has something to say about."""
    n = len(blob) // 5
    return np.frombuffer(blob, np.uint32, n).astype(np.int64), np.frombuffer(blob, np.uint8, n, 4 * n)


def unpacked(blob):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    numbers = np.frombuffer(raw, np.uint32, n, 4)
    keys = np.frombuffer(raw, np.uint64, n, 4 + 4 * n)
    counts = np.frombuffer(raw, np.uint8, n, 4 + 12 * n)
    lengths = np.frombuffer(raw, np.uint32, n, 4 + 13 * n)
    ends = 4 + 17 * n + np.cumsum(lengths, dtype=np.int64)
    strings = [raw[e - s : e] for e, s in zip(ends.tolist(), lengths.tolist())]
    return numbers, keys, counts, strings


def hot_minimisers(docs, scheme):
    """Sorted keys of minimisers with too many segments: MOST_HOT of them at most."""

    def count(batches):
        for batch in batches:
            for texts in pieces(texts_of(batch.column(0))):
                t = scheme.tokens(texts)
                key, n = np.unique(segments(t.hashes, t.lengths, scheme.k, scheme.m)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    keys = docs.select("text").mapInArrow(count, "key long, n long")
    counted = keys.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > scheme.hot_segments)
    # No more than MOST_HOT keys come to the driver: the bound rises with the corpus.
    found = counted.orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def pieces(texts, size=PIECE_BYTES):
    """The texts in lists of about `size` bytes."""
    out, total = [], 0
    for x in texts:
        out.append(x)
        total += len(x)
        if total >= size:
            yield out
            out, total = [], 0
    if out:
        yield out


def repeated(docs, scheme, schema, id_col="doc_id", text_col="text"):
    """Rows `scheme.result` makes of each text and the tokens that repeated windows cover."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = block_count(rows)
    hot = spark.sparkContext.broadcast(hot_minimisers(rows, scheme))
    dealt = in_blocks(rows, blocks)

    def letters(block, made):
        made = list(made)
        return pa.table(
            {
                "block": pa.array([block] * len(made), pa.int32()),
                "bucket": pa.array([b for b, _ in made], pa.int32()),
                "packed": pa.array([p for _, p in made], pa.binary()),
            }
        )

    def send(table):
        block = Block(block_rows(table)[1], scheme, hot.value)
        return letters(table.column("block")[0].as_py(), block.announced(blocks) if scheme.fingerprints_first else block.packed(blocks))

    def send_shared(texts, verdicts):
        """The strings of segments that share their minimiser with other ones."""
        if not texts.num_rows:
            return letters(0, [])
        block = Block(block_rows(texts)[1], scheme, hot.value)
        shared = np.zeros(len(block.contents), bool)
        own = dict(block.by_bucket(blocks))
        for bucket, blob in zip(verdicts.column("bucket").to_pylist(), verdicts.column("packed").to_pylist()):
            place, kind = sorted_out(blob)
            shared[own[bucket][place[kind == SHARED]]] = True
        return letters(texts.column("block")[0].as_py(), block.packed(blocks, shared))

    def compare(table):
        """Which announced segments are repeated throughout, and which share a minimiser."""
        squeeze = zstandard.ZstdDecompressor()
        raw = [squeeze.decompress(x) for x in table.column("packed").to_pylist()]
        sizes = np.array([len(x) // 17 for x in raw])
        key = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(raw, sizes)])
        content = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(raw, sizes)])
        many = np.concatenate([np.frombuffer(x, np.uint8, n, 16 * n) for x, n in zip(raw, sizes)])
        order = np.lexsort((content, key))
        new_key = np.r_[True, np.diff(key[order]) != 0]
        new = new_key | np.r_[True, np.diff(content[order]) != 0]
        group, kind_of = np.cumsum(new_key) - 1, np.cumsum(new) - 1
        total = np.bincount(kind_of, 1 + many[order])[kind_of]
        kinds = np.bincount(group, new)[group]
        verdict = np.zeros(len(key), np.uint8)
        verdict[order] = np.where(kinds > 1, SHARED, np.where(total > 1, REPEATED, 0))
        made = []
        bucket = table.column("bucket")[0].as_py()
        for block, part in zip(table.column("block").to_pylist(), np.split(verdict, np.cumsum(sizes)[:-1])):
            place = np.flatnonzero(part)
            if len(place):
                made.append((block, place.astype(np.uint32).tobytes() + part[place].tobytes()))
        return pa.table(
            {
                "block": pa.array([b for b, _ in made], pa.int32()),
                "bucket": pa.array([bucket] * len(made), pa.int32()),
                "packed": pa.array([p for _, p in made], pa.binary()),
            }
        )

    def judge(table):
        answers = {}
        of, total, members, by_key = {}, [], [], {}
        for block, blob in zip(table.column("block").to_pylist(), table.column("packed").to_pylist()):
            numbers, keys, counts, strings = unpacked(blob)
            for number, key, count, string in zip(numbers.tolist(), keys.tolist(), counts.tolist(), strings):
                i = of.setdefault(string, len(of))
                if i == len(total):
                    total.append(0)
                    members.append([])
                    by_key.setdefault(key, []).append(i)
                total[i] += count
                members[i].append((block, number))
        strings = list(of)

        def answer(i, spans):
            for block, number in members[i]:
                to = answers.setdefault(block, [])
                for lo, hi in spans:
                    to.append((number, lo, hi))

        mixed_groups = []
        for own in by_key.values():
            if len(own) > 1:
                mixed_groups.append(own)
            elif total[own[0]] > 1:
                answer(own[0], [(0, scheme.windows(strings[own[0]]))])
        for own, spans in zip(mixed_groups, scheme.repeats([[(strings[i], total[i]) for i in own] for own in mixed_groups])):
            for i, s in zip(own, spans):
                if s:
                    answer(i, s)
        squeeze = zstandard.ZstdCompressor(level=1)
        return pa.table(
            {
                "block": pa.array(list(answers), pa.int32()),
                "bucket": pa.array([-1] * len(answers), pa.int32()),
                "packed": pa.array([squeeze.compress(np.array(x, np.int64).tobytes()) for x in answers.values()], pa.binary()),
            }
        )

    def finish(texts, found):
        if not texts.num_rows:
            return schema_table([])
        ids, whole = block_rows(texts)
        block = Block(whole, scheme, hot.value)
        verdicts, own = [np.zeros((0, 3), np.int64)], None
        for bucket, blob in zip(found.column("bucket").to_pylist(), found.column("packed").to_pylist()):
            if bucket < 0:
                verdicts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(-1, 3))
            else:
                own = own or dict(block.by_bucket(blocks))
                place, kind = sorted_out(blob)
                number = own[bucket][place[kind == REPEATED]]
                verdicts.append(np.stack([number, np.zeros_like(number), block.windows[number]], axis=1))
        mask = block.covered(np.concatenate(verdicts), scheme.k)
        out, at = [], 0
        for i, text, length in zip(ids, whole, block.tokens.lengths):
            out.append((i, *scheme.result(text, mask[at : at + length])))
            at += length
        return schema_table(out)

    fields = pa.schema(schema)

    def schema_table(out):
        columns = list(zip(*out)) if out else [[] for _ in fields]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    names = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long"}
    sql = ", ".join(f"{f.name} {names[f.type]}" for f in fields)
    letter = "block int, bucket int, packed binary"
    sent = dealt.groupBy("block").applyInArrow(send, letter)
    if scheme.fingerprints_first:
        told = sent.groupBy("bucket").applyInArrow(compare, letter)
        strings = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send_shared, letter)
        found = told.union(strings.groupBy("bucket").applyInArrow(judge, letter))
    else:
        found = sent.groupBy("bucket").applyInArrow(judge, letter)
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, sql)
