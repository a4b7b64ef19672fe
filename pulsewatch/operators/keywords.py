"""Log rules by an inverted index of the n-grams of their keywords.

A line that holds a keyword holds each of its n-grams (pieces of n bytes). The index files a keyword under
one of its n-grams, the one that fewest keywords have. A line's distinct n-grams are looked up there, and
only the keywords found are searched for in the line. So the cost is that of reading the lines, and of
the keywords that nearly occur, not lines times rules.

Rules too many for every task are dealt out instead, in packs, and each task passes the stored lines by its
share of them: there a keyword is filed under its head, its first bytes, up to HEADS[-1] of them, and no n-gram is
shipped. Heads have numbers, their keys, and a share has those of a range, so that of all shares a place of a line
is looked up in one. Rules that look for the same keyword are searched for once, and where sums are asked for, what
was found is summed up by keyword before it is given to each of them.
"""

import ctypes
import functools
import math
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewatch.operators import sizing
from pulsewatch.operators.detect import detect_logs
from pulsewatch.operators.sizing import row_bytes, salted_join
from pulsewatch.session import run_dir
from pulsewatch.sources.files import place

GRAM = 4
#: Bytes at the start of a keyword it is filed under in a share of the rules: the most it has.
HEADS = (1, 2, 3, 4, 8, 12)
#: Rules a task holds at once, rules below which no task is added, and lines stored and searched together.
SHARE_RULES = 1_200_000
LEAST_RULES = 50_000
STORED_ROWS = 512
#: Places of lines whose keywords are compared together, and those looked up together, which a cache holds.
BLOCK = 1 << 17
SCAN = 1 << 15
#: Keywords are counted by so many first bits of the keys of their heads.
SLOT_BITS = 14
#: Keywords compared with places at once, rules packed together, and rows of sums given back together.
PAIRS = 1 << 21
PACK_RULES = 200_000
SUM_ROWS = 50_000
OUT_BYTES = 32 << 20
TABLE_BITS = 20
#: Kinds of rules: keywords looked for, whole lines, and what is tested line by line.
LIKE, EQUAL, REST = 1, 2, 3
#: Sums of whole numbers are given back before they can pass this.
MOST_SUM = 1 << 62
INDEX = "gram long, keyword string, rule_id string, own string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def grams(raw, n):
    """The n-grams of some bytes as numbers, marked with their length."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < n:
        return np.zeros(0, np.int64)
    out = np.full(len(data) - n + 1, n << 32, np.int64)
    for i in range(n):
        out |= data[i : len(data) - n + 1 + i].astype(np.int64) << (8 * i)
    return out


def keyword_grams(raw):
    """The distinct n-grams a keyword may be filed under: those of GRAM bytes, or itself if shorter."""
    return np.unique(grams(raw, min(GRAM, len(raw))))


def slots(numbers):
    """Places of n-grams in a table of bits that leaves out most that are not in the index."""
    return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def keyword_index(rules):
    """Rules that look for a keyword, each under one n-gram: gram, keyword, rule_id, own (its resource)."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [keyword_grams(w.encode()) for w in words]
            sizes = [len(g) for g in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(words, object), sizes), pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))],
                names=["keyword", "gram"],
            )

    told = rules.select("keyword", "rule_id", F.col("resource").alias("own"))
    pairs = told.select("keyword").distinct().mapInArrow(run, "keyword string, gram long")
    shared = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = salted_join(pairs, shared, ["gram"]).groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return salted_join(told, rarest, ["keyword"]).select("gram", "keyword", "rule_id", "own")


class Lookup:
    """An index in memory: sorted n-grams, and under each its keywords with their rules."""

    def __init__(self, rows):
        under = {}
        for gram, keyword, rule_id, own in rows:
            under.setdefault(gram, {}).setdefault(keyword.encode(), []).append((rule_id, own))
        self.grams = np.array(sorted(under), np.int64)
        self.keywords = [list(under[g].items()) for g in self.grams.tolist()]
        self.sizes = sorted({int(g) >> 32 for g in self.grams.tolist()})
        self.bits = np.zeros(1 << TABLE_BITS, bool)
        self.bits[slots(self.grams)] = True

    def near(self, raw):
        """Numbers of the index's n-grams that some bytes hold."""
        out = []
        for n in self.sizes:
            own = grams(raw, n)
            own = own[self.bits[slots(own)]]
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            out.append(at[self.grams[at] == own])
        return np.unique(np.concatenate(out)).tolist() if out else []

    def hits(self, raw, resource):
        """Ids of the rules whose keyword the line holds and whose resource it has."""
        for i in self.near(raw):
            for keyword, rules in self.keywords[i]:
                if keyword in raw:
                    for rule_id, own in rules:
                        if own is None or own == resource:
                            yield rule_id


def detect_keywords(logs, rules, spread=None, columns=None, totals=None):
    """Log rows with each log rule they meet: the same rows as `detect.detect_logs`.

    Rules with op `like` and a keyword go through the index; `=` is a join on the whole line. `!=` and
    the empty keyword, which nearly every line meets, are tested on each line as there. An index
    measured small goes to every task, and lines do not move. Past the bound (or with `spread`) lines
    are written to the shared folder once and rules are dealt out; each task passes all lines by its
    rules, so nothing is shuffled but the rules, and all hits of a keyword come from one task. `columns`
    names the columns of `logs` to return, if not all: a line with many hits is copied to each.

    `totals` names a column of whole numbers to be summed up instead: rule_id, hits (rows met), first and
    total (the least value and the sum). Rows are parts, as an aggregate's are before its shuffle: a rule id
    may have several, to be added up by the caller.
    """
    if totals is not None:
        logs, columns = logs.withColumn(totals, F.col(totals).cast("long")), [totals]
    columns = logs.columns if columns is None else list(columns)
    # The op first: keywords of rules with another one need not be made.
    keyword, op = F.col("keyword").isNotNull(), F.col("op")
    is_like = (op == "like") & keyword & (F.col("keyword") != "")
    is_equal = (op == "=") & keyword
    is_rest = ((op == "!=") & keyword) | ((op == "like") & keyword & (F.col("keyword") == ""))
    like, equal, rest = rules.where(is_like), rules.where(is_equal), rules.where(is_rest)
    kind = F.when(is_like, LIKE).when(is_equal, EQUAL).when(is_rest, REST)
    told = rules.select(kind.alias("kind"), "keyword", row_bytes(rules.schema).cast("long").alias("bytes")).where("kind is not null")
    facts = told.mapInArrow(counted, "kind int, slot int, n long, bytes long, longest long").groupBy("kind", "slot")
    facts = facts.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("longest").alias("longest")).collect()
    counts, size, longest = np.zeros(1 << SLOT_BITS, np.int64), 0, 0
    for row in facts:
        if row["kind"] == LIKE:
            counts[row["slot"]], size = row["n"], size + row["bytes"]
        elif row["kind"] == EQUAL:
            longest = row["longest"]
    if spread is None:
        spread = counts.sum() > sizing.BROADCAST_ROWS or size > sizing.BROADCAST_BYTES
    fields = logs.select(*columns).schema.fields
    out = T.StructType([T.StructField("rule_id", T.StringType()), *fields])
    same_line = equal.select(F.col("keyword").alias("log"), F.col("rule_id"), F.col("resource").alias("_own"))
    # No longer line can be equal, so that most do not move.
    short = logs.where(F.octet_length("log") <= longest)
    same = salted_join(short, same_line, ["log"]).where("_own is null or _own = resource").select("rule_id", *columns)
    parts = [_spread(logs, like, counts.tolist(), out, totals) if spread else _summed(_sent(logs, like, out), totals), _summed(same, totals)]
    if any(row["kind"] == REST for row in facts):
        parts.append(_summed(detect_logs(logs, rest).select("rule_id", *columns), totals))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def _summed(found, totals):
    """Rows as they are, or summed up by rule."""
    if totals is None:
        return found
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.min(totals).alias("first"), F.sum(totals).alias("total"))


def _sent(logs, like, out):
    rows = keyword_index(like).toArrow()
    shared = logs.sparkSession.sparkContext.broadcast(list(zip(*(c.to_pylist() for c in rows.columns))))

    def run(batches):
        lookup = Lookup(shared.value)
        for batch in batches:
            lines = batch.column(batch.schema.get_field_index("log")).to_pylist()
            resources = batch.column(batch.schema.get_field_index("resource")).to_pylist()
            at, ids = [], []
            for i, (line, resource) in enumerate(zip(lines, resources)):
                if line is not None and len(lookup.grams):
                    met = list(lookup.hits(line.encode(), resource))
                    at += [i] * len(met)
                    ids += met
            if ids:
                own = batch.select(out.names[1:]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *own.columns], names=out.names)

    return logs.mapInArrow(run, out)


def texts_of(strings):
    """An array of strings as bytes end to end with room for reads past the end, and where each ends."""
    strings = strings.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    begin, end = (int(offsets[0]), int(offsets[-1])) if len(strings) else (0, 0)
    data = np.zeros(end - begin + 32, np.uint8)
    if end > begin:
        data[: end - begin] = np.frombuffer(strings.buffers()[2], np.uint8)[begin:end]
    return data, offsets[1:].astype(np.int64) - begin


def eights(data):
    """The eight bytes from each place of some bytes on as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def heads(words, begin, n, out=None):
    """The first n bytes from each of some places on, mixed into a number; `begin` is a slice or places."""
    shift = lambda by: slice(begin.start + by, begin.stop + by) if isinstance(begin, slice) else begin + by
    own = words[begin]
    if n < 8:
        own = np.bitwise_and(own, np.uint64((1 << 8 * n) - 1), out=out)
    if n > 8:
        own = np.multiply(own, np.uint64(0xC2B2AE3D27D4EB4F), out=out)
        own = np.bitwise_xor(own, words[shift(n - 8)], out=out)
    return np.multiply(own, np.uint64(0x9E3779B97F4A7C15), out=out)


def keys(words, begin, n, out=None, other=None):
    """Numbers that places are dealt out by: the first and the last four of n bytes mixed, in 32 bits. See `heads`."""
    fours = np.ndarray((len(words),), "<u4", words.base, 0, (1,))
    last = slice(begin.start + n - 4, begin.stop + n - 4) if isinstance(begin, slice) else begin + (n - 4)
    if n < 4:
        return np.multiply(np.bitwise_and(fours[begin], np.uint32((1 << 8 * n) - 1), out=out), np.uint32(0x9E3779B1), out=out)
    own, other = np.multiply(fours[begin], np.uint32(0x9E3779B1), out=out), np.multiply(fours[last], np.uint32(0x85EBCA77), out=other)
    return np.bitwise_xor(own, other, out=own)


def let_go():
    """Gives free memory back to the system, as a worker stays beside those of other tasks and of the next step."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spans(begin, count):
    """The numbers of some spans one after another: `count` from `begin` on each."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def slots_of(strings):
    """The slots of some strings (not empty): the first bits of the keys of their heads."""
    data, ends = texts_of(strings)
    begin, words = np.r_[0, ends[:-1]], eights(data)
    place = np.searchsorted(HEADS, ends - begin, "right") - 1
    out = np.zeros(len(begin), np.int64)
    for i in np.unique(place).tolist():
        own = np.flatnonzero(place == i)
        out[own] = keys(words, begin[own], HEADS[i]) >> np.uint32(32 - SLOT_BITS)
    return out


class Filed:
    """Keywords by their first n bytes, whose keys are from `low` to `low + reach`.

    Rows are sorted by the mix and have all that is compared side by side: the mix, the last eight bytes
    of the head and of the keyword, and its size and number. Of up to eight bytes the mix is one to one,
    and of more together with the last eight, so that no more of a head need be compared.
    """

    def __init__(self, words, begin, size, numbers, n, low, reach):
        self.n, self.low, self.reach = n, np.uint32(low), np.uint32(reach)
        mixed = heads(words, begin, n)
        order = np.argsort(mixed)
        begin, size = begin[order], size[order]
        self.longest = int(size.max())
        self.rows = np.empty((len(order), 4), np.uint64)
        self.rows[:, 3] = size << 32 | numbers[order]
        self.rows[:, 2] = self.tails(words, begin, size, n >= 8)
        self.rows[:, 1] = words[begin + max(0, n - 8)]
        self.rows[:, 0] = mixed = mixed[order]
        del order, begin, size
        self.bits = min(28, len(mixed).bit_length() + 1)
        self.firsts = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(self.slots(mixed), minlength=1 << self.bits), out=self.firsts[1:], dtype=np.int32)

    def slots(self, mixed):
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    @staticmethod
    def tails(words, at, size, whole):
        """The last eight bytes of those from some places on; where they are fewer (not `whole`), all as the high ones."""
        if whole:
            return words[at + (size - 8)]
        return words[at + np.maximum(size - 8, 0)] << (np.maximum(8 - size, 0) << 3).view(np.uint64)

    def near(self, words, low, high):
        """Places from low to high whose key is in reach, and the mixed heads there."""
        key, other, there, at = np.empty(SCAN, np.uint32), np.empty(SCAN, np.uint32), np.empty(SCAN, bool), []
        for begin in range(low, high, SCAN):
            size = min(SCAN, high - begin)
            own = keys(words, slice(begin, begin + size), self.n, key[:size], other[:size])
            np.subtract(own, self.low, out=own)
            np.less_equal(own, self.reach, out=there[:size])
            at.append(np.flatnonzero(there[:size]) + begin)
        at = np.concatenate(at)
        return at, heads(words, at, self.n)

    def pairs(self, words, low, high):
        """(keyword, place, size) where the head and the last eight bytes are those of the keyword, by place."""
        places, mixed = self.near(words, low, high)
        slot = self.slots(mixed)
        begin = self.firsts[slot].astype(np.int64)
        count = self.firsts[slot + 1] - begin
        reach, low = np.cumsum(count), 0
        while low < len(places):
            high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + PAIRS, "right")))
            many = count[low:high]
            rows = self.rows.take(spans(begin[low:high], many), 0)
            of = np.repeat(np.arange(low, high), many)
            at, size = places[of], (rows[:, 3] >> np.uint64(32)).view(np.int64)
            if self.longest > 32:
                held = np.flatnonzero(at + size <= len(words))
                rows, of, at, size = rows[held], of[held], at[held], size[held]
            held = self.tails(words, at, size, self.n >= 8) == rows[:, 2]
            held &= mixed[of] == rows[:, 0]
            held = np.flatnonzero(held)
            if self.n > 8:
                held = held[words[at[held] + (self.n - 8)] == rows[held, 1]]
            yield (rows[held, 3] & np.uint64(0xFFFFFFFF)).view(np.int64), at[held], size[held]
            low = high


class Share:
    """Some rules in memory: their distinct keywords filed under their heads, and the rules of each.

    Rules of one keyword and one resource are a kind: they meet the same lines. Keys of heads are all from
    `low` to `low + reach`. The list of tables is emptied, and what is not needed any more is let go at
    once, as tasks beside this one do the same.
    """

    def __init__(self, tables, low=0, reach=(1 << 32) - 1):
        rules = pa.concat_tables(tables)
        tables.clear()
        coded = rules.column(0).dictionary_encode()
        words = coded.chunk(coded.num_chunks - 1).dictionary
        number = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
        own = rules.column(2).combine_chunks().dictionary_encode()
        self.rule_ids = rules.column(1).combine_chunks()
        del rules, coded
        let_go()
        self.resources = own.dictionary
        many = len(own.dictionary) + 1
        number *= many
        number += own.indices.fill_null(-1).to_numpy() + 1
        kinds, kind = np.unique(number, return_inverse=True)
        del number, own
        self.kind = kind.astype(np.int32)
        self.own = (kinds % many - 1).astype(np.int32)
        self.first = np.searchsorted(kinds // many, np.arange(len(words) + 1)).astype(np.int32)
        del kinds, kind
        data, ends = texts_of(words)
        del words
        let_go()
        self.words, self.begin = eights(data), np.r_[0, ends[:-1]].astype(np.int64)
        size = ends - self.begin
        place = np.searchsorted(HEADS, size, "right") - 1
        members = ((HEADS[i], np.flatnonzero(place == i)) for i in np.unique(place).tolist())
        self.filed = [Filed(self.words, self.begin[m], size[m], m, n, low, reach) for n, m in members]
        if all(filed.longest <= filed.n + 8 for filed in self.filed):
            self.words = self.begin = None
        del data, ends, size, place, members
        let_go()

    def occur(self, words, ends):
        """(keyword, line) of every place in some lines where a keyword stands."""
        for low in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
            high = min(low + BLOCK, int(ends[-1]))
            for filed in self.filed:
                for which, at, size in filed.pairs(words, low, high):
                    # Places come in order, so that each line's are found by where it ends.
                    upto = np.searchsorted(at, ends, "left")
                    line = np.repeat(np.arange(len(ends)), np.diff(upto, prepend=0))
                    whole = at + size <= ends[line]
                    # What is between the head and the last eight bytes.
                    for byte in range(filed.n, filed.longest - 8, 8):
                        more = np.flatnonzero(whole & (size - 8 > byte))
                        whole[more] = words[at[more] + byte] == self.words[self.begin[which[more]] + byte]
                    yield which[whole], line[whole]

    def kinds(self, lines, resources):
        """(kind, line) of the kinds of rules that some lines meet, each once, by keyword and line."""
        data, ends = texts_of(lines)
        found = [w * len(lines) + n for w, n in self.occur(eights(data), ends)]
        pairs = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        which = pairs // max(1, len(lines))
        line = pairs - which * len(lines)
        where = pc.index_in(resources, self.resources).fill_null(-2).to_numpy()
        begin = self.first[which].astype(np.int64)
        many = self.first[which + 1] - begin
        kind, on = spans(begin, many), np.repeat(line, many)
        own = self.own[kind]
        holds = (own == -1) | (own == where[on])
        return kind[holds], on[holds]

    @functools.cached_property
    def members(self):
        """The rules by kind, and where those of each begin and end."""
        return np.argsort(self.kind, kind="stable"), np.r_[0, np.cumsum(np.bincount(self.kind, minlength=len(self.own)))]

    def hits(self, lines, resources, most):
        """Numbers of the lines with those of the rules they meet, about `most` at a time."""
        kind, line = self.kinds(lines, resources)
        rules, begin = self.members
        count = begin[kind + 1] - begin[kind]
        reach = np.cumsum(count)
        low = 0
        while low < len(kind):
            high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + most, "right")))
            many = count[low:high]
            yield np.repeat(line[low:high], many), rules[spans(begin[kind[low:high]], many)]
            low = high


class Sums:
    """Sums by kind of a share's rules: rows met, those with no value, the least value and the sum."""

    def __init__(self, share):
        self.share, self.bound, self.lines = share, 0, 0
        self.hits, self.missing, self.total = np.zeros(len(share.own), np.int32), None, np.zeros(len(share.own), np.int64)
        self.least = np.full(len(share.own), np.iinfo(np.int64).max)

    def add(self, batch):
        """Adds some stored lines (value, log, resource); rows of sums that had to be given back before."""
        top = pc.min_max(batch.column(0)).as_py()
        top = max(abs(top["min"] or 0), abs(top["max"] or 0))
        step = max(1, MOST_SUM // max(1, top))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if self.bound + part.num_rows * top > MOST_SUM or self.lines + part.num_rows >= 1 << 31:
                yield from self.rows()
                self.__init__(self.share)
            self.bound += part.num_rows * top
            self.lines += part.num_rows
            self._add(*self.share.kinds(part["log"], part["resource"]), part.column(0))

    def _add(self, kind, line, column):
        begin = self.gather(self.hits, kind)
        if column.null_count:
            there = column.is_valid().to_numpy(zero_copy_only=False)[line]
            self.missing = np.zeros(len(self.hits), np.int32) if self.missing is None else self.missing
            self.gather(self.missing, kind[~there])
            kind, line = kind[there], line[there]
            begin = np.flatnonzero(np.diff(kind, prepend=-1))
        if len(kind):
            values = column.fill_null(0).to_numpy()[line]
            np.add.at(self.total, kind[begin], np.add.reduceat(values, begin))
            np.minimum.at(self.least, kind[begin], np.minimum.reduceat(values, begin))

    @staticmethod
    def gather(counts, kind):
        """Counts kinds by runs of one, whose begins are returned; a kind may have several runs."""
        begin = np.flatnonzero(np.diff(kind, prepend=-1))
        np.add.at(counts, kind[begin], np.diff(begin, append=len(kind)).astype(np.int32))
        return begin

    def rows(self):
        """A row for each rule that met a line: rule_id, hits, first, total."""
        for at in range(0, len(self.share.kind), SUM_ROWS):
            kind = self.share.kind[at : at + SUM_ROWS]
            met = np.flatnonzero(self.hits[kind])
            if len(met):
                kind = kind[met]
                none = None if self.missing is None else self.hits[kind] == self.missing[kind]
                shown = [pa.array(self.hits[kind].astype(np.int64)), pa.array(self.least[kind], mask=none), pa.array(self.total[kind], mask=none)]
                yield pa.RecordBatch.from_arrays([self.share.rule_ids.take(pa.array(met + at)), *shown], names=["rule_id", "hits", "first", "total"])


def stored(logs, folder):
    """Writes the lines to Arrow files in the shared folder; the names of those of tasks that ended."""

    def save(batches):
        system, path = place(folder)
        system.create_dir(path, recursive=True)
        name, writer = uuid.uuid4().hex, None
        with system.open_output_stream(f"{path}/{name}", compression=None) as file:
            for batch in batches:
                # Read by each task: what is fast to read.
                options = pa.ipc.IpcWriteOptions(compression="lz4")
                writer = writer or pa.ipc.new_stream(file, batch.schema, options=options)
                for at in range(0, batch.num_rows, STORED_ROWS):
                    writer.write_batch(batch.slice(at, STORED_ROWS))
            if writer:
                writer.close()
        batch = None
        let_go()
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return sorted(r["name"] for r in logs.mapInArrow(save, "name string").collect())


def lines_of(folder, names):
    """Batches of stored lines."""
    system, path = place(folder)
    for name in names:
        with system.open_input_stream(f"{path}/{name}", compression=None) as file:
            yield from pa.ipc.open_stream(file)


def counted(batches):
    """How many rules there are by kind, and by slot where they look for a keyword, with their bytes and longest."""
    rules, size, longest = (np.zeros((REST + 1, 1 << SLOT_BITS), np.int64) for _ in range(3))
    for batch in batches:
        for kind in (LIKE, EQUAL, REST):
            own = batch.filter(pc.equal(batch.column(0), kind))
            if own.num_rows:
                slot = slots_of(own.column(1)) if kind == LIKE else np.zeros(own.num_rows, np.int64)
                np.add.at(rules[kind], slot, 1)
                np.add.at(size[kind], slot, own.column(2).to_numpy())
                np.maximum.at(longest[kind], slot, pc.binary_length(own.column(1)).to_numpy().astype(np.int64))
    batch = own = None
    let_go()
    kinds, slots = np.nonzero(rules)
    shown = [kinds.astype(np.int32), slots.astype(np.int32), *(x[kinds, slots] for x in (rules, size, longest))]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in shown], names=["kind", "slot", "n", "bytes", "longest"])


def dealing(counts, tasks):
    """How rules are dealt out that are counted by slot: (first part and parts of each slot, ranges of the parts).

    Parts have slots that lie together, with about as many rules as each other. A slot with more than that is
    divided among parts of its own, all with its range. Ranges are (low, reach) of keys.
    """
    per, width = max(1, sum(counts) / tasks), (1 << 32) // len(counts)
    of, ranges, at = np.tile([0, 1], (len(counts), 1)), [], 0
    while at < len(counts):
        end = at + 1
        if counts[at] > per:
            ways = math.ceil(counts[at] / per)
            of[at] = len(ranges), ways
            ranges += [(at * width, width - 1)] * ways
        else:
            while end < len(counts) and counts[end] <= per:
                end += 1
            reach = np.cumsum(counts[at:end])
            parts = max(1, round(reach[-1] / per))
            part = np.minimum(parts - 1, (reach - np.array(counts[at:end]) / 2) * parts // max(1, reach[-1])).astype(np.int64)
            for own in np.unique(part).tolist() if reach[-1] else []:
                first, last = at + np.flatnonzero(part == own)[[0, -1]]
                of[first : last + 1, 0] = len(ranges)
                ranges.append((int(first) * width, int(last - first + 1) * width - 1))
        at = end
    return of, ranges


def packs(batches, of):
    """Rules (keyword, rule_id, resource, code of the keyword) by part, many in a compressed row."""
    options, held, size = pa.ipc.IpcWriteOptions(compression="zstd"), [], 0

    def packed(held):
        rules = pa.Table.from_batches(held).combine_chunks()
        slot = slots_of(rules.column(0).combine_chunks())
        part = of[slot, 0] + np.remainder(rules.column(3).to_numpy(), of[slot, 1])
        rules = rules.select([0, 1, 2]).take(pa.array(np.argsort(part, kind="stable")))
        counts = np.bincount(part)
        parts = np.flatnonzero(counts)
        rows = []
        for end, many in zip(np.cumsum(counts)[parts].tolist(), counts[parts].tolist()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rules.schema, options=options) as writer:
                writer.write_table(rules.slice(end - many, many).combine_chunks())
            rows.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(rows, pa.binary())], names=["part", "pack"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACK_RULES:
            yield packed(held)
            held, size = [], 0
    if size:
        yield packed(held)
    held = batch = None
    let_go()


def shares(batches):
    """(part, tables of about SHARE_RULES rules of it, and at most half as many more), out of packs."""
    held, size, of = [], 0, None
    for batch in batches:
        for part, pack in zip(batch.column(0).to_pylist(), batch.column(1)):
            more = pa.ipc.open_stream(pack.as_buffer()).read_all()
            if size and (part != of or size + more.num_rows > SHARE_RULES * 3 // 2):
                full, held, size = held, [], 0
                yield of, full
            held.append(more)
            size += more.num_rows
            of = part
    if size:
        del batch, pack, more
        yield of, held


def _spread(logs, like, counts, out, totals):
    folder, columns = run_dir(logs.sparkSession, "lines"), out.names[1:]
    needed = list(dict.fromkeys([*columns, "log", "resource"]))
    names = stored(logs.where("log is not null").select(*needed), folder)
    cores, total = logs.sparkSession.sparkContext.defaultParallelism, sum(counts)
    # Each task passes all lines, so that they end together if they come to as many for each core.
    tasks = max(1, min(cores, total // LEAST_RULES), math.ceil(total / SHARE_RULES / cores) * cores if total > SHARE_RULES * cores else 0)

    def rows(known):
        for batch in lines_of(folder, names):
            lines, resources, shown = batch["log"], batch["resource"], batch.select(columns)
            wide = max(64, -(-shown.nbytes // batch.num_rows), int(pc.max(pc.binary_length(lines)).as_py()) if "log" in columns else 0)
            for line, rule in known.hits(lines, resources, max(1, OUT_BYTES // wide)):
                if len(line):
                    own = shown.take(pa.array(line))
                    yield pa.RecordBatch.from_arrays([known.rule_ids.take(pa.array(rule)), *own.columns], names=out.names)

    def sums(known):
        found = Sums(known)
        for batch in lines_of(folder, names):
            yield from found.add(batch)
        yield from found.rows()

    def run(batches):
        for part, tables in shares(batches):
            yield from (rows if totals is None else sums)(Share(tables, *ranges[part]))

    of, ranges = dealing(counts, tasks)
    told = like.select("keyword", "rule_id", "resource", F.xxhash64("keyword").alias("code"))
    packed = told.mapInArrow(lambda batches: packs(batches, of), "part int, pack binary")
    dealt = packed.repartitionById(max(1, len(ranges)), F.col("part"))
    return dealt.mapInArrow(run, out if totals is None else "rule_id string, hits long, first long, total long")
