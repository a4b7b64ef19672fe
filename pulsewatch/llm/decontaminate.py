"""Benchmark items in documents, up to a few edits: pieces found exactly, then Myers' distance.

An item of m characters may be matched with e = rate * m edits. Cut into e + 1 pieces, at
least one is left whole, so every match holds an exact piece at about its own offset. All
pieces of all items are searched at once; around each hit the bit-parallel distance decides.
"""

import math
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

from pulsewatch.llm.common import read, stored
from pulsewatch.llm.files import parquet_batches
from pulsewatch.session import run_dir

RATE = 0.08
ITEM_BYTES = 8 * 1024 * 1024
READ_ROWS = 10_000


def plain(text):
    """Lower case, white space runs as one blank."""
    return " ".join((text or "").lower().split())


def budget(item, rate):
    return int(len(item) * rate)


def pieces(item, edits):
    """(offset, piece) of edits + 1 pieces of near-equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_end(pattern, text, limit):
    """(distance, end) of the best match of the pattern anywhere in the text, or None.

    Myers' bit vectors of one column of the edit matrix, on integers of any length. Of
    equal distances the first end counts.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    plus, minus, score = full, 0, m
    best = (m, 0) if m <= limit else None
    for at, c in enumerate(text, 1):
        match = masks.get(c, 0)
        vertical = match | minus
        x = (((match & plus) + plus) ^ plus) | match
        up = minus | (full & ~(x | plus))
        down = plus & x
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score <= limit and (best is None or score < best[0]):
            best = (score, at)
    return best


class Items:
    """Items ready for searching; built once in each task."""

    def __init__(self, items, rate):
        self.items = [(i, plain(t)) for i, t in items]
        self.edits = [budget(t, rate) for _, t in self.items]
        where = defaultdict(list)
        for n, (_, item) in enumerate(self.items):
            if item:
                for offset, piece in pieces(item, self.edits[n]):
                    where[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def matches(self, text):
        """(item_id, distance, start, end) of each item found in the plain text."""
        if not self.any:
            return
        regions = defaultdict(list)
        for last, (length, owners) in self.automaton.iter(text):
            for n, offset in owners:
                start = last + 1 - length - offset
                e, m = self.edits[n], len(self.items[n][1])
                to = regions[n]
                # Hits come in order of their ends, so a region starts little before the last one.
                if to and start - e <= to[-1][1]:
                    to[-1][0] = min(to[-1][0], start - e)
                    to[-1][1] = max(to[-1][1], start + m + e)
                else:
                    to.append([start - e, start + m + e])
        for n, spans in regions.items():
            name, item = self.items[n]
            best = None
            for a, b in spans:
                a = max(0, a)
                found = best_end(item, text[a:b], self.edits[n])
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], a + found[1], a)
            if best:
                distance, end, low = best
                # The same backwards from the end gives the start.
                back = best_end(item[::-1], text[low:end][::-1], distance)
                yield name, distance, end - back[1], end


def groups_of(benchmark, item_id, item_text, most_bytes):
    """Paths of the distinct items in the shared folder, in groups of about `most_bytes`, each to be read
    by the tasks of one pass. No item passes through the driver, and an item over that size is a group's only
    large one."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    distinct = stored(rows.groupBy("i", "t").agg(F.count(F.lit(1)).alias("copies")), "items")
    total = distinct.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / most_bytes))
    path = run_dir(benchmark.sparkSession, "llm-item-groups")
    dealt = distinct.withColumn("g", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    dealt.repartition("g").write.partitionBy("g").parquet(path)
    return [f"{path}/g={g}" for g in range(n)]


def items_of(path, rate):
    """In a task: the items of a group, ready for searching, and how often each stands in the benchmark."""
    rows = [r for batch in parquet_batches(path, ["i", "t", "copies"], READ_ROWS) for r in batch.to_pylist()]
    rows.sort(key=lambda r: (r["i"] is not None, r["i"] or 0, r["t"]))
    return Items([((r["i"], r["copies"]), r["t"]) for r in rows], rate)


def find_items(docs, benchmark, rate=RATE, most_bytes=ITEM_BYTES, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"):
    """doc_id, item_id, distance, start, end: the items found in each document.

    One row for a row of `docs` and a row of `benchmark`, with its best match: distance is
    the least number of edits (at most rate * length of the item), start and end count
    characters of the document in lower case with white space runs as one blank; of equal
    matches the first counts. Null, empty and blank texts and items match nothing. Equal
    documents and equal items are found each; null ids are kept; further columns are ignored.
    Tasks read the items from the shared folder, in groups of about `most_bytes`, a pass over the
    documents each; equal items are searched once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for group in groups_of(benchmark, item_id, item_text, most_bytes):
        one = rows.mapInArrow(search(group, rate), SCHEMA)
        found = one if found is None else found.union(one)
    return found


SCHEMA = "doc_id long, item_id long, distance long, start long, end long"


def search(path, rate):
    def run(batches):
        items = items_of(path, rate)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for (item, copies), *found in items.matches(plain(text)):
                    out += [(doc, item, *found)] * copies
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def clean(docs, benchmark, rate=RATE, most_bytes=ITEM_BYTES, text_col="text", item_id="item_id", item_text="text"):
    """The rows of `docs`, all columns, in whose text no item is found (see `find_items`)."""
    at = docs.columns.index(text_col)
    for group in groups_of(benchmark, item_id, item_text, most_bytes):

        def keep(batches, group=group):
            items = items_of(group, rate)
            for batch in batches:
                hit = [next(items.matches(plain(t)), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(hit, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op8_decontamination(spark, sf_dir):
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
