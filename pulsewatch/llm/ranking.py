"""Ranked lexical search: best-first intervals of documents under range maxima of posting lists.

The index is a table of segments, each the posting lists of some tens of MB of text, its documents
numbered in order of doc_id. A query starts with the whole segment as one interval. What an interval
can score is at most the sum, over the query's terms, of the greatest impact a posting of the term
has in it, which a sparse table gives in two lookups. The interval with the highest bound is split
at the document of the greatest single impact, which is scored; short intervals are scored whole.
The search of a segment ends when no bound reaches the k best scores found.
"""

import heapq
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsewatch.llm.common import read, stored
from pulsewatch.llm.files import parquet_batches
from pulsewatch.operators.sizing import salted_join
from pulsewatch.session import run_dir

# Fixed values of the contract: term characters, weights, impacts and length normalisation.
TERM_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
TF_SCALE = 1000
LENGTH_SCALE = 8
LENGTH_PERCENT = 90
RESULTS = 10

SEGMENT_BYTES = 32 * 1024 * 1024
LEAF_DOCS = 512
QUERY_BATCH = 500
SEGMENT = "n_docs long, n_terms long, ids binary, no_id long, lengths binary, terms array<string>, dfs array<int>, docs binary, tfs binary"


def terms_of(raw):
    """The terms of UTF-8 bytes: runs of letters and digits, bytes past ASCII among them."""
    return raw.translate(TERM_BYTES).split()


class Segment:
    """Documents gathered for one segment of the index."""

    def __init__(self):
        self.vocabulary = defaultdict(count().__next__)
        self.ids, self.lengths, self.terms, self.tfs, self.bytes = [], [], [], [], 0

    def add(self, doc, raw):
        words = terms_of(raw)
        self.bytes += len(raw)
        if not words:
            return
        counted = Counter(words)
        self.ids.append(doc)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, counted), np.int32, len(counted)))
        self.tfs.append(np.fromiter(counted.values(), np.int32, len(counted)))

    def row(self):
        """Documents in order of id, null last; postings by term and document."""
        n = len(self.ids)
        ids = np.array([x or 0 for x in self.ids], np.int64)
        without = np.array([x is None for x in self.ids])
        order = np.lexsort((ids, without))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        terms = np.concatenate(self.terms).astype(np.int64)
        docs = np.repeat(place, [len(t) for t in self.terms])
        by_term = np.argsort(terms * n + docs)
        lengths = np.array(self.lengths, np.int64)[order]
        return {
            "n_docs": n,
            "n_terms": int(lengths.sum()),
            "ids": ids[order].tobytes(),
            "no_id": int(without.sum()),
            "lengths": lengths.tobytes(),
            "terms": [w.decode() for w in self.vocabulary],
            "dfs": np.bincount(terms, minlength=len(self.vocabulary)).tolist(),
            "docs": docs[by_term].astype(np.int32).tobytes(),
            "tfs": np.concatenate(self.tfs)[by_term].tobytes(),
        }


def build_index(docs, id_col="doc_id", text_col="text", segment_bytes=SEGMENT_BYTES):
    """The segments of all documents, as a table in the shared folder.

    Every row is a document; null texts and texts without terms are in no segment, since nothing
    finds them. Texts are not shuffled: a segment holds consecutive rows of a scan task, until
    they come to `segment_bytes` of text. Further columns are ignored.
    """

    def run(batches):
        schema = pa.schema(
            [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("no_id", pa.int64()), ("lengths", pa.binary())]
            + [("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())]
        )
        segment = Segment()
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                segment.add(doc, raw)
                if segment.bytes >= segment_bytes:
                    if segment.ids:
                        yield pa.RecordBatch.from_pylist([segment.row()], schema)
                    segment = Segment()
        if segment.ids:
            yield pa.RecordBatch.from_pylist([segment.row()], schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw")).where("raw is not null")
    return stored(rows.mapInArrow(run, SEGMENT), "postings")


def weighted_queries(index, items, item_col="item_id", text_col="text"):
    """Path of a table of queries: query, item_id, and its terms that some document holds with their weights.

    Rows of one id and one set of terms are one query.
    """
    n_docs = index.agg(F.sum("n_docs")).first()[0] or 0

    def run(batches):
        for batch in batches:
            own = [[w.decode() for w in sorted(set(terms_of(raw or b"")))] for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["item_id", "terms"])

    raw = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("raw"))
    asked = raw.mapInArrow(run, "item_id long, terms array<string>").distinct()
    asked = asked.withColumn("query", F.sha2(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "terms"), 256))
    asked = asked.select("query", "item_id", F.explode("terms").alias("term"))
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy(F.col("p.terms").alias("term"))
    ratio = F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)
    weights = held.agg(F.sum("p.dfs").alias("df")).select("term", F.floor(WEIGHT_SCALE * F.log(ratio)).cast("long").alias("weight"))
    known = salted_join(asked, weights.where("weight > 0"), ["term"])
    queries = known.groupBy("query", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    path = run_dir(index.sparkSession, "llm-queries")
    queries.select("query", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")).write.parquet(path)
    return path


class Lists:
    """Posting lists of some terms of a segment, end to end, under one sparse table.

    Row j of the table holds for each place the first greatest impact among the 2^j places from
    there on. Stretches that would reach into the next list are never asked for.
    """

    def __init__(self, numbers, starts, ends, docs, impacts, n_docs):
        sizes = ends[numbers] - starts[numbers]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        at = np.repeat(starts[numbers] - self.starts, sizes) + np.arange(sizes.sum())
        self.docs, self.impacts = docs[at].astype(np.int64), impacts[at]
        self.n_docs = n_docs
        self.keys = np.repeat(np.arange(len(numbers)), sizes) * n_docs + self.docs
        longest = int(sizes.max(initial=1))
        self.level = np.zeros(longest + 1, np.int64)
        for j in range(1, longest.bit_length()):
            self.level[1 << j :] = j
        self.table = np.zeros((longest.bit_length(), len(at)), np.int32)
        self.table[0] = np.arange(len(at))
        for j in range(1, longest.bit_length()):
            half, whole = 1 << (j - 1), 1 << j
            a, b = self.table[j - 1, : len(at) - whole + 1], self.table[j - 1, half : len(at) - whole + 1 + half]
            self.table[j, : len(at) - whole + 1] = np.where(self.impacts[a] >= self.impacts[b], a, b)

    def maxima(self, low, high):
        """Places of the greatest impact in [low, high) of each list; none may be empty."""
        level = self.level[high - low]
        a, b = self.table[level, low], self.table[level, high - (1 << level)]
        return np.where(self.impacts[a] >= self.impacts[b], a, b)


def search(lists, numbers, weights, k, floor=0, leaf=LEAF_DOCS):
    """The k best (score, document) of a segment, equal scores by document; scores of at least 1
    and at least `floor`.

    `numbers` are the query's lists, `weights` their weights.
    """
    best = []  # (score, -document), the worst first

    def offer(score, doc):
        if score >= max(floor, 1):
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            elif (score, -doc) > best[0]:
                heapq.heapreplace(best, (score, -doc))

    def hopeless(bound, first):
        return bound < max(floor, 1) or (len(best) == k and (bound, -first) < best[0])

    heap = []

    def put(first, last, own, low, high):
        some = high > low
        own, low, high = own[some], low[some], high[some]
        if len(own):
            top = lists.maxima(low, high)
            gains = weights[own] * lists.impacts[top]
            bound = int(gains.sum())
            if not hopeless(bound, first):
                heapq.heappush(heap, (-bound, first, last, own, low, high, int(lists.docs[top[gains.argmax()]])))

    put(0, lists.n_docs, np.arange(len(numbers)), lists.starts[numbers], lists.ends[numbers])
    while heap:
        bound, first, last, own, low, high, split = heapq.heappop(heap)
        if hopeless(-bound, first):
            if len(best) < k or -bound < best[0][0]:
                break
            continue
        if last - first <= leaf:
            sizes = high - low
            ends = np.cumsum(sizes)
            at = np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])
            scores = np.zeros(last - first, np.int64)
            np.add.at(scores, lists.docs[at] - first, np.repeat(weights[own], sizes) * lists.impacts[at])
            reach = max(floor, 1, best[0][0] if len(best) == k else 0)
            for doc in np.flatnonzero(scores >= reach).tolist():
                offer(int(scores[doc]), doc + first)
            continue
        at = np.searchsorted(lists.keys, numbers[own] * lists.n_docs + split)
        at = np.clip(at, low, high)
        held = (at < high) & (lists.docs[np.minimum(at, len(lists.docs) - 1)] == split)
        offer(int((weights[own[held]] * lists.impacts[at[held]]).sum()), split)
        put(first, split, own, low, at)
        put(split + 1, last, own, at + held, high)
    return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def ranked(index, queries, k=RESULTS, leaf=LEAF_DOCS):
    """item_id, rank, doc_id and score of the k best documents of each query.

    `index` is a table of `build_index`, `queries` a path of `weighted_queries`, which tasks read
    batch by batch. Equal scores are ranked by doc_id, null last; each row of a repeated
    document counts as one of its own. Queries without a known term have no rows.
    """
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 1

    def segment_of(row):
        lengths = np.frombuffer(row["lengths"], np.int64)
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        norms = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * n_docs) // n_terms
        impacts = (IMPACT_SCALE * tfs) // (TF_SCALE * tfs + LENGTH_SCALE * norms[docs])
        ends = np.cumsum(np.array(row["dfs"], np.int64))
        starts = ends - np.array(row["dfs"], np.int64)
        return {w: i for i, w in enumerate(row["terms"])}, starts, ends, docs, impacts

    def run(batches):
        reached = np.zeros((0, k), np.int64)  # the best scores of each query in this task
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                number, starts, ends, docs, impacts = segment_of(row)
                ids = np.frombuffer(row["ids"], np.int64)
                known = row["n_docs"] - row["no_id"]
                at, out = 0, []
                for asked in parquet_batches(queries, ["query", "item_id", "terms", "weights"], QUERY_BATCH):
                    asked = asked.to_pylist()
                    if at + len(asked) > len(reached):
                        reached = np.r_[reached, np.zeros((at + len(asked) - len(reached), k), np.int64)]
                    used = sorted({number[t] for q in asked for t in q["terms"] if t in number})
                    if used:
                        place = {t: i for i, t in enumerate(used)}
                        lists = Lists(np.array(used), starts, ends, docs, impacts, row["n_docs"])
                        for i, q in enumerate(asked, at):
                            own = [(place[number[t]], w) for t, w in zip(q["terms"], q["weights"]) if t in number]
                            if not own:
                                continue
                            terms, weights = np.array(own, np.int64).T
                            found = search(lists, terms, weights, k, int(reached[i].min()), leaf)
                            reached[i] = np.sort(np.r_[reached[i], [s for s, _ in found]])[-k:]
                            out += [(q["query"], q["item_id"], int(ids[d]) if d < known else None, s) for s, d in found]
                    at += len(asked)
                if out:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["query", "item_id", "doc_id", "score"]
                    )

    found = index.mapInArrow(run, "query string, item_id long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs, items, k=RESULTS, segment_bytes=SEGMENT_BYTES, leaf=LEAF_DOCS):
    """The k best documents for each item by its distinct terms: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and characters past ASCII; A-Z is lower-cased. Null and
    empty texts hold no terms and are neither counted nor found; whole texts count, of any
    length. Items without known terms have no rows, and equal items are asked once. Null doc_ids
    rank last among equals. Empty tables give an empty result.
    """
    index = build_index(docs, segment_bytes=segment_bytes)
    return ranked(index, weighted_queries(index, items), k, leaf)


def op12_ranked_search(spark, sf_dir):
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({FOLD}, '{TERM}') AS terms FROM documents WHERE text IS NOT NULL
), held AS (
  SELECT row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held
), p AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM held) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
  FROM p, totals GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(list_sort(list_distinct(terms))) AS term, list_sort(list_distinct(terms)) AS terms
  FROM (SELECT item_id, regexp_extract_all({FOLD}, '{TERM}') AS terms FROM benchmark WHERE text IS NOT NULL)
), scored AS (
  SELECT item_id, asked.terms, row, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS score
  FROM asked JOIN weights USING (term) JOIN p USING (term) JOIN held USING (row), totals
  GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id, terms ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY rank <= {RESULTS}
"""
