"""Near-duplicate vectors by NN-descent.

A neighbour graph over the distinct directions starts from random hyperplane buckets and is
refined in rounds: at every vector, its neighbours and those that name it as theirs are
compared with each other, and each keeps its best. A vector whose whole list is near enough
to link (a saturated list) may have more such neighbours than the list holds; its list is
enlarged to the component it is linked into, which is compared in full, in tiles. Components
with such lists are compared with each other too, as far as their pivots and radii let any two
of their vectors link. Recall is audited against a comparison of fixed query vectors with all
others.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsewatch.llm.common import components, parallelism, read, stored

THRESHOLD = 0.95
LIST = 12
TREES = 8
BUCKET = 48
MOST_BUCKET = 1_024
ROUNDS = 6
SETTLED = 0.002
AUDIT_EVERY = 50
LEAST_RECALL = 0.9
TILE = 1_024
PIVOTS = 4_096
QUERIES = 4_096
SLACK = 1e-6
SEED = 20240229


def matrix(column):
    """Rows of equal-length lists as a matrix."""
    chunk = column.combine_chunks()
    if isinstance(chunk, pa.ChunkedArray):
        chunk = chunk.chunk(0)
    flat = chunk.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(chunk), -1).astype(np.float64)


def unit_vectors(frame, id_col, vector_col):
    """vec_id, unit (double) and dim of usable vectors; the others have a null unit."""
    names = "vec_id long, unit array<double>, dim int"

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                ok = x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x)
                v = np.array(x, float) if ok else None
                # Scaled first, so that no square overflows or vanishes.
                top = np.abs(v).max() if ok else 0.0
                v = v / top if top else None
                out.append(None if v is None else v / np.sqrt(v @ v) + 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.float64())), pa.array([0 if v is None else len(v) for v in out], pa.int32())],
                ["vec_id", "unit", "dim"],
            )

    return frame.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, names)


def planes(dim, trees, bits):
    return np.random.default_rng([SEED, dim]).standard_normal((trees, bits, dim))


def with_buckets(nodes, trees, bits, deeper):
    """One row per node and tree: the bucket of its hyperplane signs, and more signs to split it by."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = np.array(table.column("dim").to_pylist())
            for d in np.unique(dims):
                own = table.filter(pa.array(dims == d))
                sides = np.einsum("tbd,nd->tnb", planes(int(d), trees, bits + deeper), matrix(own.column("unit"))) > 0
                weight = 1 << np.arange(bits + deeper, dtype=np.int64)
                for t in range(trees):
                    key = sides[t][:, :bits] @ weight[:bits]
                    rest = sides[t][:, bits:] @ weight[:deeper]
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.column("node").combine_chunks(),
                            pa.array([f"{d}:{t}:{k}" for k in key.tolist()]),
                            pa.array(rest, pa.int64()),
                        ],
                        ["node", "bucket", "rest"],
                    )

    return nodes.select("node", "unit", "dim").mapInArrow(run, "node long, bucket string, rest long")


def best_of(names, vectors, k):
    """For each vector, its k best others here: (node, [neighbours], [cosines])."""
    n = len(names)
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -2)
    k = min(k, n - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((n, 0), int)
    return [(names[i], [names[j] for j in at[i]], sims[i, at[i]].tolist()) for i in range(n)]


LISTS = "node long, near array<long>, cosine array<double>"


def lists_table(out):
    columns = list(zip(*out)) if out else [[], [], []]
    kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["node", "near", "cosine"])


def first_graph(nodes, count, k, trees):
    bits = max(1, math.ceil(math.log2(max(2, count / BUCKET))))
    placed = stored(with_buckets(nodes, trees, bits, 10), "buckets")
    # A bucket that is too full is split by further signs, and by chance where those agree.
    size = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    finer = placed.join(size, "bucket").withColumn("size", F.col("size").cast("double"))
    more = F.when(F.col("size") > MOST_BUCKET, F.pmod("rest", F.pow(F.lit(2.0), F.least(F.lit(10.0), F.ceil(F.log2(F.col("size") / BUCKET)))).cast("long"))).otherwise(0)
    finer = finer.withColumn("bucket", F.concat_ws(":", "bucket", more.cast("string"))).drop("size")
    again = finer.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    pieces = F.ceil(F.col("size") / MOST_BUCKET)
    finer = finer.join(again, "bucket").withColumn("bucket", F.concat_ws(":", "bucket", F.pmod(F.xxhash64("node", "bucket"), pieces)))
    task = F.pmod(F.xxhash64("bucket"), F.lit(8 * parallelism(nodes.sparkSession)))

    def compare(table):
        out = []
        names, buckets = table.column("node").to_pylist(), table.column("bucket").to_pylist()
        vectors = [np.array(v) for v in table.column("unit").to_pylist()]
        of = {}
        for i, b in enumerate(buckets):
            of.setdefault(b, []).append(i)
        for own in of.values():
            if len(own) > 1:
                out += best_of([names[i] for i in own], np.stack([vectors[i] for i in own]), k)
        return lists_table(out)

    slim = finer.join(nodes.select("node", "unit"), "node").select("node", "unit", "bucket", task.alias("task"))
    return slim.groupBy("task").applyInArrow(compare, LISTS)


def merged_lists(lists, k):
    """The k best distinct neighbours over all lists of a node."""
    parts = F.pmod(F.xxhash64("node"), F.lit(8 * parallelism(lists.sparkSession)))

    def merge(table):
        of = {}
        for node, near, cosine in zip(*(table.column(c).to_pylist() for c in ("node", "near", "cosine"))):
            of.setdefault(node, {}).update(zip(near, cosine))
        out = []
        for node, found in of.items():
            top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
            out.append((node, [n for n, _ in top], [c for _, c in top]))
        return lists_table(out)

    return lists.withColumn("task", parts).groupBy("task").applyInArrow(merge, LISTS)


def local_join(graph, nodes, k, fresh):
    """Lists that neighbours-of-neighbours give: at every node those near it meet each other.

    Both directions of a list's entries meet, of the reverse ones the 2 k best. A node where
    nothing changed since the last round has nothing new to compare and sits out.
    """
    edges = graph.join(fresh, "node", "left").select(
        "node", F.explode(F.arrays_zip("near", "cosine")).alias("e"), F.coalesce("fresh", F.lit(False)).alias("fresh")
    )
    edges = edges.select("node", F.col("e.near").alias("other"), F.col("e.cosine").alias("cosine"), "fresh")
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "cosine", "fresh")
    task = F.pmod(F.xxhash64("node"), F.lit(8 * parallelism(graph.sparkSession)))
    both = edges.select("node", "other", "cosine", "fresh", F.lit(True).alias("own")).union(
        back.select("node", "other", "cosine", "fresh", F.lit(False).alias("own"))
    )
    worst = F.when(F.size("near") >= k, F.array_min("cosine")).otherwise(F.lit(-2.0))
    known = graph.select(F.col("node").alias("other"), F.col("near").alias("known"), worst.alias("worst"))
    vectors_of = nodes.select(F.col("node").alias("other"), "unit").join(known, "other")
    met = both.join(vectors_of, "other").withColumn("task", task)

    def compare(table):
        cols = {c: table.column(c).to_pylist() for c in ("node", "other", "cosine", "fresh", "own", "known", "worst")}
        vectors = matrix(table.column("unit")) if table.num_rows else None
        of = {}
        for i, node in enumerate(cols["node"]):
            of.setdefault(node, []).append(i)
        out = []
        for rows in of.values():
            if not any(cols["fresh"][i] for i in rows):
                continue
            reverse = sorted((i for i in rows if not cols["own"][i]), key=lambda i: -cols["cosine"][i])[: 2 * k]
            own = {cols["other"][i]: i for i in [i for i in rows if cols["own"][i]] + reverse}
            if len(own) > 1:
                at, names = list(own.values()), list(own)
                sims = vectors[at] @ vectors[at].T
                np.fill_diagonal(sims, -2)
                # Only what its list has not, and what is better than its worst entry, goes back.
                for a, i in enumerate(at):
                    better = np.flatnonzero(sims[a] > cols["worst"][i])
                    if len(better) > k:
                        better = better[np.argpartition(-sims[a, better], k - 1)[:k]]
                    new = [b for b in better.tolist() if names[b] not in cols["known"][i]]
                    if new:
                        out.append((names[a], [names[b] for b in new], sims[a, new].tolist()))
        return lists_table(out)

    return met.groupBy("task").applyInArrow(compare, LISTS)


def descend(nodes, count, k=LIST, trees=TREES, rounds=ROUNDS, settled=SETTLED):
    graph = stored(merged_lists(first_graph(nodes, count, k, trees), k), "graph")
    fresh = graph.select("node", F.lit(True).alias("fresh"))
    for _ in range(rounds):
        new = stored(merged_lists(graph.union(local_join(graph, nodes, k, fresh)), k), "graph")
        old = graph.select("node", F.col("near").alias("was"))
        changes = new.join(old, "node", "left").select("node", F.size(F.array_except("near", F.coalesce("was", F.array().cast("array<long>")))).alias("n"))
        changes = stored(changes.where("n > 0"), "changes")
        graph, fresh = new, changes.select("node", F.lit(True).alias("fresh"))
        if (changes.agg(F.sum("n")).first()[0] or 0) <= settled * k * count:
            break
    return graph


def tiled_links(nodes, groups, threshold, tile=TILE):
    """Within each group: (node, parent, links, weight of links), all pairs compared in tiles."""
    member = groups.join(nodes.select("node", "unit", "copies"), "node")
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.ceil(F.col("size") / tile)
    cut = member.join(size, "group").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    buckets = 8 * parallelism(nodes.sparkSession)
    with_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = cut.withColumn("with", with_).withColumn(
        "task",
        F.when(F.col("tiles") == 1, F.concat(F.lit("all:"), F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("string"))).otherwise(
            F.concat_ws(":", F.col("group").cast("string"), F.least("tile", "with"), F.greatest("tile", "with"))
        ),
    )

    def compare(table):
        cols = {c: table.column(c).to_pylist() for c in ("group", "node", "copies", "tile")}
        task = table.column("task")[0].as_py().split(":")
        units = table.column("unit").to_pylist()
        of = {}
        for i, g in enumerate(cols["group"]):
            of.setdefault(g, []).append(i)
        out = []
        for own in of.values():
            left = right = own
            if task[0] != "all" and task[1] != task[2]:
                left, right = ([i for i in own if cols["tile"][i] == int(t)] for t in task[1:])
            if not left or not right:
                continue
            hit = np.array([units[i] for i in left]) @ np.array([units[i] for i in right]).T >= threshold
            if left is right:
                np.fill_diagonal(hit, False)
            weight = [np.array([cols["copies"][i] for i in side]) for side in (left, right)]
            for side, other, rows, w in ((left, right, hit, weight[1]), (right, left, hit.T, weight[0])):
                first = np.argmax(rows, axis=1)
                total = rows @ w
                for a, i in enumerate(side):
                    if total[a]:
                        out.append((cols["node"][i], cols["node"][other[first[a]]], int(total[a])))
                if left is right:
                    break
            # The first partner of each alone might leave a group in parts: its tree closes them.
            names = [cols["node"][i] for i in [*left, *([] if left is right else right)]]
            label = np.arange(len(names))
            shift = 0 if left is right else len(left)
            for a, row in enumerate(hit):
                met = np.unique(label[np.r_[a, np.flatnonzero(row) + shift]])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            out += [(names[a], names[label[a]], 0) for a in np.flatnonzero(label != np.arange(len(names)))]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["src", "dst", "links"])

    slim = met.select("task", "group", "node", "copies", "tile", "unit")
    return slim.groupBy("task").applyInArrow(compare, "src long, dst long, links long")


def near_duplicates(frame, threshold=THRESHOLD, k=LIST, trees=TREES, rounds=ROUNDS, least_recall=LEAST_RECALL, id_col="vec_id", vector_col="embedding"):
    """vec_id, n_links, component_id and kept of every row.

    Two vectors link when the cosine of their double-precision units is at least
    `threshold`; n_links counts a vector's direct links, component_id is the smallest vec_id
    that links lead to, and kept says whether that is its own. Null, empty and zero vectors
    and those with null or non-finite components link with nothing; vectors of different
    lengths are not compared. Equal vectors link. Null ids are kept, and stand for a
    component only if it has no other. Further columns are ignored; an empty table gives an
    empty result. The links found are audited (see `recall`); below `least_recall` lists and
    trees are doubled and the search starts again.
    """
    rows = stored(unit_vectors(frame, id_col, vector_col), "units")
    same = rows.where("unit is not null").groupBy("unit", "dim").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.coalesce(F.max(F.col("vec_id") % AUDIT_EVERY == 0), F.lit(False)).alias("asked")
    )
    nodes = stored(same.withColumn("node", F.xxhash64("unit")), "nodes")
    count = nodes.count()
    found = frame.sparkSession.createDataFrame([], "src long, dst long, links long")
    while count > 1:
        found = linked(descend(nodes, count, k, trees, rounds), nodes, threshold)
        if recall(nodes, found, threshold) >= least_recall or k >= count:
            break
        k, trees = 2 * k, 2 * trees
    joined = components(found.select("src", "dst"), "linked").withColumnRenamed("component", "root")
    links = found.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "least", "copies").join(joined, "node", "left").join(links, "node", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "node")), "known")
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least, "root").select("node", "component", "copies", "links")
    out = rows.withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("unit"))).drop("unit")
    # Rows without a usable vector match nothing; a key of their own spreads them.
    out = out.withColumn("key", F.coalesce(F.col("node").cast("string"), F.concat(F.lit("none"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))))
    out = out.join(known.withColumn("key", F.col("node").cast("string")).drop("node"), "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def linked(graph, nodes, threshold):
    """The links within the components that the graph's near entries make, each compared in full."""
    edges = graph.select(F.col("node").alias("src"), F.explode(F.arrays_zip("near", "cosine")).alias("e"))
    # A hair below the threshold still binds a component; the links themselves are exact.
    edges = edges.where(F.col("e.cosine") >= threshold - SLACK).select("src", F.col("e.near").alias("dst"))
    groups = components(edges, "near").select("node", F.col("component").alias("group"))
    bridges = stored(outer_edges(graph, nodes, groups, threshold), "bridges")
    if not bridges.isEmpty():
        groups = components(edges.union(bridges), "near").select("node", F.col("component").alias("group"))
    return stored(tiled_links(nodes, groups, threshold), "links")


def outer_edges(graph, nodes, groups, threshold, tile=TILE):
    """Edges (src, dst) that join the components of saturated lists wherever two of their vectors link.

    A list that ends above the threshold may end before its links do, and a vector without a
    list was never compared. The components of such vectors are cut into pieces of about `tile`,
    each with a pivot and the angle to its farthest vector. Two pieces can link only if their
    pivots are no farther apart than both radii and the angle of the threshold; all those are
    compared in full.
    """
    open_ = F.col("least").isNull() | (F.col("least") >= threshold - SLACK)
    least = graph.select("node", F.array_min("cosine").alias("least"))
    member = nodes.select("node").join(groups, "node", "left").join(least, "node", "left")
    member = member.select("node", F.coalesce("group", "node").alias("group"), open_.alias("open"))
    size = member.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.max("open").alias("open")).where("open").drop("open")
    cut = member.drop("open").join(size, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / tile)))
    cut = cut.select("node", "group", F.xxhash64("group", "part").alias("piece"))
    cut = stored(cut.join(nodes.select("node", "unit", "dim"), "node"), "pieces")
    if cut.select("group").distinct().limit(2).count() < 2:
        return cut.sparkSession.createDataFrame([], "src long, dst long")
    pairs = stored(near_pieces(stored(cut.groupBy("piece").applyInArrow(pivot_of, PIVOT), "pivots"), threshold), "pairs")
    sizes = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("piece"))
    total = ends.join(sizes, "piece").agg(F.sum("n")).first()[0] or 0
    tasks = max(8 * parallelism(nodes.sparkSession), math.ceil(total / (4 * tile)))
    met = ends.join(cut.select("piece", "node", "unit"), "piece").withColumn("task", F.pmod(F.xxhash64("a", "b"), F.lit(tasks)))

    def compare(table):
        cols = {c: table.column(c).to_pylist() for c in ("a", "b", "piece", "node")}
        units = matrix_rows(table.column("unit"))
        of = {}
        for i, pair in enumerate(zip(cols["a"], cols["b"])):
            of.setdefault(pair, []).append(i)
        out = []
        for (a, b), own in of.items():
            left, right = ([i for i in own if cols["piece"][i] == x] for x in (a, b))
            hit = np.stack([units[i] for i in left]) @ np.stack([units[i] for i in right]).T >= threshold - SLACK
            if hit.any():
                i, j = np.unravel_index(np.argmax(hit), hit.shape)
                out.append((cols["node"][left[i]], cols["node"][right[j]]))
        columns = list(zip(*out)) if out else [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["src", "dst"])

    return met.groupBy("task").applyInArrow(compare, "src long, dst long")


PIVOT = "piece long, group long, dim int, pivot array<double>, radius double"


def matrix_rows(column):
    """Lists of doubles, of any lengths, as one array each."""
    return [x.values.to_numpy() for x in column.combine_chunks()]


def angles(cosines):
    return np.arccos(np.clip(cosines, -1, 1))


def pivot_of(table):
    """The direction of a piece's mean, and the angle to its farthest vector."""
    own = matrix(table.column("unit"))
    pivot = own.mean(0)
    length = np.sqrt(pivot @ pivot)
    pivot = pivot / length if length > 1e-6 else own[0]
    kinds = pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64()
    row = table.column("piece")[0].as_py(), table.column("group")[0].as_py(), own.shape[1], pivot.tolist(), float(angles(own @ pivot).max())
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds)], names=["piece", "group", "dim", "pivot", "radius"])


def near_pieces(pivots, threshold, block=PIVOTS):
    """Pairs (a, b) of pieces of different components whose vectors might link, compared in blocks."""
    blocks = max(1, math.ceil(pivots.count() / block))
    cut = pivots.withColumn("own", F.pmod(F.xxhash64("piece"), F.lit(blocks)))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    reach = float(angles(threshold - SLACK)) + SLACK

    def compare(key, table):
        low, high = (k.as_py() for k in key)
        names, groups, own, dims = (np.array(table.column(c).to_pylist()) for c in ("piece", "group", "own", "dim"))
        radius = table.column("radius").to_numpy()
        out = [np.zeros((0, 2), np.int64)]
        for d in np.unique(dims):
            left, right = (np.flatnonzero((dims == d) & (own == side)) for side in (low, high))
            if not len(left) or not len(right):
                continue
            there = matrix(table.column("pivot").take(pa.array(right)))
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                gap = angles(matrix(table.column("pivot").take(pa.array(some))) @ there.T)
                hit = (gap <= radius[some][:, None] + radius[right][None, :] + reach) & (groups[some][:, None] != groups[right][None, :])
                i, j = np.nonzero(hit)
                found = np.stack([names[some[i]], names[right[j]]], 1)
                # Within one block each pair shows up twice.
                out.append(found[found[:, 0] < found[:, 1]] if low == high else found)
        found = np.concatenate(out)
        return pa.table([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["a", "b"])

    cut = cut.withColumn("low", F.least("own", F.col("with").cast("long"))).withColumn("high", F.greatest("own", F.col("with").cast("long")))
    return cut.drop("with").groupBy("low", "high").applyInArrow(compare, "a long, b long")


def recall(nodes, found, threshold=THRESHOLD, every=AUDIT_EVERY, block=QUERIES):
    """The share of its links found of a query vector, on average over those that have links.

    Queries are all vectors of rows whose id is divisible by `every`; if there is none, those
    whose hash is, and if there is none either, all vectors. Blocks of about `block` queries
    are compared with all vectors in turn.
    """
    by_hash = F.pmod(F.xxhash64("node"), F.lit(every)) == 0
    for some in (F.col("asked"), by_hash, F.lit(True)):
        asked = nodes.where(some)
        count = asked.count()
        if count:
            break
    blocks = max(1, math.ceil(count / block))
    links = found.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    share, queries = 0.0, 0
    for number in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(blocks)) == number)
        true = true_links(nodes, own, threshold).join(links, "node", "left").where(F.col("true") > 0)
        sums = true.agg(F.sum(F.coalesce("links", F.lit(0)) / F.col("true")).alias("share"), F.count(F.lit(1)).alias("n")).first()
        share, queries = share + (sums["share"] or 0.0), queries + sums["n"]
    return share / queries if queries else 1.0


def true_links(nodes, asked, threshold):
    """(node, true) of query vectors few enough for the driver: their links to all other vectors."""
    table = asked.select("node", "unit", "dim").toArrow()
    ids, dims = table.column("node").to_numpy(), table.column("dim").to_numpy()
    by_dim = {int(d): (np.flatnonzero(dims == d), matrix(table.filter(pa.array(dims == d)).column("unit"))) for d in np.unique(dims)}
    shared = nodes.sparkSession.sparkContext.broadcast((ids, by_dim))

    def count(batches):
        ids, by_dim = shared.value
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            own_dims = np.array(rows.column("dim").to_pylist())
            for d, (at, units) in by_dim.items():
                own = rows.filter(pa.array(own_dims == d))
                for low in range(0, own.num_rows, TILE):
                    some = own.slice(low, TILE)
                    hit = units @ matrix(some.column("unit")).T >= threshold
                    n[at] += hit @ np.array(some.column("copies").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n)], ["node", "true"])

    true = nodes.select("unit", "dim", "copies").mapInArrow(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    # A query meets its own node, copies included, which is no link to another node.
    return true.join(nodes.select("node", "copies"), "node").select("node", (F.col("true") - F.col("copies")).alias("true"))


def op4_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "embeddings"))
