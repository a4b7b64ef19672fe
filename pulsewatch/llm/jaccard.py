"""Jaccard join on word shingles by token-combination prefixes.

Shingles fall into three classes by how many texts hold them: one (unique), up to
FREQUENT (rare), more (frequent). All texts order their shingles by (class, hash), rarest
first. Texts that link differ in few shingles, so the first one they share stands among
the first few of both:

- a rare one is indexed alone;
- where a frequent one could be first, all unique and rare ones of the text are among the
  differing few. Then the prefix is extended, and neighbouring frequent shingles in it are
  indexed as combinations of two: with d differing shingles and more than d + 1 shared
  ones in the extended prefix, two shared ones stand side by side in both texts.

A text with more unique shingles than may differ links with nothing and goes no further.
Sizes of texts that link differ by a limited factor, so a bucket is a signature within one
size class and the next. Only texts of one bucket are ever compared, in three steps:

1. each set with the first set of each of its buckets; sets that link so form clusters;
2. within a cluster, all sets with each other, as what is near one text is mostly near the others;
3. in buckets that reach over several clusters, sets of different ones: as pairs where a bucket
   has few sets outside its largest cluster, each pair once however many buckets it shares; in
   tiles where it has many, buckets with mostly the same sets together, a pair counting once.

Sets that meet in large numbers do so in tiles, size class by size class; only each set's number
of links and a spanning tree leave the task.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from pulsewatch.llm.common import block_count, block_rows, components, in_blocks, mixed, parallelism, read, stored
from pulsewatch.llm.substrings import Words
from pulsewatch.llm.superkmers import grams
from pulsewatch.operators.sizing import fits_broadcast, salted_join

FREQUENT = 64
SMALL_SET = 32
TILE = 512
#: Sets of a bucket outside its largest cluster up to which its pairs are listed.
SMALL_BUCKET = 64
#: In place of a bucket: pairs with a small bucket in common count there.
ALL_SMALL = -(1 << 63)
#: Pairs of one set that a task verifies.
HOT_PAIRS = 2_000


def shingle_sets(texts, width):
    """The sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z."""
    t = Words().tokens([x.lower() for x in texts])
    runs = grams(t.hashes, width) if len(t.hashes) >= width else np.zeros(0, np.uint64)
    out, at = [], 0
    for length in t.lengths:
        if length >= width:
            out.append(np.unique(runs[at : at + length - width + 1]))
        elif length:
            whole = grams(t.hashes[at : at + length], length)
            out.append(mixed(whole + np.uint64(length)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += length
    return out


def digest(tokens):
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def pack(ids, counts):
    """Sorted 32-bit numbers as differences in byte planes, next to small counts."""
    steps = np.diff(ids, prepend=np.uint32(0)).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + counts.astype(np.uint8).tobytes())


def unpack(blob):
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 5
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32), raw[4 * n :]


def keyed(tokens, ranges):
    """(range, low 32 bits) of each shingle: what classes are counted by."""
    return ((tokens >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64), tokens.astype(np.uint32)


def most_differing(n, num, den):
    """How many shingles at most a set of n does not share with one it links with, both ways."""
    return n * (den - num) // num


def signatures(tokens, klass, num, den):
    """What a set is indexed under: hashes of rare shingles and of pairs of frequent ones."""
    d = most_differing(len(tokens), num, den)
    if int((klass == 0).sum()) > d:
        return None
    order = np.lexsort((tokens, klass))
    tokens, klass = tokens[order], klass[order]
    prefix, kind = tokens[: d + 1], klass[: d + 1]
    alone = prefix[(kind == 1) | ((kind == 2) & (len(tokens) <= SMALL_SET))]
    out = [mixed(alone.copy())]
    first = int(np.searchsorted(klass, 2))
    if first <= d:
        extended = tokens[first : first + 2 * d + 2]
        out.append(mixed(extended[:-1] * np.uint64(0x9E3779B97F4A7C15) + extended[1:]))
    return np.unique(np.concatenate(out))


def shingled(docs, width, num, den, frequent, id_col, text_col):
    """doc_id, n_shingles, digest, and the set and signatures of what may link at all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = block_count(rows)
    dealt = in_blocks(rows, blocks)

    def distinct_sets(texts):
        sets = shingle_sets(texts, width)
        names = [digest(s) if len(s) else None for s in sets]
        return sets, names, {n: s for n, s in zip(names, sets) if n}

    def count(table):
        block = table.column("block")[0].as_py()
        own = distinct_sets(block_rows(table)[1])[2]
        of, ids = keyed(np.concatenate([np.zeros(0, np.uint64), *own.values()]), blocks)
        key, n = np.unique(of << 32 | ids, return_counts=True)
        of, ids = key >> 32, key.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(of)) + 1
        parts = np.split(np.arange(len(key)), cuts) if len(key) else []
        return pa.table(
            {
                "block": pa.array([block] * len(parts), pa.int32()),
                "range": pa.array([int(of[p[0]]) for p in parts], pa.int32()),
                "packed": pa.array([pack(ids[p], np.minimum(n[p], 255)) for p in parts], pa.binary()),
            }
        )

    def classify(table):
        of = table.column("range")[0].as_py()
        sent = [unpack(x) for x in table.column("packed").to_pylist()]
        ids = np.concatenate([i for i, _ in sent])
        key, where = np.unique(ids, return_inverse=True)
        total = np.bincount(where, np.concatenate([n for _, n in sent]))
        klass = (total > 1).astype(np.uint8) + (total > frequent)
        mine = np.split(klass[where], np.cumsum([len(i) for i, _ in sent])[:-1])
        return pa.table(
            {
                "block": table.column("block"),
                "range": pa.array([of] * len(sent), pa.int32()),
                "packed": pa.array([pack(i[k > 0], k[k > 0]) for (i, _), k in zip(sent, mine)], pa.binary()),
            }
        )

    def finish(texts, classes):
        if not texts.num_rows:
            return made([])
        ids, whole = block_rows(texts)
        sets, names, own = distinct_sets(whole)
        keys, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for of, blob in zip(classes.column("range").to_pylist(), classes.column("packed").to_pylist()):
            low, kind = unpack(blob)
            keys.append(low.astype(np.int64) | of << 32)
            kinds.append(kind)
        keys, kinds = np.concatenate(keys), np.concatenate(kinds)
        order = np.argsort(keys)
        keys, kinds = np.r_[keys[order], np.int64(-1)], np.r_[kinds[order], np.uint8(0)]
        sent, out = set(), []
        for i, text, name, tokens in zip(ids, whole, names, sets):
            signs = None
            if name and name not in sent:
                sent.add(name)
                of, low = keyed(tokens, blocks)
                key = of << 32 | low
                at = np.searchsorted(keys[:-1], key)
                signs = signatures(tokens, np.where(keys[at] == key, kinds[at], 0), num, den)
            shown = signs is not None and len(signs) > 0
            # The same number as Spark's xxhash64 of the text.
            key = np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64)
            sides = (tokens.view(np.int64), signs.view(np.int64)) if shown else (None, None)
            out.append((i, key, len(tokens), name, *sides))
        return made(out)

    kinds = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string())]
        + [(n, pa.list_(pa.int64())) for n in ("shingles", "signatures")]
    )

    def made(out):
        columns = list(zip(*out)) if out else [[] for _ in kinds]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    sent = dealt.groupBy("block").applyInArrow(count, "block int, range int, packed binary")
    classes = sent.groupBy("range").applyInArrow(classify, "block int, range int, packed binary")
    schema = "doc_id long, text_key long, n_shingles long, digest string, shingles array<long>, signatures array<long>"
    return dealt.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(finish, schema)


def overlaps(left, right):
    """Matrix of common shingles of two lists of sets, over those that both lists hold."""
    sizes = [len(s) for s in left], [len(s) for s in right]
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    at = [np.searchsorted(common, x) for x in (a, b)]
    for s, x in enumerate((a, b)):
        held = common[np.minimum(at[s], len(common) - 1)] == x if len(common) else np.zeros(len(x), bool)
        rows[s], at[s] = rows[s][held], at[s][held]
    for low in range(0, len(common), 4096):
        dense = []
        for s in (0, 1):
            own = (at[s] >= low) & (at[s] < low + 4096)
            x = np.zeros((len(sizes[s]), min(4096, len(common) - low)), np.float32)
            x[rows[s][own], at[s][own] - low] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def linked_tiles(names, sets, copies, left, right, num, den, apart=None):
    """(name, tree parent, links) of the sets numbered in `left` compared with those in `right`.

    The two are the same numbers, or have none in common. `apart(left, right)` tells which pairs count.
    """
    n = np.array([len(s) for s in sets], np.int64)
    weight = np.array(copies, np.int64)
    common = np.rint(overlaps([sets[i] for i in left], [sets[i] for i in right])).astype(np.int64)
    hit = den * common >= num * (n[left][:, None] + n[right][None, :] - common)
    if apart is not None and hit.any():
        hit &= apart(left, right)
    links = np.zeros(len(names), np.int64)
    if left is right:
        np.fill_diagonal(hit, False)
    else:
        links[right] += hit.T @ weight[left]
    links[left] += hit @ weight[right]
    label = np.arange(len(names))
    right = np.array(right)
    for i, row in zip(left, hit):
        met = np.unique(label[np.r_[i, right[row]]])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return [(names[i], names[label[i]], int(links[i])) for i in np.flatnonzero(links)]


def verified(pairs, sets, num, den):
    """The pairs (src, dst) of sets that link; a set in many pairs is copied to several tasks."""
    size = lambda c: F.size(c).cast("long")
    one = sets.select(F.col("digest").alias("src"), F.col("shingles").alias("a"))
    two = sets.select(F.col("digest").alias("dst"), F.col("shingles").alias("b"))
    met = salted_join(pairs, one, ["src"], hot_rows=HOT_PAIRS)
    # A set is there once, so the pairs themselves tell how often it is met.
    met = salted_join(met, two, ["dst"], hot_rows=HOT_PAIRS, counted=pairs)
    near = den * F.least(size("a"), size("b")) >= num * F.greatest(size("a"), size("b"))
    common = size(F.array_intersect("a", "b"))
    return met.where(near).where(den * common >= num * (size("a") + size("b") - common)).select("src", "dst")


def large_meetings(large):
    """(family, digest, bucket): the sets that have to meet because of large buckets.

    Buckets that have sets in common hang together. Where all sets of such buckets are fewer pairs than
    the buckets' own sets, bucket by bucket, they meet once as a whole, else within each bucket.
    """
    first = large.groupBy("bucket").agg(F.min("digest").alias("dst"), F.count(F.lit(1)).alias("n"))
    star = large.join(first, "bucket").select(F.col("digest").alias("src"), "dst").where("src <> dst").distinct()
    together = components(star, "large").withColumnRenamed("node", "digest").withColumnRenamed("component", "whole")
    of_bucket = first.join(together.withColumnRenamed("digest", "dst"), "dst").select("bucket", "whole", "n")
    cost = of_bucket.groupBy("whole").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    size = together.groupBy("whole").agg(F.count(F.lit(1)).cast("double").alias("sets"))
    choice = size.join(cost, "whole").select("whole", (F.col("sets") * F.col("sets") <= F.col("apart")).alias("once"))
    once = together.join(choice.where("once"), "whole").select(
        F.concat(F.lit("w"), "whole").alias("family"), "digest", F.lit(ALL_SMALL).alias("bucket")
    )
    each = of_bucket.join(choice.where("not once"), "whole").select("bucket").join(large, "bucket")
    return once.unionByName(each.select(F.concat(F.lit("b"), F.col("bucket").cast("string")).alias("family"), "digest", "bucket"))


def jaccard_join(docs, width=5, num=80, den=100, frequent=FREQUENT, tile=TILE, small=SMALL_BUCKET, id_col="doc_id", text_col="text"):
    """doc_id, n_shingles, component_id, n_links, component and text_key of every row.

    The Jaccard join of all texts.

    Two texts link when `den` * common shingles >= `num` * all shingles of both, a shingle
    being `width` consecutive words (runs of anything but ASCII white space, A-Z as a-z),
    or the whole text where it has fewer words. Null, empty and blank texts have no
    shingles and link with nothing: their component is their own id. component_id is the
    smallest id that links lead to; null ids stay null and count only where a component has
    no other. n_links counts other rows, equal rows included. `component` names the
    component (null without shingles) and `text_key` is the 64-bit hash of the row's text, to
    tell rows of one id apart. Further columns are ignored; an empty table gives an empty
    result. num / den has to be 0.7 or more.
    """
    spark = docs.sparkSession
    rows = stored(shingled(docs, width, num, den, frequent, id_col, text_col), "shingles")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "classes")
    sets = rows.where("signatures is not null").select("digest", "shingles", "signatures", F.col("n_shingles").alias("size"))
    sets = sets.dropDuplicates(["digest"])
    sets = stored(sets.join(classes.select("digest", "copies"), "digest"), "sets")

    # A hair wider than the factor, so that rounding cannot part sets by two classes.
    unit = math.log(den / num) * (1 + 1e-9) if num < den else 1.0
    sets = sets.withColumn("size_class", F.floor(F.log(F.col("size").cast("double")) / unit))
    either = F.array("size_class", F.col("size_class") + 1)
    signed = sets.select("digest", F.explode("signatures").alias("sign"), either.alias("either"))
    signed = signed.select("digest", "sign", F.explode("either").alias("at")).select("digest", F.xxhash64("sign", "at").alias("bucket"))
    first = signed.groupBy("bucket").agg(F.min("digest").alias("dst"), F.max("digest").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = stored(signed.join(first.where("dst <> last"), "bucket").select("bucket", "digest", "dst", "n"), "buckets")
    star = stored(shared.select(F.col("digest").alias("src"), "dst").where("src <> dst").distinct(), "star")
    near = stored(verified(star, sets, num, den), "near")
    cluster = components(near, "clusters").withColumnRenamed("node", "digest").withColumnRenamed("component", "cluster")
    cluster = stored(cluster, "cluster")

    # Buckets with sets of several clusters; of those with the same sets one.
    told = shared.drop("dst").join(cluster, "digest", "left").withColumn("cluster", F.coalesce("cluster", "digest"))
    code = F.xxhash64("digest").cast("decimal(38,0)")
    spans = told.groupBy("bucket", "n").agg(
        F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.sum(code).alias("code"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("code2")
    )
    open_buckets = spans.where("low <> high").groupBy("n", "code", "code2").agg(F.min("bucket").alias("bucket")).select("bucket")
    # Stored step by step: the driver keeps a plan, and all its versions, for as long as one is at work.
    open_buckets = stored(open_buckets, "open")
    mixed_sets = stored(told.join(open_buckets, "bucket").join(sets.select("digest", "size"), "digest"), "spread")
    # The largest cluster of a bucket, and how many sets are outside it.
    held = mixed_sets.groupBy("bucket", "cluster").agg(F.count(F.lit(1)).alias("own"), F.first("n").alias("n"))
    main = held.groupBy("bucket").agg(F.max(F.struct("own", "cluster")).alias("m"), F.first("n").alias("all"))
    main = main.select("bucket", F.col("m.cluster").alias("main"), (F.col("all") - F.col("m.own")).alias("others"))
    mixed_sets = stored(salted_join(mixed_sets, main, ["bucket"]).drop("n"), "mixed")
    few = mixed_sets.where(F.col("others") <= small)
    # Every pair across clusters has a set outside the largest one: those, of which a bucket has few, meet all.
    x = few.where(F.col("cluster") != F.col("main")).select("bucket", *[F.col(c).alias(f"{c}1") for c in ("digest", "cluster", "size")])
    y = few.select("bucket", "main", *[F.col(c).alias(f"{c}2") for c in ("digest", "cluster", "size")])
    alike = den * F.least("size1", "size2") >= num * F.greatest("size1", "size2")
    once = (F.col("cluster2") == F.col("main")) | (F.col("digest1") < F.col("digest2"))
    met = salted_join(y, x, ["bucket"], hot_rows=HOT_PAIRS).where((F.col("cluster1") != F.col("cluster2")) & alike & once)
    met = met.select(F.least("digest1", "digest2").alias("digest1"), F.greatest("digest1", "digest2").alias("digest2"))
    pairs = stored(met.select(F.col("digest1").alias("src"), F.col("digest2").alias("dst")).distinct(), "pairs")
    across_pairs = stored(verified(pairs, sets, num, den), "across")

    # What meets in tiles: the sets of a cluster, and those of buckets with many outside the largest one.
    none = F.lit(None)
    family = cluster.select(
        F.concat(F.lit("c"), "cluster").alias("family"), "digest", none.cast("long").alias("bucket"),
        none.cast("array<struct<many:boolean,bucket:long>>").alias("units"), none.cast("string").alias("cluster"),
    )
    large = mixed_sets.where(F.col("others") > small).select("bucket", "digest")
    if not large.isEmpty():
        # A set tells the buckets it shares with other clusters, small ones first, so that a pair counts in one place.
        rank = F.struct((F.col("others") > small).alias("many"), "bucket")
        of_sets = mixed_sets.join(large.select("digest").distinct(), "digest", "left_semi")
        units = of_sets.groupBy("digest").agg(F.collect_set(rank).alias("units"), F.first("cluster").alias("cluster"))
        family = family.unionByName(large_meetings(large).join(units, "digest"))
    # In the meeting of a class, its own sets (lower) meet each other and those of the next (upper).
    member = family.join(sets.select("digest", "shingles", "copies", "size_class"), "digest")
    role = F.explode(F.array(F.struct(F.lit(True).alias("lower"), F.col("size_class").alias("at")), F.struct(F.lit(False).alias("lower"), (F.col("size_class") - 1).alias("at"))))
    kept = ["family", "digest", "copies", "shingles", "bucket", "units", "cluster"]
    member = stored(member.withColumn("role", role).select(*kept, "role.lower", "role.at"), "members")
    meeting = ["family", "at"]
    n = member.groupBy(*meeting).agg(F.count_if("lower").alias("low"), F.count_if(~F.col("lower")).alias("up")).where("low > 0")
    tiles_low, tiles_up = (F.ceil(F.greatest(F.col(c), F.lit(1)) / tile) for c in ("low", "up"))
    own = F.pmod(F.xxhash64("digest"), F.when(F.col("lower"), tiles_low).otherwise(tiles_up))
    whole = F.col("low") + F.col("up") <= tile
    buckets = 8 * parallelism(spark)
    met = member.join(n, meeting).withColumn("tile", F.when(whole, F.lit(0).cast("long")).otherwise(own))
    with_low, with_up = (F.sequence(F.lit(0).cast("long"), t - 1) for t in (tiles_low, tiles_up))
    place = [F.col("family"), F.col("at").cast("string")]
    among = F.transform(with_low, lambda t: F.concat_ws(":", *place, F.lit("same"), F.least("tile", t), F.greatest("tile", t)))
    across = F.when(
        F.col("lower"), F.transform(with_up, lambda t: F.concat_ws(":", *place, F.lit("next"), "tile", t))
    ).otherwise(F.transform(with_low, lambda t: F.concat_ws(":", *place, F.lit("next"), t, "tile")))
    bucket = F.concat(F.lit("all:"), F.pmod(F.xxhash64(*meeting), F.lit(buckets)).cast("string"))
    tasks = F.when(whole, F.array(bucket)).when(F.col("lower"), F.concat(among, across)).otherwise(across)
    met = met.withColumn("task", F.explode(tasks))

    def compare(table):
        cols = {c: table.column(c).to_pylist() for c in ("family", "at", "digest", "copies", "lower", "tile", "bucket", "units", "cluster")}
        task = table.column("task")[0].as_py().split(":")
        chunked = table.column("shingles").combine_chunks()
        offsets, values = chunked.offsets.to_numpy(), chunked.values.to_numpy().view(np.uint64)
        of = {}
        for i in sorted(range(table.num_rows), key=lambda i: cols["digest"][i]):
            of.setdefault((cols["family"][i], cols["at"][i]), []).append(i)
        out = []
        for own in of.values():
            low = [k for k, i in enumerate(own) if cols["lower"][i]]
            up = [k for k, i in enumerate(own) if not cols["lower"][i]]
            if task[0] == "all":
                meetings = [(low, low), (low, up)]
            elif task[-3] == "next":
                meetings = [(low, up)]
            elif task[-2] == task[-1]:
                meetings = [(low, low)]
            else:
                meetings = [[[k for k in low if cols["tile"][own[k]] == int(t)] for t in task[-2:]]]
            sets = [values[offsets[i] : offsets[i + 1]] for i in own]
            names, copies, clusters = ([cols[c][i] for i in own] for c in ("digest", "copies", "cluster"))
            apart = None
            if cols["bucket"][own[0]] is not None:
                here = (True, cols["bucket"][own[0]])
                before = [np.array([u["bucket"] for u in cols["units"][i] if (u["many"], u["bucket"]) < here], np.int64) for i in own]
                group = np.unique(clusters, return_inverse=True)[1]

                def apart(left, right):
                    earlier = overlaps([before[i] for i in left], [before[i] for i in right]) > 0
                    return ~earlier & (group[left][:, None] != group[right][None, :])

            for left, right in meetings:
                if left and right:
                    out += linked_tiles(names, sets, copies, left, right, num, den, apart)
        columns = list(zip(*out)) if out else [[], [], []]
        kinds = pa.string(), pa.string(), pa.int64()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["src", "dst", "links"])

    slim = met.select("task", "at", "lower", "tile", *kept)
    tiled = slim.groupBy("task").applyInArrow(compare, "src string, dst string, links long")
    both = across_pairs.union(across_pairs.select("dst", "src"))
    counted = both.join(classes.select(F.col("digest").alias("dst"), F.col("copies").alias("links")), "dst").select("src", "dst", "links")
    links = stored(tiled.unionByName(counted), "links")
    joined = components(links.select("src", "dst"), "linked").withColumnRenamed("node", "digest")
    count = links.groupBy("src").agg(F.sum("links").alias("links")).withColumnRenamed("src", "digest")
    known = classes.join(joined, "digest", "left").join(count, "digest", "left")
    known = known.withColumn("component", F.coalesce("component", "digest"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = stored(known.join(least, "component").select("digest", "component", "component_id", "copies", "links"), "known")
    named = rows.select("doc_id", "text_key", "n_shingles", F.coalesce("digest", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("digest"))
    out = named.join(known, "digest", "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        n_links.cast("long").alias("n_links"),
        "component",
        "text_key",
    )


def keep_one(docs, width=5, num=80, den=100, frequent=FREQUENT, tile=TILE):
    """The rows of `docs`, all columns, of which one of each component stays: the smallest doc_id's.

    Of rows with one id the smallest text hash stays, and of equal rows one. Rows without
    shingles link with nothing and all stay.
    """
    found = jaccard_join(docs, width, num, den, frequent, tile).where("component is not null")
    counted = stored(found.groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "counted")
    best = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    judged = counted.join(best, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    name = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")]
    # Losers and rows that stay once; where they are measured few, the documents do not move.
    out = stored(judged.where(~stays | (F.col("n") > 1)).select(*name, stays.alias("_once")), "judged")
    if fits_broadcast(out):
        out = F.broadcast(out)
    # A name no column of the documents has.
    key = "_key" + "_" * max(map(len, docs.columns), default=0)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(out["_id"]) & (keyed[key] == out["_text_key"])
    untouched = keyed.join(out, same, "left_anti")
    once = out.where("_once")
    same = keyed["doc_id"].cast("long").eqNullSafe(once["_id"]) & (keyed[key] == once["_text_key"])
    single = keyed.join(once, same, "left_semi").dropDuplicates(["doc_id", key])
    return untouched.union(single).select(*docs.columns)


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join(read(spark, sf_dir, "documents"), width=3, num=90, den=100)
