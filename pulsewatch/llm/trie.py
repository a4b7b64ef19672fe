"""The prefix tree of rebuilt conversations, from fingerprints of their parts.

A sequence of turns has the fingerprint (n, H): its length and, for two bases B modulo the prime
2^61 - 1, the sum of e(turn i) * B^i over its turns. Sequences multiply as
(n, H)(m, G) = (n + m, H + B^n G), so the fingerprint of a rebuilt conversation up to any turn
follows from the products of its base's head and of its own turns: the own turns after the first h
are worth (H(d) - H(h)) / B^h, and go behind the head's H by B to the head's length. No rebuilt
text is made. A node is a fingerprint; one aggregate over the stored turns that members refer to
proves that they agree, turn by turn and parent by parent, and other bases are taken if not.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pulsewatch.llm.common import parallelism, read, stored
from pulsewatch.operators.ordered import running_sum
from pulsewatch.operators.sizing import keyed_join, salted_join

PRIME = (1 << 61) - 1
WORDS = r"[^\x20\x09-\x0D]+"
LONGEST_HEAD = 3
BASE_STEP = 20
ATTEMPTS = 4
HOT_CHILDREN = 100_000
CHUNK_CHARS = 1 << 20
NODE = ["depth", "f1", "f2"]
NONE_SHA = hashlib.sha256(b"").hexdigest()


def times(a, b):
    """a * b modulo the prime, for arrays of numbers below it."""
    low, high = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    p, s31, s30, s61, one = (np.uint64(x) for x in (PRIME, 31, 30, 61, 1))
    au, ad, bu, bd = a >> s31, a & low, b >> s31, b & low
    middle = ad * bu + au * bd
    x = ((au * bu) << one) + (middle >> s30) + ((middle & high) << s31) + ad * bd
    x = (x >> s61) + (x & p)
    return np.where(x >= p, x - p, x)


def powers(base, exponents):
    """base to each exponent, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.array([base], np.uint64), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), times(out, square), out)
        square, left = times(square, square), left >> np.uint64(1)
    return out


def bases(seed):
    """Two bases; each seed has its own."""
    digest = hashlib.sha256(f"bases {seed}".encode()).digest()
    return [2 + int.from_bytes(digest[i : i + 8], "big") % (PRIME - 3) for i in (0, 8)]


def turn_terms(seed):
    """UDF: position and two hashes of a turn to its terms of the two sums."""
    pair = bases(seed)

    @F.pandas_udf("struct<t1:long,t2:long>")
    def terms(pos: pd.Series, e1: pd.Series, e2: pd.Series) -> pd.DataFrame:
        at = pos.to_numpy()
        return pd.DataFrame(
            {
                f"t{i + 1}": times(e.to_numpy().astype(np.uint64), powers(pair[i], at)).astype(np.int64)
                for i, e in enumerate((e1, e2))
            }
        )

    return terms


def prefix_products(numbered, seed):
    """Numbered turns with g1, g2: their terms, and h1, h2: sums up to and with this turn."""
    hashes = [F.pmod(F.xxhash64(F.lit(2 * seed + i), "role", "text"), F.lit(PRIME)) for i in (0, 1)]
    out = numbered.withColumn("_t", turn_terms(seed)("pos", *hashes))
    out = out.withColumns({f"g{i}": F.col(f"_t.t{i}").cast("decimal(20,0)") for i in (1, 2)}).drop("_t")
    for i in (1, 2):
        out = running_sum(out, ["conv_id"], ["pos"], f"g{i}", f"h{i}")
    return out.withColumns({f"{x}{i}": modulo(F.col(f"{x}{i}")) for x in "gh" for i in (1, 2)})


def modulo(x):
    return F.pmod(x.cast("decimal(38,0)"), F.lit(PRIME).cast("decimal(38,0)")).cast("long")


def rebuilt(rows):
    """Per conversation how it is rebuilt: `skip` own turns fall away behind `kept` turns of the
    base; b1, b2 hold the base's products after 0 to 3 turns, o1, o2 the own product skipped.
    A base is its own base and keeps all its turns, so each turn of a head is also one of a base."""
    at = {f"h{i}_{k}": F.max(F.when(F.col("pos") == k, F.col(f"h{i}"))) for i in (1, 2) for k in range(1, LONGEST_HEAD + 1)}
    own = rows.groupBy("conv_id").agg(F.max("pos").alias("n"), *[v.alias(k) for k, v in at.items()])
    heads = [F.array(F.lit(0).cast("long"), *[F.col(f"h{i}_{k}") for k in range(1, LONGEST_HEAD + 1)]).alias(f"o{i}") for i in (1, 2)]
    own = stored(own.select("conv_id", "n", *heads), "trie-heads")
    skip = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(LONGEST_HEAD + 1)).cast("int")
    asked = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE_STEP)
    asked = asked.withColumn("skip", F.when(F.col("base") == F.col("conv_id"), 0).otherwise(skip))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("o1").alias("b1"), F.col("o2").alias("b2"))
    kept = F.least("skip", F.coalesce("base_n", F.lit(0))).cast("int")
    found = asked.join(base, "base", "left").withColumn("kept", kept)
    nothing = F.array(F.lit(0).cast("long"))
    found = found.withColumns({f"b{i}": F.coalesce(f"b{i}", nothing) for i in (1, 2)})
    found = found.withColumns({f"o{i}": F.get(f"o{i}", F.least(F.col("skip"), F.col("n").cast("int"))) for i in (1, 2)})
    length = F.col("kept") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))
    return found.select("conv_id", "skip", "kept", "b1", "b2", "o1", "o2", length.cast("long").alias("length"))


def behind_head(product, i, inverses):
    """The rebuilt product for a product of own turns: head, then own turns without the skipped."""
    own = modulo(product.cast("decimal(20,0)") - F.col(f"o{i}"))
    shift = F.get(F.array(*[F.lit(x) for x in inverses]), F.col("skip") - F.col("kept"))
    moved = modulo(own.cast("decimal(19,0)") * shift.cast("decimal(19,0)"))
    return modulo(F.get(f"b{i}", F.col("kept")).cast("decimal(20,0)") + F.when(F.col("skip") == F.col("kept"), own).otherwise(moved))


def members(rows, how, seed, said):
    """(conv_id, depth) of every rebuilt conversation from depth 0: node f1, f2, parent p1, p2,
    `ends` where it is the last turn, and the columns `said` of own turns (null otherwise)."""
    inverse = [[pow(b, -k, PRIME) for k in range(LONGEST_HEAD + 1)] for b in bases(seed)]
    own = keyed_join(rows, how, ["conv_id"]).where(F.col("pos") > F.col("skip"))
    own = own.withColumn("depth", F.col("kept") + F.col("pos") - F.col("skip"))
    parent = {i: modulo(F.col(f"h{i}").cast("decimal(20,0)") - F.col(f"g{i}")) for i in (1, 2)}
    ends = (F.col("depth") == F.col("length")).alias("ends")
    own = own.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        *[behind_head(F.col(f"h{i}"), i, inverse[i - 1]).alias(f"f{i}") for i in (1, 2)],
        *[behind_head(parent[i], i, inverse[i - 1]).alias(f"p{i}") for i in (1, 2)],
        ends,
        *said,
    )
    # Depths up to the head's: products of the base as they are.
    heads = how.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("kept")))).select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        *[F.get(f"b{i}", F.col("depth")).alias(f"f{i}") for i in (1, 2)],
        *[F.get(f"b{i}", F.col("depth") - 1).alias(f"p{i}") for i in (1, 2)],
        ends,
        *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in said],
    )
    return own.unionByName(heads)


def ends_digests(ended, partitions):
    """SHA-256 of the ascending conv_ids of each node at which conversations end.

    Ids are put in order over all tasks and joined there in parts; a node's parts are then
    hashed one after the other, since SHA-256 cannot be put together from hashes of parts.
    No list of ids is held.
    """

    def parts(batches):
        node, first, said, size = None, None, [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (*node, first)] + [pa.array([",".join(said)])], names=[*NODE, "first", "said"]
            )

        done = []
        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if own != node or size > CHUNK_CHARS:
                    if said:
                        done.append(out())
                    node, first, said, size = own, conv, [], 0
                said.append(str(conv))
                size += len(said[-1]) + 1
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if said:
            yield out()

    def digests(batches):
        node, sha, rows = None, None, []
        schema = pa.schema([(n, pa.int64()) for n in NODE] + [("ends_sha256", pa.string())])

        def flush():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

        for batch in batches:
            for *own, _, said in zip(*(c.to_pylist() for c in batch.columns)):
                if own != node:
                    if node is not None:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(said.encode())
            if rows:
                yield flush()
                rows.clear()
        if node is not None:
            rows.append((*node, sha.hexdigest()))
            yield flush()

    keys = "depth long, f1 long, f2 long"
    ordered = ended.repartitionByRange(partitions, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = ordered.mapInArrow(parts, f"{keys}, first long, said string")
    return joined.repartition(partitions, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{keys}, ends_sha256 string")


def prefix_tree(conversations, conv_id="conv_id", turn="turn", role="role", text="text", seed=0):
    """One row per node of the tree of rebuilt conversations, the textless root included.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Turns follow (turn, role, text), nulls first; null roles and texts are empty ones, and equal
    rows are turns of their own. Conversation c takes the first h turns of c - c % 20, with
    h = crc32(c) % 4, before its own turns after the first h. Rows without conv_id belong to no
    conversation and are left out. Further columns are ignored; an empty table gives an empty
    result, without a root. Texts may be of any length, a conversation of any number of turns.

    Subtrees are summed without descending: a node belongs to the path of its smallest member, so
    what lies below a depth is a running sum along that conversation, and a node adds up the sums
    of its members.
    """
    turns = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    numbered = running_sum(turns.withColumn("one", F.lit(1)), ["conv_id"], ["turn", "role", "text"], "one", "pos")
    numbered = numbered.select("conv_id", "pos", "role", "text")
    for attempt in range(seed, seed + ATTEMPTS):
        words = F.regexp_count("text", F.lit(WORDS)).cast("long")
        rows = stored(prefix_products(numbered, attempt).withColumn("words", words), "trie-turns")
        how = stored(rebuilt(rows), "trie-rebuilt")
        nodes = stored(verified_nodes(rows, how, attempt), "trie-nodes")
        if nodes.where("not same").isEmpty():
            return tree(rows, how, nodes, attempt)
    raise RuntimeError("fingerprints of different prefixes were equal under every pair of bases")


def verified_nodes(rows, how, seed):
    """Nodes with their smallest member, and `same`: whether all members have one parent and
    refer to turns of one role and text, as the stored turns say."""
    said = F.struct("role", "text")
    all_rows = members(rows.withColumn("said", said).drop("role", "text"), how, seed, ["words", "said"])
    grouped = all_rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.max("p1").alias("q1"),
        F.max("p2").alias("q2"),
        F.min("said").alias("low"),
        F.max("said").alias("high"),
    )
    same = F.col("low").eqNullSafe(F.col("high")) & F.col("p1").eqNullSafe(F.col("q1")) & F.col("p2").eqNullSafe(F.col("q2"))
    return grouped.select(*NODE, "conv_id", "n_convs", F.coalesce("words", F.lit(0)).alias("words"), "p1", "p2", same.alias("same"))


def tree(rows, how, nodes, seed):
    partitions = parallelism(rows.sparkSession)
    paths = members(rows.drop("role", "text", "words"), how, seed, []).select("conv_id", *NODE, "ends")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    children = below.agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    counted = stored(counted.drop("same"), "trie-children")
    own = counted.select(
        "conv_id",
        "depth",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
    )
    valued = paths.join(own, ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"]).withColumn("up", -F.col("depth"))
    valued = running_sum(valued, ["conv_id"], ["up"], "saved", "saved_below")
    valued = running_sum(valued, ["conv_id"], ["up"], "leaf", "leaves_below")
    sums = valued.groupBy(*NODE).agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves"))
    ends = ends_digests(paths.where("ends").select(*NODE, "conv_id"), partitions)
    parents = counted.select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    known = salted_join(counted, parents, ["depth", "p1", "p2"], "left", hot_rows=HOT_CHILDREN)
    out = known.join(sums, NODE).join(ends, NODE, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE_SHA)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir):
    return prefix_tree(read(spark, sf_dir, "conversations"))


#: crc32 of the decimal conv_id: a byte at a time, eight shifts each.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)))"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, count(*) AS n FROM t GROUP BY ALL
), c AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS b, {CRC32} % 4 AS h FROM own
), k AS (
  SELECT c.*, least(c.h, coalesce(own.n, 0)) AS kept FROM c LEFT JOIN own ON own.conv_id = c.b
), rebuilt AS (
  SELECT k.conv_id, t.pos AS depth, r, x FROM k JOIN t ON t.conv_id = k.b WHERE t.pos <= k.kept
  UNION ALL SELECT k.conv_id, k.kept + t.pos - k.h, r, x FROM k JOIN t USING (conv_id) WHERE t.pos > k.h
), p AS (
  SELECT conv_id, depth, x, string_agg('r' || length(r) || ':' || r || 't' || length(x) || ':' || x, '')
    OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM c
), m AS (
  SELECT *, lag(prefix) OVER w AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), nodes AS (
  SELECT depth, prefix, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    len(regexp_extract_all(any_value(x), '[^\\x20\\x09-\\x0D]+')) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY ALL
), children AS (
  SELECT parent AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)
), pairs AS (
  SELECT DISTINCT v.prefix, u.prefix AS below FROM m AS v JOIN m AS u ON u.conv_id = v.conv_id AND u.depth >= v.depth
), sums AS (
  SELECT pairs.prefix, sum((u.n_convs - 1) * u.words) AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves
  FROM pairs JOIN counted AS u ON u.prefix = pairs.below GROUP BY ALL
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM counted AS v JOIN sums USING (prefix) LEFT JOIN counted AS q ON v.depth > 0 AND q.prefix = v.parent
"""
