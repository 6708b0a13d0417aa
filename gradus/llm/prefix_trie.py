"""Trie of conversation prefixes, from composable fingerprints of turn sequences.

A conversation is rebuilt from the first turns of its base conversation and its own
turns after as many.  A sequence of turns has the fingerprint (length, sum of
a_i * B^i mod p) for two primes, a monoid: the product of (l, s) and (m, t) is
(l + m, s + B^l t), and a cut-out piece is a difference times a power of B.  So every
prefix of a rebuilt conversation is the product of a prefix of its base and a piece of
its own turns, taken from the running products of the stored turns; no rebuilt sequence
or text is put together.  Turns are known by (conversation, position) and SHA-256.

Prefixes of equal length and fingerprint are a node.  All its members must agree in the
digest of the stored turn that they refer to last and in the parent's fingerprint, which
by induction shows that they are equal sequences; if any node fails, other bases are taken.

Sums over subtrees need no walk.  A member is a node's representative if it is the
smallest; it stays so further down.  A node's leaves are its members that represent a
leaf, and its saved bytes are, summed over members, the bytes from the node's turn to the
last turn that the member does not represent, which is a difference of running sums.

Running sums go over ranges of (conversation, turn), so a conversation may hold most rows;
what remains are sums and joins on (depth, fingerprint) or conversation, where one side
has a row for each key.  The ids of a node's ends are hashed in order from pieces of
``PIECE`` ids, which a stream of SHA-256 passes one by one.

Defined cases: null conv_ids belong to no conversation and are left out; null turns come
first; rows of equal turn are ordered by the SHA-256 of role and text, and repeated rows
are turns of their own; null role or text is empty; very long texts are digested where
they are read; other columns are not looked at; an empty table has no nodes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, read, stored
from .merkle import crc32_sql

PRIMES = (2147483647, 2147483629)
BASES = ((1318699, 947586347), (69621, 1583458089), (742938285, 39373), (950706376, 1226874159))
HEAD, SHARE = 9, 5  # fixed values: heads have fewer than 9 turns, 5 ids share a base
PIECE = 500
KEY = ["depth", "f1", "f2"]


def _power(base: int, exponent: Column, prime: int, bits: int = 40) -> Column:
    """base ** exponent mod prime, bit by bit."""
    out = F.lit(1).cast("long")
    for k in range(bits):
        bit = F.shiftright(exponent, k).bitwiseAND(F.lit(1)) == 1
        out = out * F.when(bit, F.lit(pow(base, 1 << k, prime))).otherwise(F.lit(1)).cast("long") % prime
    return out


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, digest, bytes) of the stored turns, in their order: pos, n."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.octet_length(t).cast("long").alias("bytes"),
        F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)).alias("digest"))
    return stored(ranked(rows, "conv", ["turn", "digest"]).drop("turn"), "turns")


def running(rows: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """Adds each turn's terms (t1, t2) and the running products and bytes up to it (s1, s2, upto)."""
    for k, (base, prime) in enumerate(zip(bases, PRIMES), 1):
        value = F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(prime - 1)) + 1
        rows = rows.withColumn(f"t{k}", value * _power(base, F.col("pos") + 1, prime) % prime)
    inside = Window.partitionBy("part", "conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"s1": "t1", "s2": "t2", "upto": "bytes"}
    before = rows.groupBy("part", "conv").agg(*[F.sum(v).alias(v) for v in sums.values()])
    before = before.select("part", "conv", *[F.coalesce(F.sum(v).over(line), F.lit(0)).alias(f"b_{s}") for s, v in sums.items()])
    out = rows.withColumns({s: F.sum(v).over(inside) for s, v in sums.items()}).join(before, ["part", "conv"])
    out = out.withColumns({s: F.col(s) + F.col(f"b_{s}") for s in sums}).drop(*[f"b_{s}" for s in sums])
    return out.withColumns({"s1": F.col("s1") % PRIMES[0], "s2": F.col("s2") % PRIMES[1]})


def members(rows: DataFrame, bases: tuple[int, int], own: DataFrame | None = None) -> DataFrame:
    """One row for each prefix of each rebuilt conversation.

    conv, depth, fingerprint (f1, f2), the parent's (p1, p2), where its last turn is
    stored (src, at), that turn's digest and bytes, bytes before it, and whether the
    conversation ends there.  ``rows`` are the running products of ``running``; ``own``
    names head lengths (conv, h) and base ids other than those of the registered query.
    """
    convs = own if own is not None else rows.select("conv").distinct().select(
        "conv", (F.crc32(F.col("conv").cast("string")) % HEAD).alias("h"), (F.col("conv") - F.col("conv") % SHARE).alias("base"))
    turn = F.struct(F.col("pos").alias("at"), F.col("conv").alias("src"), "t1", "t2", "s1", "s2", "upto", "digest", "bytes")
    # fewer than HEAD turns of a conversation: a bounded list
    heads = rows.where(F.col("pos") < HEAD - 1).groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("n").alias("n"))
    convs = (convs.join(heads, "conv").withColumnRenamed("turns", "mine")
             .join(heads.select(F.col("conv").alias("base"), "turns"), "base", "left")
             .withColumn("m", F.least("h", F.coalesce(F.size("turns"), F.lit(0)).cast("long")))
             .withColumn("m", F.greatest("m", F.lit(0).cast("long")))
             .withColumn("ends", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))))
    at = lambda turns, count, f: F.when(F.col(count) > 0, F.get(turns, (F.col(count) - 1).cast("int"))[f]).otherwise(0)
    for k, (base, prime) in enumerate(zip(bases, PRIMES), 1):
        shift = F.array(*[F.lit(pow(base, -j, prime)).cast("long") for j in range(HEAD)])
        convs = convs.withColumn(f"x{k}", F.get(shift, (F.col("h") - F.col("m")).cast("int")))
        convs = convs.withColumn(f"o{k}", F.pmod(at("turns", "m", f"s{k}") - F.col(f"x{k}") * at("mine", "h", f"s{k}") % prime, F.lit(prime)))
    convs = stored(convs.withColumn("shift", at("turns", "m", "upto") - at("mine", "h", "upto")), "convs")

    last = (F.col("depth") == F.col("ends")).alias("last")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), none.alias("p1"), none.alias("p2"), none.alias("src"),
                        none.alias("at"), F.lit(None).cast("binary").alias("digest"), zero.alias("bytes"), zero.alias("before"), "ends")
    minus = lambda s, t, prime: F.pmod(s - t, F.lit(prime))
    head = (convs.where("m > 0").select("conv", "ends", F.explode(F.slice("turns", 1, F.col("m").cast("int"))).alias("t"))
            .select("conv", (F.col("t.at") + 1).alias("depth"), F.col("t.s1").alias("f1"), F.col("t.s2").alias("f2"),
                    minus(F.col("t.s1"), F.col("t.t1"), PRIMES[0]).alias("p1"), minus(F.col("t.s2"), F.col("t.t2"), PRIMES[1]).alias("p2"),
                    F.col("t.src"), F.col("t.at"), F.col("t.digest"), F.col("t.bytes"), (F.col("t.upto") - F.col("t.bytes")).alias("before"), "ends"))
    tail = rows.join(convs.select("conv", "h", "m", "ends", "o1", "o2", "x1", "x2", "shift").where("ends > m"), "conv").where("pos >= h")
    for k, prime in enumerate(PRIMES, 1):
        tail = tail.withColumn(f"f{k}", (F.col(f"o{k}") + F.col(f"x{k}") * F.col(f"s{k}") % prime) % prime)
        tail = tail.withColumn(f"p{k}", minus(F.col(f"f{k}"), F.col(f"x{k}") * F.col(f"t{k}") % prime, prime))
    tail = tail.select("conv", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "f1", "f2", "p1", "p2", F.col("conv").alias("src"),
                       F.col("pos").alias("at"), "digest", "bytes", (F.col("shift") + F.col("upto") - F.col("bytes")).alias("before"), "ends")
    return root.unionByName(head).unionByName(tail).select("*", last).drop("ends")


def group(held: DataFrame) -> DataFrame:
    """Nodes of the member rows; ``differ`` is true where members are no equal sequences."""
    same = [F.min(c).eqNullSafe(F.max(c)) for c in ("digest", "p1", "p2")]
    return held.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"),
                                  F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("bytes").alias("bytes"),
                                  F.min(F.struct("src", "at")).alias("ref"), (~(same[0] & same[1] & same[2])).alias("differ"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) to (key, first, text), text being up to PIECE ids, comma-joined."""
    key, ids, done = None, [], []
    names = [*KEY, "first", "text"]

    def flush():
        if ids:
            done.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for b in batches:
        for *k, conv in zip(*[c.to_pylist() for c in b.columns]):
            if k != key or len(ids) == PIECE:
                flush()
                key = k
            ids.append(conv)
        if len(done) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
            done.clear()
    flush()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one hash for each key; only the hash's state is held."""
    key, state, names = None, None, [*KEY, "ends_sha256"]
    for b in batches:
        done = []
        for *k, _, text in zip(*[c.to_pylist() for c in b.columns]):
            if k == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = k, hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=names)


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of every node's conv ids, ascending and comma-joined."""
    key = ", ".join(f"{k} long" for k in KEY)
    pieces = stored(ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
                    .mapInArrow(_pieces, f"{key}, first long, text string"), "pieces")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, f"{key}, ends_sha256 string")


def trie(conversations: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """One row for each node; ``ref`` says where its last turn is stored."""
    rows = turns(conversations)
    for bases in BASES:
        held = stored(members(stored(running(rows, bases), "running"), bases, own), "members")
        nodes = stored(group(held), "nodes")
        if nodes.where("differ").isEmpty():
            break
    else:
        raise RuntimeError("different prefixes have equal fingerprints for every base")

    mine = held.where("depth > 0").join(nodes.select(*KEY, "conv_id", (F.col("n_ends") == F.col("n_convs")).alias("leaf")), KEY)
    rep = F.col("conv") == F.col("conv_id")
    each = mine.groupBy("conv").agg(F.max(F.when(~rep, F.col("before") + F.col("bytes"))).alias("until"),
                                    F.max((rep & F.col("leaf") & F.col("last")).cast("long")).alias("leaves"))
    sums = held.join(each, "conv", "left").groupBy(*KEY).agg(
        F.sum(F.greatest(F.coalesce("until", F.lit(0)) - F.col("before"), F.lit(0))).alias("saved_tokens"),
        F.sum(F.coalesce("leaves", F.lit(0))).alias("leaves"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_hashes(held.where("last").select(*KEY, "conv"))
    empty = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, KEY).join(below, KEY, "left").join(ends, KEY, "left").join(above, ["depth", "p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    # only the root can be a leaf that no turn represents
                    F.when(F.col("n_ends") == F.col("n_convs"), F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "ref"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations")).drop("ref")


OP13_SQL = f"""
WITH own AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
dig AS (SELECT c, turn, strlen(x) AS bytes, sha256(strlen(r)::VARCHAR || ':' || r || x) AS dg FROM own),
t AS (SELECT c, bytes, dg, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dg) AS i FROM dig),
conv AS (SELECT c, c - c % 5 AS b, {crc32_sql("c::VARCHAR")}::BIGINT % 9 AS h FROM (SELECT DISTINCT c FROM t)),
base AS (SELECT conv.c, h, b, least(h, coalesce(k, 0)) AS m FROM conv LEFT JOIN (SELECT c, count(*) AS k FROM t GROUP BY c) s ON s.c = b),
built AS (SELECT base.c, i AS d, bytes, dg FROM base JOIN t ON t.c = b AND i <= h
    UNION ALL SELECT base.c, i - h + m, bytes, dg FROM base JOIN t ON t.c = base.c AND i > h),
pre AS (SELECT c, d, bytes, string_agg(dg, '') OVER (PARTITION BY c ORDER BY d) AS key,
               d = max(d) OVER (PARTITION BY c) AS fin FROM built
    UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM built) FROM conv),
node AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE fin), '')) AS ends_sha256
         FROM pre GROUP BY d, key),
kids AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
up AS (SELECT left(node.key, 64 * k) AS key, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
       FROM (SELECT node.*, n_children, unnest(range(d + 1)) AS k FROM node LEFT JOIN kids USING (key)) node GROUP BY 1)
SELECT node.conv_id, node.d AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN up USING (key) LEFT JOIN kids USING (key) LEFT JOIN node p ON p.d = node.d - 1 AND p.key = left(node.key, 64 * (node.d - 1))
"""
