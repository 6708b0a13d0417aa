"""Near-duplicate embeddings by a robust-pruned flat graph over cluster shards.

1. Equal vectors are one node.  Spherical k-means on a bounded sample gives centres;
   every node goes to the shards of its ``overlap`` nearest centres.  Shards above
   ``SHARD_MAX`` nodes are dealt into parts of that size.
2. In each part a robust-pruned graph is built (Subramanya et al. 2019): of a node's
   nearest and of some far candidates, the closest is kept and those are dropped that
   are ``ALPHA`` times closer to it than to the node.  Adjacency lists of a node from
   all its parts are united.
3. Each node is searched for in all parts of its shards, in blocks of queries: greedy
   search from the part's medoid, which goes on past the beam as long as unexpanded
   nodes lie within ``MARGIN`` of the threshold.  Found pairs are verified by cosine in
   double precision; each node's root among them gives the components.
4. Nodes of one component that share a shard are tested exactly, a pair once, in the
   smallest shard that both have, and counted for both ends: a link found by one side
   only, or in another common shard only, is not lost.
5. The links are audited: queries are drawn until ``LINKED`` of them have links (or all
   nodes are drawn), and their links are counted by brute force over all rows.  Where
   the mean recall of queries with like numbers of links is below ``RECALL``, the search
   is repeated with a wider overlap and beam; after the last round that is an error.

No step makes a list of pairs, so that rows of groups of thousands of near copies stay
linear.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or
are not of the commonest length, link with nothing; repeated rows link with each
other; a null id counts after all others as the smallest of a group; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, stored

SAMPLE = 16_000  # vectors that the centres are fitted on
SHARD_TARGET, SHARD_MAX, CENTRES_MAX = 1_200, 3_000, 2_048
DEGREE, NEAR, FAR, ALPHA = 24, 48, 16, 1.2
BEAM, MARGIN, EXPAND, QUERIES = 32, 0.1, 4, 512
AUDIT, AUDIT_MAX, LINKED, RECALL = 200, 3_200, 100, 0.95


def centres_of(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means with ``k`` unit centres."""
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i:i + 2_000] @ c.T, axis=1) for i in range(0, len(x), 2_000)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def robust_prune(x: np.ndarray, own: np.ndarray, pick: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Neighbours (-1 fills) of the nodes ``own`` out of candidates sorted by closeness."""
    rows = np.arange(len(own))
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    open_ = (pick != own[:, None]) & (sims > -2)
    out = np.full((len(own), DEGREE), -1)
    candidates = x[pick]
    for j in range(DEGREE):
        any_ = open_.any(axis=1)
        if not any_.any():
            break
        best = np.argmax(open_, axis=1)
        out[any_, j] = pick[rows, best][any_]
        near = np.einsum("nd,nmd->nm", candidates[rows, best], candidates)
        open_ &= ALPHA * np.sqrt(np.maximum(0, 2 - 2 * near)) > far
        open_[rows, best] = False
    return out


def build(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency of a part: pruned lists and, in free places, reverse edges."""
    n = len(x)
    if n == 1:
        return np.full((1, 2 * DEGREE), -1)
    rng = np.random.default_rng(seed)
    near = min(NEAR, n - 1)
    out = np.empty((n, DEGREE), np.int64)
    for s in range(0, n, 256):
        sims = x[s:s + 256] @ x.T
        own = np.arange(s, min(n, s + 256))
        sims[own - s, own] = -2
        pick = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        pick = np.concatenate([pick, rng.integers(0, n, (len(own), FAR))], axis=1)
        part = np.take_along_axis(sims, pick, axis=1)
        order = np.argsort(-part, axis=1, kind="stable")
        pick, part = np.take_along_axis(pick, order, axis=1), np.take_along_axis(part, order, axis=1)
        out[s:s + 256] = robust_prune(x, own, pick, part)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(out.tolist()):
        for j in row:
            if j >= 0 and len(back[j]) < DEGREE:
                back[j].append(i)
    both = np.full((n, 2 * DEGREE), -1)
    both[:, :DEGREE] = out
    for i, b in enumerate(back):
        both[i, DEGREE:DEGREE + len(b)] = b
    return both


def search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Similarities (queries by nodes) of all nodes reached; -2 where not reached."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    sims = np.full((len(q), n), -2.0)
    done = np.zeros((len(q), n), bool)
    sims[:, medoid] = q @ x[medoid]
    live = np.arange(len(q))
    least = max(1, beam // EXPAND)
    step = 0
    while len(live):
        wait = np.where(done[live], -3.0, sims[live])
        k = min(EXPAND, n)
        best = np.argpartition(-wait, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(wait, best, axis=1)
        more = (value > -2) & ((step < least) | (value >= threshold - MARGIN))
        go = more.any(axis=1)
        live, best, more = live[go], best[go], more[go]
        if not len(live):
            break
        row, col = np.nonzero(more)
        done[live[row], best[row, col]] = True
        nxt = graph[best[row, col]]
        a = np.repeat(live[row], graph.shape[1])
        b = nxt.ravel()
        new = (b >= 0)
        a, b = a[new], b[new]
        new = sims[a, b] <= -2
        pair = np.unique(a[new] * n + b[new])
        a, b = pair // n, pair % n
        sims[a, b] = np.einsum("ij,ij->i", q[a], x[b])
        step += 1
    return sims


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither squares nor sums overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes."""
    for b in batches:
        if b.num_rows:
            v = _unit(b.column("v").flatten().to_numpy().reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in v], pa.binary())],
                                             names=["node", "vec"])


def _assign(batches: Iterator[pa.RecordBatch], centres, dim: int, overlap: int) -> Iterator[pa.RecordBatch]:
    c = centres.value
    k = min(overlap, len(c))
    for b in batches:
        for s in range(0, b.num_rows, 2_000):
            part = b.slice(s, 2_000)
            sims = _matrix(part.column("vec"), dim) @ c.T
            near = np.sort(np.argpartition(-sims, k - 1, axis=1)[:, :k], axis=1)
            ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in ("node", "vec", "copies")),
                 pa.ListArray.from_arrays(ends, pa.array(near.ravel().astype(np.int32)))],
                names=["node", "vec", "copies", "shards"])


def _rows(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(-1, dim)


def _build(pdf: pd.DataFrame, dim: int) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    nodes = pdf["node"].to_numpy()
    graph = build(_rows(pdf, dim))
    return pd.DataFrame({"node": nodes, "near": [nodes[g[g >= 0]] for g in graph]})


def _search(pdf: pd.DataFrame, dim: int, threshold: float, beam: int) -> pd.DataFrame:
    """For the nodes of a part and a block of queries: the root of each linked node
    among the links found."""
    base = pdf[pdf["base"]].sort_values("node")
    ask = pdf[~pdf["base"]].sort_values("node")
    nodes, x = base["node"].to_numpy(), _rows(base, dim)
    q, asked = _rows(ask, dim), ask["node"].to_numpy()
    if not len(nodes) or not len(asked):
        return pd.DataFrame({"node": [], "root": []})
    width = max(1, max(len(a) for a in base["near"]))
    graph = np.full((len(nodes), width), -1)
    for i, near in enumerate(base["near"]):
        at = np.searchsorted(nodes, near)
        at[at == len(nodes)] = 0
        own = at[nodes[at] == near]
        graph[i, :len(own)] = own
    names = np.union1d(nodes, asked)
    parent = np.arange(len(names))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at_x, at_q = np.searchsorted(names, nodes), np.searchsorted(names, asked)
    touched = np.zeros(len(names), bool)
    for s in range(0, len(asked), QUERIES):
        found = search(x, graph, q[s:s + QUERIES], threshold, beam) >= threshold
        for i, j in zip(*np.nonzero(found), strict=True):
            if nodes[j] == asked[s + i]:
                continue
            a, b = find(at_q[s + i]), find(at_x[j])
            parent[max(a, b)] = min(a, b)
            touched[at_q[s + i]] = touched[at_x[j]] = True
    root = np.array([find(i) if t else i for i, t in enumerate(touched)])
    return pd.DataFrame({"node": names[touched], "root": names[root[touched]]})


def _count(pdf: pd.DataFrame, dim: int, threshold: float) -> pd.DataFrame:
    """Links (rows) and peers (nodes) of each node of two parts, or of one with itself:
    pairs of one component whose smallest common shard this is, tested once for both ends."""
    shard, same = int(pdf["shard"].iloc[0]), pdf["part"].iloc[0] == pdf["block"].iloc[0]
    out = []
    for _, own in pdf.groupby("root"):
        own = own.sort_values("node")
        left = own[own["base"]]
        right = left if same else own[~own["base"]]
        if not len(left) or not len(right):
            continue
        x, y = _rows(left, dim), _rows(right, dim)
        sx, sy = np.stack(left["shards"].to_list()), np.stack(right["shards"].to_list())
        cx, cy = left["copies"].to_numpy(), right["copies"].to_numpy()
        far = np.zeros((2, len(right)), np.int64)
        near = np.zeros((2, len(left)), np.int64)
        for s in range(0, len(left), QUERIES):
            hit = x[s:s + QUERIES] @ y.T >= threshold
            for i in range(sx.shape[1]):
                for j in range(sy.shape[1]):
                    less = np.where(sx[s:s + QUERIES, i] < shard, sx[s:s + QUERIES, i], -1)
                    hit &= less[:, None] != sy[None, :, j]
            if same:
                hit &= np.arange(s, s + len(hit))[:, None] < np.arange(len(right))[None, :]
            near[:, s:s + QUERIES] = hit @ cy, hit.sum(axis=1)
            far += np.stack([cx[s:s + QUERIES] @ hit, hit.sum(axis=0)])
        out += [pd.DataFrame({"node": f["node"].to_numpy(), "links": n[0], "peers": n[1]}) for f, n in ((left, near), (right, far))]
    return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "peers": []})


def _brute(batches: Iterator[pa.RecordBatch], queries, dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    names, q = queries.value
    total = np.zeros(len(names), np.int64)
    for b in batches:
        for s in range(0, b.num_rows, 4_000):
            part = b.slice(s, 4_000)
            hit = q @ _matrix(part.column("vec"), dim).T >= threshold
            hit &= names[:, None] != part.column("node").to_numpy()[None, :]
            total += hit.sum(axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["node", "peers"])


def true_links(nodes: DataFrame, queries: list[tuple[int, bytes]], dim: int, threshold: float) -> DataFrame:
    """node, peers of a bounded list of queries, by brute force over all nodes in blocks."""
    if not queries:
        return nodes.sparkSession.createDataFrame([], "node long, peers long")
    names = np.array([n for n, _ in queries])
    q = np.stack([np.frombuffer(bytes(v), np.float64) for _, v in queries])
    shared = nodes.sparkSession.sparkContext.broadcast((names, q))
    return nodes.mapInArrow(functools.partial(_brute, queries=shared, dim=dim, threshold=threshold),
                            "node long, peers long").groupBy("node").agg(F.sum("peers").alias("peers"))


def audited(nodes: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    """node, peers of nodes drawn in growing blocks until ``LINKED`` of them have links,
    or of all nodes."""
    order = stored(nodes.select("node", "vec", F.xxhash64("node", F.lit("audit")).alias("o")), "audit-order")
    last, size, drawn, linked, parts = None, AUDIT, 0, 0, []
    while drawn < n and linked < LINKED:
        rest = order if last is None else order.where((F.col("o") > last[0]) | ((F.col("o") == last[0]) & (F.col("node") > last[1])))
        block = rest.orderBy("o", "node").limit(size).collect()
        last = (block[-1]["o"], block[-1]["node"])
        parts.append(stored(true_links(nodes, [(r["node"], r["vec"]) for r in block], dim, threshold), "audit"))
        linked += parts[-1].where("peers > 0").count()
        drawn += len(block)
        size = min(2 * size, AUDIT_MAX)
    return functools.reduce(DataFrame.unionByName, parts) if parts else true_links(nodes, [], dim, threshold)


def recall_of(truth: DataFrame, total: DataFrame) -> float:
    """The least mean recall of a query among queries with like numbers of links (1, 2-3,
    4-7, ...); 1 if none has links."""
    got = (truth.where("peers > 0").withColumnRenamed("peers", "want").join(total.select("node", "peers"), "node", "left")
           .groupBy(F.floor(F.log2("want")).alias("like")).agg(F.avg(F.coalesce("peers", F.lit(0)) / F.col("want")).alias("recall"))
           .agg(F.min("recall")).first()[0])
    return 1.0 if got is None else got


def _links(nodes: DataFrame, dim: int, n: int, threshold: float, overlap: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """node, links, peers of the linked nodes, and node, root of all in a component."""
    spark = nodes.sparkSession
    draw = F.pmod(F.xxhash64("node", F.lit("centres")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = nodes.where(draw).select("node", "vec").orderBy("node").collect()
    x = np.stack([np.frombuffer(bytes(r["vec"]), np.float64) for r in sample]) if sample else np.eye(1, dim)
    k = max(1, min(CENTRES_MAX, overlap * n // SHARD_TARGET))
    centres = spark.sparkContext.broadcast(centres_of(x, k))
    dealt = nodes.mapInArrow(functools.partial(_assign, centres=centres, dim=dim, overlap=overlap),
                             "node long, vec binary, copies long, shards array<int>")
    dealt = stored(dealt.withColumn("shard", F.explode("shards")), "shards")
    size = dealt.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_MAX).cast("int").alias("parts"))
    dealt = dealt.join(size, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    near = dealt.groupBy("shard", "part").applyInPandas(functools.partial(_build, dim=dim), "node long, near array<long>")
    near = stored(near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    # every block of queries meets every part of its shard
    both = F.sequence(F.lit(0), F.col("parts") - 1)
    base = dealt.join(near, "node").withColumn("block", F.explode(both)).withColumn("base", F.lit(True))
    ask = (dealt.withColumn("block", F.col("part")).withColumn("part", F.explode(both))
           .withColumn("near", F.array().cast("array<bigint>")).withColumn("base", F.lit(False)))
    found = stored(base.unionByName(ask).groupBy("shard", "part", "block").applyInPandas(
        functools.partial(_search, dim=dim, threshold=threshold, beam=beam), "node long, root long"), "found")
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # a pair found by either side in any shard is in one component, and is tested where both first meet
    held = dealt.join(root, "node")
    left = held.withColumn("block", F.explode(F.sequence("part", F.col("parts") - 1))).withColumn("base", F.lit(True))
    right = (held.withColumn("block", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("part"))))
             .where("part < block").withColumn("base", F.lit(False)))
    links = left.unionByName(right).groupBy("shard", "part", "block").applyInPandas(
        functools.partial(_count, dim=dim, threshold=threshold), "node long, links long, peers long")
    return stored(links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("peers").alias("peers")), "links"), root


def near_duplicates(df: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    v = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    common = v.where("good").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1
    v = v.withColumn("node", F.when(F.col("good") & (F.size("v") == dim), F.xxhash64("v")))
    rows = v.select("id", "node")
    nodes = (v.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"),
                                                             F.min("v").alias("v"), F.max("v").alias("top")))
    nodes = stored(nodes, "vectors")
    if nodes.where(F.col("v") != F.col("top")).take(1):
        raise RuntimeError("two vectors share a 64-bit hash")
    n = nodes.count()
    packed = nodes.select("node", "v").mapInArrow(functools.partial(_pack, dim=dim), "node long, vec binary")
    packed = stored(packed.join(nodes.select("node", "copies"), "node"), "units")
    truth = audited(packed, n, dim, threshold)
    for widen in (1, 2, 4):
        total, root = _links(packed, dim, max(1, n), threshold, 1 + widen, BEAM * widen)
        recall = recall_of(truth, total)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.3f} of audited queries after the widest search")
    top = (nodes.select("node", "copies", "least").join(total.select("node", "links"), "node", "left").join(root, "node", "left")
           .withColumn("root", F.coalesce("root", "node")))
    low = top.groupBy("root").agg(F.min("least").alias("component_id"))
    top = top.join(low, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                       "component_id")
    return (rows.join(top, "node", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), 0.9)
