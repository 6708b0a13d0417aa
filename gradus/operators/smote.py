"""SMOTE oversampling with exact same-class nearest neighbours.

Every class below the majority size is raised to it with synthetic points
``x + u·(nn - x)``: ``x`` a random row of the class, ``nn`` one of its k
nearest same-class neighbours (Euclidean, self excluded), ``u`` ∈ [0, 1).

Neighbours are found in a tree of cells:

1. Every cell of more than ``block`` rows is split by medians along its widest
   columns, up to 64 ways a pass; the cuts come from about ``SAMPLE`` hashed rows of the
   cell, so a pass moves samples only, and cells that are still too large are split
   again.  A cell of equal rows is dealt out by hash.  Any cuts are right: the
   bounding boxes are taken from all rows afterwards.
2. A row's neighbours within its cell give the radius of a ball that holds the k nearest
   (where the cell has too few, the diagonal of the first box above that has enough).
3. Cells meet the boxes that their largest ball touches by descending the tree, one
   equi-join a level (cells on one side, boxes on the other); rows then visit the cells
   whose box their own ball touches.
4. A visited cell compares its rows with up to ``VISITORS`` visitors a task in NumPy;
   the nearest of all visited cells are merged.  The ``CLOSEST`` cells go first, since
   what they hold shrinks the balls that the others are tested with.

No distance that could be among the k smallest is left out, so the result is exact.  A
task holds ``block`` rows and ``VISITORS`` visitors however large a class is.

Random draws are hashes of (class, sample index, seed), so the output does
not depend on partitioning or retries.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import stored
from .ranking import rank_rows

_TWO53 = float(2 ** 53)
SAMPLE, VISITORS, FAN, CLOSEST = 4096, 4096, 128, 4
CHUNK = 64  # rows compared at once: their distances to a block stay in the cache
DEPTH = 6  # splits of a pass: 2 ** 6 cells, numbered by heap positions below FAN
MAX_PASSES = 8  # cell numbers have 63 bits
NEAREST = "array<struct<d:double,rank:long>>"


def _unit(seed: int, purpose: str, cls, s) -> F.Column:
    h = F.xxhash64(F.lit(purpose), cls, s, F.lit(seed))
    return F.pmod(h, F.lit(2 ** 53)).cast("double") / F.lit(_TWO53)


# ------------------------------------------------------------------- cells
def _subtree(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """Median cuts of one cell from its sampled rows: a heap of (column, cut)."""
    X = np.stack(pdf["x"].to_numpy())
    enough = max(2.0, len(X) * block / float(pdf["n"].iloc[0]))
    dims, cuts = np.full(FAN, -1, np.int32), np.zeros(FAN)
    todo = [(1, np.arange(len(X)))]
    while todo:
        node, own = todo.pop()
        if node >= FAN // 2 or len(own) <= enough:
            continue
        spread = X[own].var(axis=0)
        j = int(spread.argmax())
        values, counts = np.unique(X[own, j], return_counts=True)
        if len(values) == 1:
            continue
        below = np.cumsum(counts)[:-1]
        cut = values[np.abs(below - len(own) / 2).argmin()]
        dims[node], cuts[node] = j, cut
        above = X[own, j] > cut
        todo += [(2 * node, own[~above]), (2 * node + 1, own[above])]
    return pd.DataFrame({"cls": [pdf["cls"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "dims": [dims], "cuts": [cuts],
                         "alike": [bool(dims[1] < 0)]})


def _cells(ranked: DataFrame, block: int, seed: int) -> tuple[DataFrame, int]:
    """``ranked`` with its cell, and the number of passes; a cell's parent is cell div FAN."""
    rows = ranked.withColumn("cell", F.lit(1).cast("long"))
    for passes in range(MAX_PASSES + 1):
        sizes = stored(rows.groupBy("cls", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "smote")
        if sizes.isEmpty():
            return rows, passes
        share = F.xxhash64("cls", "rank", F.lit(seed), F.lit(passes)).bitwiseAND(F.lit(0xFFFFFF)) * F.col("n")
        picked = rows.join(sizes, ["cls", "cell"]).where(share <= F.lit(SAMPLE * 0x1000000)).select("cls", "cell", "x", "n")
        trees = stored(picked.groupBy("cls", "cell").applyInPandas(
            functools.partial(_subtree, block=block), "cls int, cell long, dims array<int>, cuts array<double>, alike boolean"), "smote")
        step = F.aggregate(F.array_repeat(F.lit(0), DEPTH), F.lit(1), lambda node, _: F.when(
            F.get("dims", node) >= 0,
            node * 2 + F.when(F.get("x", F.get("dims", node)) > F.get("cuts", node), F.lit(1)).otherwise(F.lit(0))).otherwise(node))
        dealt = F.pmod(F.xxhash64("rank", F.lit(seed), F.lit(passes)), F.lit(FAN // 2)) + FAN // 2
        node = F.when(F.col("alike"), dealt).when(F.col("dims").isNotNull(), step.cast("long")).otherwise(F.lit(1).cast("long"))
        rows = stored(rows.join(trees, ["cls", "cell"], "left").withColumn("cell", F.col("cell") * FAN + node)
                      .drop("dims", "cuts", "alike"), "smote")
    raise RuntimeError(f"cells above {block} rows are left after {MAX_PASSES} passes")


def _extremes(rows: DataFrame, d: int, lo: str, hi: str, n: Column) -> DataFrame:
    """Bounding box and rows of every (cls, cell)."""
    return rows.groupBy("cls", "cell").agg(F.array(*[F.min(F.get(lo, F.lit(j))) for j in range(d)]).alias("lo"),
                                           F.array(*[F.max(F.get(hi, F.lit(j))) for j in range(d)]).alias("hi"),
                                           F.sum(n).alias("n"))


def _touching(d: int):
    """Keeps the pairs whose boxes are nearer to each other than the root of r2."""
    def keep(batches):
        for b in batches:
            qlo, qhi, lo, hi = (_numbers(b.column(c), d) for c in ("qlo", "qhi", "lo", "hi"))
            gap2 = np.zeros(b.num_rows)
            for j in range(d):
                apart = np.maximum(np.maximum(lo[:, j] - qhi[:, j], qlo[:, j] - hi[:, j]), 0.0)
                gap2 += apart * apart
            yield b.filter(pa.array(gap2 < b.column("r2").to_numpy()))
    return keep


# -------------------------------------------------------------- neighbours
def _numbers(column, d: int) -> np.ndarray:
    """The array<double> column of an Arrow batch or table as a matrix of ``d`` columns."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _square_distances(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Column by column: no cancellation, so equal rows are at distance 0."""
    out, columns = np.zeros((len(A), len(B))), np.ascontiguousarray(B.T)
    for j in range(A.shape[1]):
        gap = A[:, j, None] - columns[None, j]
        gap *= gap
        out += gap
    return out


def _near_lists(row: np.ndarray, d2: np.ndarray, rank: np.ndarray, rows: int) -> pa.Array:
    """The (distance, rank) found for each of ``rows`` rows, nearest first."""
    d = np.sqrt(d2)
    order = np.lexsort((rank, d, row))
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(d[order]), pa.array(rank[order].astype(np.int64))], names=["d", "rank"])
    return pa.ListArray.from_arrays(pa.array(ends), found)


def _inside(cell: pa.Table, k: int) -> pa.Table:
    """Neighbours within a cell; r2 is null where it holds fewer than k."""
    cell = cell.sort_by("rank").combine_chunks()
    n, ranks = cell.num_rows, cell.column("rank").to_numpy()
    X = _numbers(cell.column("x"), len(cell.column("x")[0]))
    kk, nearest, distances = min(k, n), [], []
    for at in range(0, n, CHUNK):
        d2 = _square_distances(X[at:at + CHUNK], X)
        d2[np.arange(len(d2)), np.arange(at, at + len(d2))] = np.inf
        part = np.argpartition(d2, kk - 1, axis=1)[:, :kk]
        nearest.append(part)
        distances.append(np.take_along_axis(d2, part, axis=1))
    part, d2 = np.concatenate(nearest), np.concatenate(distances)
    row, at = np.nonzero(d2 < np.inf)
    r2 = pa.array(d2.max(axis=1)) if n > k else pa.nulls(n, pa.float64())
    return pa.table({"cls": cell.column("cls"), "cell": cell.column("cell"), "rank": cell.column("rank"), "x": cell.column("x"),
                     "near": _near_lists(row, d2[row, at], ranks[part[row, at]], n), "r2": r2,
                     "seen": pa.array(np.full(n, n, np.int64))})


def _touched(rows: pa.Table, boxes: pa.Table) -> pa.Table:
    """The boxes that the balls of a cell's rows touch: one row a visit."""
    if not rows.num_rows or not boxes.num_rows:
        return pa.table({"cls": pa.array([], pa.int32()), "cell": pa.array([], pa.int64()),
                         "rank": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64())), "r2": pa.array([], pa.float64())})
    rows = rows.combine_chunks()
    d = len(rows.column("x")[0])
    X, r2 = _numbers(rows.column("x"), d), rows.column("r2").to_numpy()
    lo, hi = _numbers(boxes.column("lo"), d), _numbers(boxes.column("hi"), d)
    who, where = [], []
    for i in range(0, len(X), CHUNK):
        for j in range(0, len(lo), 1024):
            gap2 = np.zeros((len(X[i:i + CHUNK]), len(lo[j:j + 1024])))
            for c in range(d):
                x = X[i:i + CHUNK, c, None]
                apart = np.maximum(np.maximum(lo[None, j:j + 1024, c] - x, x - hi[None, j:j + 1024, c]), 0.0)
                apart *= apart
                gap2 += apart
            a, b = np.nonzero(gap2 < r2[i:i + CHUNK, None])
            who.append(a + i)
            where.append(b + j)
    own, met = rows.take(pa.array(np.concatenate(who))), boxes.take(pa.array(np.concatenate(where)))
    return pa.table({"cls": own.column("cls"), "cell": met.column("box"), "rank": own.column("rank"), "x": own.column("x"),
                     "r2": own.column("r2")})


def _visit(visitors: pa.Table, cell: pa.Table, k: int) -> pa.Table:
    """What a cell holds nearer than a visitor's radius.

    A matrix product, which may err by cancellation, only names the candidates; their
    distances are then taken column by column.
    """
    if not visitors.num_rows or not cell.num_rows:
        return pa.table({"cls": pa.array([], pa.int32()), "rank": pa.array([], pa.int64()),
                         "near": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("rank", pa.int64())]))),
                         "seen": pa.array([], pa.int64())})
    cell, visitors = cell.sort_by("rank").combine_chunks(), visitors.combine_chunks()
    d = len(cell.column("x")[0])
    X, ranks = _numbers(cell.column("x"), d), cell.column("rank").to_numpy()
    Q, r2 = _numbers(visitors.column("x"), d), visitors.column("r2").to_numpy()
    kk, middle = min(k, len(X)), X.mean(axis=0)
    Xm = X - middle
    size = (Xm * Xm).sum(axis=1)
    row, at, d2 = [], [], []
    for s in range(0, len(Q), 512):
        q, most = Q[s:s + 512], r2[s:s + 512]
        qm = q - middle
        both = (qm * qm).sum(axis=1)[:, None] + size[None, :]
        i, j = np.nonzero(~(both * (1 - 1e-10) - 2 * (qm @ Xm.T) >= most[:, None]))
        exact = np.zeros(len(i))
        for c in range(d):
            gap = q[i, c] - X[j, c]
            exact += gap * gap
        near = exact < most[i]
        i, j, exact = i[near], j[near], exact[near]
        many = np.flatnonzero(np.bincount(i, minlength=len(q)) > kk)
        if len(many):
            rest = ~np.isin(i, many)
            whole = _square_distances(q[many], X)
            part = np.argpartition(whole, kk - 1, axis=1)[:, :kk]
            own = np.take_along_axis(whole, part, axis=1)
            a, b = np.nonzero(own < most[many, None])
            i, j, exact = (np.concatenate(v) for v in ((i[rest], many[a]), (j[rest], part[a, b]), (exact[rest], own[a, b])))
        row.append(i + s)
        at.append(j)
        d2.append(exact)
    row, at, d2 = np.concatenate(row), np.concatenate(at), np.concatenate(d2)
    return pa.table({"cls": visitors.column("cls"), "rank": visitors.column("rank"), "near": _near_lists(row, d2, ranks[at], len(Q)),
                     "seen": pa.array(np.full(len(Q), len(X), np.int64))})


def knn_within_class(points: DataFrame, k: int = C.SMOTE_K, block: int = 512, seed: int = C.SEED):
    """Exact k nearest same-class neighbours of every row.

    ``points``: (cls int, rid long, x array<double>).  Returns
    ``(neighbours, ranked)``: neighbours (cls, rank, nn array<long>, seen long) name the
    k nearest rows by their rank in the order of ``rid`` and count the rows compared;
    ranked holds (cls, rid, x, rank).  A class of at most k rows gets fewer.
    """
    first = points.select("x").first()
    d = len(first["x"]) if first else 0
    ranked = stored(rank_rows(points.select("cls", "rid", "x"), ["cls"], ["rid"], "rank"), "smote")
    rows, passes = _cells(ranked.select("cls", "rank", "x"), block, seed)
    inside = stored(rows.groupBy("cls", "cell").applyInArrow(
        lambda cell: _inside(cell, k),
        f"cls int, cell long, rank long, x array<double>, near {NEAREST}, r2 double, seen long"), "smote")

    # boxes of every level, the leaves last
    boxes = [stored(_extremes(rows, d, "x", "x", F.lit(1)), "smote")]
    for _ in range(passes):
        boxes.insert(0, stored(_extremes(boxes[0].withColumn("cell", F.floor(F.col("cell") / FAN)), d, "lo", "hi", F.col("n")), "smote"))
    # rows of cells with too few: the diagonal of the deepest box above that has enough
    wide = F.aggregate(F.zip_with("hi", "lo", lambda a, b: a - b), F.lit(0.0), lambda acc, v: acc + v * v)
    leaves = boxes[-1].select("cls", "cell")
    for level in range(passes, -1, -1):
        above = boxes[level].where(F.col("n") > k).select("cls", F.col("cell").alias("up"), (wide * 1.000001 + 1e-9).alias(f"w{level}"))
        leaves = (leaves.withColumn("up", F.floor(F.col("cell") / FAN ** (passes - level))).join(above, ["cls", "up"], "left").drop("up"))
    leaves = leaves.select("cls", "cell", F.coalesce(*[f"w{i}" for i in range(passes, -1, -1)], F.lit(float("inf"))).alias("bound"))
    inside = stored(inside.join(leaves, ["cls", "cell"]).withColumn("r2", F.coalesce("r2", "bound")).drop("bound"), "smote")

    # cells down the tree: (cell, box) pairs that the cell's largest ball touches
    reach = inside.groupBy("cls", "cell").agg(F.max("r2").alias("r2"))
    pairs = boxes[-1].join(reach, ["cls", "cell"]).select("cls", F.col("cell").alias("own"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"),
                                                          "r2", F.lit(1).cast("long").alias("box"))
    # boxes are few bytes: without this one task would compare them all
    pairs = pairs.repartition(points.sparkSession.sparkContext.defaultParallelism, "cls", "own")
    for level in range(1, passes + 1):
        below = boxes[level].select("cls", F.floor(F.col("cell") / FAN).alias("box"), F.col("cell").alias("next"), "lo", "hi")
        met = pairs.join(below, ["cls", "box"]).select("cls", "own", "qlo", "qhi", "r2", "next", "lo", "hi")
        pairs = met.mapInArrow(_touching(d), met.schema).select("cls", "own", "qlo", "qhi", "r2", F.col("next").alias("box"))
    middle = lambda lo, hi: F.zip_with(lo, hi, lambda a, b: a + b)
    target = boxes[-1].select("cls", F.col("cell").alias("box"), "lo", "hi")
    pairs = pairs.where("own <> box").join(target, ["cls", "box"])
    off = F.aggregate(F.zip_with(middle("qlo", "qhi"), middle("lo", "hi"), lambda a, b: a - b), F.lit(0.0), lambda acc, v: acc + v * v)
    closest = Window.partitionBy("cls", "own").orderBy(off, "box")
    pairs = stored(pairs.select("cls", "own", "box", "lo", "hi", (F.row_number().over(closest) <= CLOSEST).alias("close")), "smote")

    # a cell's few closest cells first: they shrink the balls that the others must meet
    for close in (True, False):
        inside = _round(inside, rows, pairs.where(F.col("close") == close).drop("close"), k)
    return inside.select("cls", "rank", F.transform("near", lambda n: n["rank"]).alias("nn"), "seen"), ranked


def _round(inside: DataFrame, rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Rows visit the given cells that their ball touches; neighbours and radii are updated."""
    own = inside.select("cls", F.col("cell").alias("own"), "rank", "x", "r2").groupBy("cls", "own")
    visits = stored(own.cogroup(pairs.groupBy("cls", "own")).applyInArrow(
        lambda rows, boxes: _touched(rows, boxes), "cls int, cell long, rank long, x array<double>, r2 double"), "smote")
    shares = visits.groupBy("cls", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(VISITORS // 2)).alias("shares"))
    guests = visits.join(shares, ["cls", "cell"]).withColumn("share", F.pmod(F.xxhash64("rank"), F.col("shares"))).drop("shares")
    hosts = rows.join(shares, ["cls", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    by = ["cls", "cell", "share"]
    met = (guests.groupBy(*by).cogroup(hosts.select(*by, "rank", "x").groupBy(*by))
           .applyInArrow(lambda visitors, cell: _visit(visitors, cell, k), f"cls int, rank long, near {NEAREST}, seen long"))
    met = met.groupBy("cls", "rank").agg(F.flatten(F.collect_list("near")).alias("more"), F.sum("seen").alias("met"))
    found = F.slice(F.array_sort(F.concat("near", F.coalesce("more", F.array().cast(NEAREST)))), 1, k)
    farthest = F.get(found, F.lit(k - 1))["d"]
    # a hair wider than the square of the rounded root, so that no equal distance is lost
    return stored(inside.join(met, ["cls", "rank"], "left")
                  .select("cls", "cell", "rank", "x", found.alias("near"), F.least("r2", farthest * farthest * 1.000001).alias("r2"),
                          (F.col("seen") + F.coalesce("met", F.lit(0))).alias("seen")), "smote")


def smote(df: DataFrame, label: str = "label", features: str = "features", k: int = C.SMOTE_K,
          seed: int = C.SEED, block: int = 512, id_col: str | None = None) -> DataFrame:
    """Resample every class up to the majority size; returns (label, features, synthetic)."""
    counts = {int(r["c"]): r["n"] for r in
              df.groupBy(F.col(label).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_max = max(counts.values())
    need = {c: n_max - n for c, n in counts.items() if n < n_max}
    original = df.select(F.col(label), F.col(features), F.lit(False).alias("synthetic"))
    if not need:
        return original
    small = [c for c in need if counts[c] <= k]
    if small:
        raise ValueError(f"classes {small} have <= {k} rows; SMOTE needs more than k neighbours")

    rid = F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id()
    pts = (df.where(F.col(label).cast("int").isin(list(need)))
           .select(F.col(label).cast("int").alias("cls"), rid.alias("rid"),
                   vector_to_array(F.col(features)).alias("x")))
    if id_col is None:
        pts = stored(pts, "smote")
    nn, ranked = knn_within_class(pts, k, block, seed)

    # synthetic sample index s per class from one distributed range
    offsets, start = [], 0
    for c in sorted(need):
        offsets.append((c, start, need[c]))
        start += need[c]
    sid = F.col("id")
    cls = None
    for c, off, m in offsets:
        cond = (sid >= off) & (sid < off + m)
        cls = F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c))
    off_col = None
    for c, off, _ in offsets:
        cond = F.col("cls") == c
        off_col = F.when(cond, F.lit(off)) if off_col is None else off_col.when(cond, F.lit(off))
    size = None
    for c, _, _ in offsets:
        cond = F.col("cls") == c
        size = F.when(cond, F.lit(counts[c])) if size is None else size.when(cond, F.lit(counts[c]))
    spark = df.sparkSession
    draws = (spark.range(start).select(sid, cls.alias("cls"))
             .withColumn("s", F.col("id") - off_col)
             .withColumn("rank", F.pmod(F.xxhash64(F.lit("base"), "cls", "s", F.lit(seed)), size) + 1)
             .withColumn("j", F.pmod(F.xxhash64(F.lit("nn"), "cls", "s", F.lit(seed)), F.lit(k)).cast("int"))
             .withColumn("u", _unit(seed, "step", F.col("cls"), F.col("s"))))
    base = ranked.select("cls", "rank", F.col("x").alias("xb"))
    nbr = ranked.select("cls", F.col("rank").alias("nrank"), F.col("x").alias("xn"))
    syn = (draws.join(nn, ["cls", "rank"])
           .withColumn("nrank", F.element_at("nn", F.col("j") + 1))
           .join(base, ["cls", "rank"]).join(nbr, ["cls", "nrank"]))
    new_x = F.zip_with("xb", "xn", lambda a, b: a + F.col("u") * (b - a))
    label_type = df.schema[label].dataType
    synthetic = syn.select(F.col("cls").cast(label_type).alias(label), array_to_vector(new_x).alias(features),
                           F.lit(True).alias("synthetic"))
    return original.unionByName(synthetic)
