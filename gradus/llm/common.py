"""Shared helpers: tables in the shared folder, connected components, row identity."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new folder under the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and
    a lost executor costs neither the table nor a different recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, for files that tasks write themselves.

    Spark's names of stores are mapped to Arrow's: ``s3a`` and ``s3n`` are ``s3``.
    """
    if not re.match(r"[a-z][a-z0-9+.-]*:", folder):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", folder)))


#: what this worker process keeps between the tasks of one operator
_STATE: dict = {"owner": None, "kept": {}}


def give_back() -> None:
    """Returns freed memory to the system.  Worker processes stay when idle, and what they
    keep for later use counts against their executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(owner: str, key=None, make: Callable | None = None, keep: int = 1):
    """State that an operator's tasks share within a worker process.

    Worker processes outlive a job.  What another operator left is dropped first, so a
    pipeline's stages never hold each other's tables and caches; without ``make`` that is
    all.  At most ``keep`` values stay, the latest used.
    """
    if _STATE["owner"] != owner:
        _STATE["kept"].clear()
        _STATE["owner"] = owner
        give_back()
    if make is None:
        return None
    kept = _STATE["kept"]
    value = kept.pop(key) if key in kept else None
    if value is None:
        while len(kept) >= keep:
            del kept[next(iter(kept))]
        value = make()
    kept[key] = value
    return value


class WordCache(dict):
    """Results by word, bounded by bytes: it starts anew when full and leaves out words
    above ``longest`` characters."""

    def __init__(self, most: int = 48 << 20, longest: int = 1000, unit: int = 1):
        super().__init__()
        self.most, self.longest, self.unit, self.held = most, longest, unit, 0

    def put(self, found: Iterable[tuple[str, bytes]]) -> None:
        for word, value in found:
            if len(word) <= self.longest:
                self.held += 2 * len(word) + self.unit * len(value) + 150
                self[word] = value

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


class AgedCache(WordCache):
    """A word cache of two halves: when the newer one is full it becomes the older one, so
    words in use are not worked out again.  ``aged`` moves what it finds to the newer half."""

    def __init__(self, most: int, longest: int = 1000, unit: int = 1):
        super().__init__(most // 2, longest, unit)
        self.older: dict = {}

    def aged(self, word: str) -> bytes | None:
        value = self.older.pop(word, None)
        if value is not None:
            self.put([(word, value)])
        return value

    def trim(self) -> None:
        if self.held > self.most:
            self.older = dict(self)
            super().trim()


def doc_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) only, under fixed names, so no other column can clash."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"),
                       F.col(f"`{text}`").cast("string").alias("text"))


def text_hash(text: Column) -> Column:
    """Identity of a text next to its id: 64 bits, null and empty alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``part``, ``pos`` (from 0) and ``n`` of its row within ``group``, by ``order``.

    Rows are dealt out by ranges of (group, order), so a group of any size spreads over
    many tasks; a part's share of a group is numbered by its place in the part, and parts
    are put in line by a prefix sum over one row for each part of a group.  The sorted
    rows are a table in the shared folder, as a second sampling could cut other ranges.
    ``group`` has no nulls; equal rows are numbered in any order.
    """
    rows = stored(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                  .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "ranked")
    line = Window.partitionBy(group).orderBy("part")
    share = (rows.groupBy("part", group).agg(F.min("row").alias("low"), F.count("*").alias("held"))
             .withColumns({"before": F.sum("held").over(line) - F.col("held"),
                           "n": F.sum("held").over(Window.partitionBy(group))}))
    return (rows.join(share.drop("held"), ["part", group])
            .withColumn("pos", F.col("row") - F.col("low") + F.col("before")).drop("row", "low", "before"))


def _digest(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge list."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the
    smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step replaces each node's links by links to the smallest node it sees.  The
    minimum is a pre-aggregated ``min`` and the links are rewritten by an
    equi-join, so no node's links are ever gathered; each round is a table in
    the shared folder.  Works for any orderable node type; self-links and
    repeated links are harmless, an empty list gives an empty result.
    """
    e = stored(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
               .where("hi <> lo").distinct(), "edges")
    state = None
    while state != (state := _digest(e)):
        # large-star: neighbours above the node move to the smallest one seen
        both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = (both.join(low, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .distinct())
        # small-star: neighbours below the node, and the node, move to the smallest below
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi")
        e = stored(moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
                   .union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    pairs = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stored(pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct()), "roots")
