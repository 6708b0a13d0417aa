"""One pass over the rows that sums a vector: the step of every iterative fit here.

A task runs a NumPy function over its Arrow batches.  Where a vector has up to ``SHORT``
numbers, or those of all tasks together up to ``COLLECTED``, each is returned as one binary
value and the driver adds them: a pass is then one stage, which counts where a fit takes
hundreds of them.  Beyond that a task returns its non-zero sums as (index, value) rows, Spark adds them up by index, and only
the summed vector, whose length is a matter of the model and not of the rows, reaches the
driver.

A fit reads its rows once a pass, so they are stored as blocks of up to ``BLOCK`` rows, a
block being the Arrow stream of its columns in one binary value: a task maps it instead of
converting every number of every row.  Spark's reader holds a row group's values (up to 4,096)
unpacked at a time, so a row group has ``GROUP`` blocks, whatever the files' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, small_batches, stored

BLOCK, SHORT, COLLECTED, GROUP = 2048, 2048, 4_000_000, 16
_SUMS = pa.schema([("i", pa.int64()), ("v", pa.float64())])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def byte_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def list_column(X: np.ndarray) -> pa.Array:
    """The array<double> column of ``matrix``."""
    ends = (np.arange(len(X) + 1) * X.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(X, float).ravel()))


def summed(rows: DataFrame, size: int, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """``sums`` of all tasks' batches (of plain or of packed ``rows``), added up; a vector of ``size`` numbers."""
    blocks = "block" in rows.columns
    few = size <= SHORT or size * rows.rdd.getNumPartitions() <= COLLECTED
    if blocks:
        rows = small_batches(rows).select("block")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.asarray(sums(opened(batches) if blocks else batches), float)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])

    if few:
        out = np.zeros(size)
        for v in rows.mapInArrow(whole, "v binary").toArrow().column("v"):
            out += np.frombuffer(v.as_buffer())
        return out

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sums(opened(batches) if blocks else batches)
        at = np.flatnonzero(v)
        for s in range(0, len(at), 10_000):
            own = at[s:s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(v[own])], schema=_SUMS)

    got = rows.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    return np.bincount(got.column("i").to_numpy(), got.column("v").to_numpy(), size)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of rows that blocks were packed from."""
    for b in batches:
        for block in b.column("block"):
            yield from pa.ipc.open_stream(block.as_buffer())


def _closed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def packed(rows: DataFrame, by: str | None = None) -> DataFrame:
    """``rows`` stored as blocks over all cores at least, to be read once a pass.

    With ``by``, an int column, a block holds rows of one value and the blocks are stored
    by it, so that a pass over ``where(by = ...)`` reads no others.
    """
    def pack(batches):
        for b in batches:
            groups = [(None, b)]
            if by:
                value = b.column(by).to_numpy()
                groups = [(v, b.take(pa.array(np.flatnonzero(value == v)))) for v in np.unique(value)]
            for v, own in groups:
                for at in range(0, own.num_rows, BLOCK):
                    block = [pa.array([_closed(own.slice(at, BLOCK))], pa.binary())]
                    yield pa.RecordBatch.from_arrays(block + ([pa.array([v], pa.int32())] if by else []),
                                                     names=["block"] + ([by] if by else []))

    cores = rows.sparkSession.sparkContext.defaultParallelism
    schema = "block binary" + (f", {by} int" if by else "")
    blocks = _grouped(small_batches(rows).mapInArrow(pack, schema))
    few = blocks.rdd.getNumPartitions() < cores
    if by or few:
        return _grouped(blocks.repartition(cores) if few else blocks, by)
    return blocks


def _grouped(blocks: DataFrame, by: str | None = None) -> DataFrame:
    """``blocks`` stored in row groups of ``GROUP``."""
    path = scratch_path(blocks.sparkSession, "rows")
    out = blocks.write.option("parquet.block.row.count.limit", GROUP)
    (out.partitionBy(by) if by else out).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` stored over all cores at least: they are read once a pass from here on."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = stored(rows, "rows")
    return rows if rows.rdd.getNumPartitions() >= cores else stored(rows.repartition(cores), "rows")
