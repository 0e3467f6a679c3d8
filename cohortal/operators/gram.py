"""Sums of products of sparse rows, as tiles of a square matrix.

A row holds the places and values of one item. Tasks add the products of their rows up, batch by batch, into one square per
fold, and give it away as tiles; tiles of one place are added in a tree of bounded fan-in, a tile at a time. So what
is shuffled is a row an item and, for each task and fold, the tiles that aren't zero, whatever the number of items; no
row is joined with another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators.loops import checkpointed

TILE = 256  # places a side: half a megabyte
CELLS = 4_000_000  # of a dense batch of rows
FAN_IN = 16
SCHEMA = "fold long, i int, j int, part long, cells binary"


def item_rows(long: DataFrame, key: str = "item", *carry: str) -> DataFrame:
    """(key, *carry, places, values) of long(key, *carry, k, value), by place: a row a key, whose places are terms at most."""
    held = long.groupBy(key, *carry).agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("_kv"))
    return held.select(key, *carry, F.col("_kv.k").alias("places"), F.col("_kv.value").alias("values"))


def add_products(total: np.ndarray, offsets: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """Adds to total the products of every row with itself; row r has places[offsets[r]:offsets[r + 1]], and places may repeat."""
    sizes = np.diff(offsets)
    if not len(places):
        return
    active, local = np.unique(places, return_inverse=True)
    pairs = int((sizes.astype(np.int64) ** 2).sum())
    if len(sizes) * len(active) ** 2 > 64 * (pairs + total.size):  # few of many: each row's pairs on their own
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            for some in np.array_split(rows, max(1, len(rows) * size * size // CELLS)):
                at = offsets[some][:, None] + np.arange(size)[None, :]
                k, v = places[at], values[at]
                flat = (k[:, :, None] * total.shape[0] + k[:, None, :]).ravel()
                total += np.bincount(flat, (v[:, :, None] * v[:, None, :]).ravel(), total.size).reshape(total.shape)
        return
    step = max(1, CELLS // len(active))
    for start in range(0, len(sizes), step):
        stop = min(len(sizes), start + step)
        part = slice(offsets[start], offsets[stop])
        dense = np.zeros((stop - start, len(active)))
        np.add.at(dense, (np.repeat(np.arange(stop - start), sizes[start:stop]), local[part]), values[part])
        total[np.ix_(active, active)] += dense.T @ dense


def tiles(rows: DataFrame, width: int) -> DataFrame:
    """SCHEMA: the sums of products of rows(fold, places, values) in each task, tile row by tile column, i <= j."""

    def emit(fold: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, width, TILE):
            for j in range(i, width, TILE):
                cells = total[i : i + TILE, j : j + TILE]
                if cells.any():
                    yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int64()), pa.array([i // TILE], pa.int32()), pa.array([j // TILE], pa.int32()), pa.array([np.ascontiguousarray(cells).tobytes()], pa.binary())], names=["fold", "i", "j", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, current = np.zeros((width, width)), None
        for batch in batches:
            folds = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(folds)) + 1).tolist(), len(folds)]
            offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
            places, values = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if current is not None and folds[a] != current:
                    yield from emit(current, total)
                    total[:] = 0
                current = int(folds[a])
                own = slice(offsets[a], offsets[b])
                add_products(total, offsets[a : b + 1] - offsets[a], places[own].astype(np.int64), values[own])
        if current is not None:
            yield from emit(current, total)

    # one fold after the other: a task holds one square
    dealt = rows.select(F.col("fold").cast("long").alias("fold"), "places", "values").sortWithinPartitions("fold")
    return dealt.mapInArrow(run, "fold long, i int, j int, cells binary").select("fold", "i", "j", F.spark_partition_id().cast("long").alias("part"), "cells")


def added(parts: DataFrame) -> DataFrame:
    """SCHEMA: tiles of one place added, those of FAN_IN tasks at a time until a place has one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int32()), pa.array([at[3]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            for row, key in enumerate(keys):
                cells = np.frombuffer(batch.column(4)[row].as_py())
                if key == at:
                    total = total + cells
                else:
                    if at is not None:
                        yield out()
                    at, total = key, cells
        if at is not None:
            yield out()

    parts = checkpointed(parts)
    left = parts.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN_IN)
        keyed = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition("fold", "i", "j", "part").sortWithinPartitions("fold", "i", "j", "part")
        parts = keyed.mapInArrow(run, SCHEMA)
        if left <= 1:
            return parts


def squares(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The matrix of each fold, whose tiles come to the driver a partition at a time."""
    out: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        m = out.setdefault(r["fold"], np.zeros((width, width)))
        i, j = r["i"] * TILE, r["j"] * TILE
        cells = np.frombuffer(r["cells"]).reshape(min(TILE, width - i), -1)
        m[i : i + cells.shape[0], j : j + cells.shape[1]] = cells
        m[j : j + cells.shape[1], i : i + cells.shape[0]] = cells.T
    return out
