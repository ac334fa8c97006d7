"""Comparing the rows of a group with each other in bounded pieces.

A group of at most ``block`` rows is one cell. A larger one is dealt into blocks by a hash of its rows, and every two
blocks form a cell, so a hot group becomes many tasks and each pair of its rows meets in at least one of them. Cells
hold at most about twice ``block`` rows and are compared as vectors; what leaves a cell is the edges of a spanning
forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexwarden.workspace import written

BLOCK = 4096


def dealt(rows: DataFrame, key: list[str], spread, label: str, block: int = BLOCK) -> DataFrame:
    """Rows of groups of two or more, once for each of their cells: with ``cell`` (long), ``piece`` (their block) and
    ``within`` (the cell is that of one block, so it alone compares the block's rows with each other)."""
    rows = written(rows, f"{label}-rows")
    sizes = written(rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"), f"{label}-sizes")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("long")
    known = rows.join(sizes, key).withColumn("_blocks", blocks).withColumn("piece", F.pmod(spread, F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    cut = known.withColumn("_other", other)
    cell = F.xxhash64(*key, F.least("piece", "_other"), F.greatest("piece", "_other"))
    within = F.col("piece") == F.col("_other")
    return cut.withColumn("cell", cell).withColumn("within", within).drop("_n", "_blocks", "_other")


def by_cell(rows: DataFrame) -> DataFrame:
    """Dealt by cell, the rows of a cell side by side."""
    return rows.repartition("cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pa.RecordBatch], cut_on: str = "cell") -> Iterator[pa.Table]:
    """Tables made of whole cells from batches that are sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(cut_on).to_numpy(zero_copy_only=False)
        start = int((cell != cell[-1]).sum())  # where the last cell of the batch begins
        if start or (held and held[-1].column(cut_on)[0].as_py() != cell[0]):
            ready = [*held, batch.slice(0, start)] if start else held
            yield pa.Table.from_batches(ready)
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def linked_neighbours(
    cell: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same cell that ``close`` accepts, as arrays of positions; ``cell`` is sorted."""
    step = 1
    while step < len(cell):
        left = np.flatnonzero(cell[:-step] == cell[step:])
        if not len(left):
            return
        hit = left[close(left, left + step)]
        if len(hit):
            yield hit, hit + step
        step += 1


class Forest:
    """Union by position, for the rows of one table of cells."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        differ = self.root[left] != self.root[right]
        for a, b in zip(left[differ].tolist(), right[differ].tolist(), strict=True):
            a, b = self._find(a), self._find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return up
            self.root = up
