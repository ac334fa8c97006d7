"""Near duplicates among vectors by a forest of random-projection trees.

Vectors of the same label and length are linked at a cosine of ``COSINE`` or more, in double precision. A tree splits at
the median of a random projection, again and again; what lies within a margin of a split goes down both sides (spill
overlap), so close vectors rarely part, and those that part in one tree meet in another. Vectors that share a leaf are
compared exactly. The trees are fitted on a sample of at most about ``SAMPLE_ROWS`` vectors, every vector is routed
through them, and a leaf of any size is compared in full, in cells of bounded size (``cells.py``).

Equal vectors of a label are one class, so copies are never paired. A pair of classes is counted in the first leaf they
share, in the order of trees; only counts per vector and the edges of spanning forests leave a cell.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null,
links with nothing (n_links 0, its own component); rows that share an id count as vectors of their own; null ids are
skipped for ``component_id``; ``kept`` is true where vec_id equals component_id (null equals null); an empty table gives
an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexwarden.llm.cells import Forest, by_cell, dealt, whole_cells
from hexwarden.llm.common import table
from hexwarden.llm.components import components
from hexwarden.workspace import written

COSINE = 0.98
#: Vectors that trees are fitted on, trees, rows a leaf should have, sample rows it must have, largest block of a cell.
SAMPLE_ROWS = 20_000
TREES = 8
LEAF_ROWS = 256
LEAF_SAMPLE = 8
BLOCK = 1024
#: Half the margin of a split, in standard deviations of a linked pair's projected difference.
SPILL = 0.6
SEED = 3

ROUTED = "node long, weight long, label {}, dim int, leaf long, leaves array<long>, vector array<double>"
FOUND = "a long, b long, links long"


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # No square can overflow.
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Tree:
    """Splits as arrays: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, margin: float):
        self.depth, self.margin, dim = depth, margin, sample.shape[1]
        drawn = np.random.default_rng(seed).normal(size=(2**depth - 1, dim))
        self.directions = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
        self.thresholds = np.zeros(2**depth - 1)
        members = {0: np.arange(len(sample))}
        for k in range(2**depth - 1):
            own = members.pop(k)
            projected = sample[own] @ self.directions[k]
            self.thresholds[k] = np.median(projected) if len(own) else 0.0
            right = projected > self.thresholds[k]
            members[2 * k + 1], members[2 * k + 2] = own[~right], own[right]

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row reaches."""
        at, node = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            offset = np.einsum("ij,ij->i", rows[at], self.directions[node]) - self.thresholds[node]
            left, right = offset <= self.margin, offset > -self.margin
            at = np.concatenate((at[left], at[right]))
            node = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return at, node


def fit_forest(sample: np.ndarray, group_rows: int, trees: int = TREES) -> list[Tree]:
    """``group_rows``: vectors of the largest label, which decide the depth."""
    wanted = math.log2(max(1.0, group_rows / LEAF_ROWS))
    depth = max(0, math.ceil(min(wanted, math.log2(max(1.0, len(sample) / LEAF_SAMPLE)))))
    margin = SPILL * math.sqrt(2 - 2 * COSINE) / math.sqrt(sample.shape[1])
    return [Tree(sample, depth, SEED * 1000 + t, margin) for t in range(trees)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _router(forests: dict[int, list[Tree]]):
    """Each class once for every leaf it reaches; ``leaves`` has all of them in the order of trees."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                vectors = unit(_matrix(rows.column("vector")))
                # A length that the sample lacks has no trees: one leaf, compared in full.
                parts = [tree.leaves(vectors) for tree in forests.get(int(dim), [])] or [
                    (np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64))
                ]
                at = np.concatenate([p[0] for p in parts])
                leaf = np.concatenate([p[1] | t << 40 for t, p in enumerate(parts)])
                order = np.lexsort((leaf, at))
                at, leaf = at[order], leaf[order]
                cuts = np.searchsorted(at, np.arange(len(vectors) + 1))
                own = [leaf[cuts[i] : cuts[i + 1]] for i in range(len(vectors))]
                for begin in range(0, len(at), 5_000):
                    piece = at[begin : begin + 5_000]
                    taken = rows.take(pa.array(piece))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(taken.column(c) for c in ("node", "weight", "label", "dim")),
                            pa.array(leaf[begin : begin + 5_000]),
                            pa.array([own[i] for i in piece], pa.list_(pa.int64())),
                            pa.array(list(vectors[piece]), pa.list_(pa.float64())),
                        ],
                        names=["node", "weight", "label", "dim", "leaf", "leaves", "vector"],
                    )

    return route


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first code that the rows of ``a`` and ``b`` (ascending, padded with -1) share."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        shared = (a[:, k, None] == b).any(axis=1) & (a[:, k] >= 0)
        out = np.where(shared, np.minimum(out, a[:, k]), out)
    return out


def _pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs that this cell has to count."""
    vectors, piece = _matrix(rows.column("vector")), rows.column("piece").to_numpy()
    within = bool(rows.column("within")[0].as_py())
    left = np.arange(len(piece)) if within else np.flatnonzero(piece == piece.min())
    right = left if within else np.flatnonzero(piece != piece.min())
    i, j = np.nonzero(vectors[left] @ vectors[right].T >= COSINE)
    i, j = left[i], right[j]
    keep = (i < j) if within else np.ones(len(i), dtype=bool)
    label, leaf = rows.column("label").to_numpy(), rows.column("leaf").to_numpy()
    keep &= label[i] == label[j]
    i, j = i[keep], j[keep]
    lists = rows.column("leaves").combine_chunks()
    starts, codes = lists.offsets.to_numpy(), lists.values.to_numpy()
    lengths = np.diff(starts)
    padded = np.full((len(lengths), lengths.max()), -1)
    padded[np.arange(lengths.max()) < lengths[:, None]] = codes[starts[0] : starts[-1]]
    first = np.concatenate(
        [_first_shared(padded[i[k : k + 50_000]], padded[j[k : k + 50_000]]) for k in range(0, len(i), 50_000)]
        or [np.zeros(0, dtype=np.int64)]
    )
    keep = first == leaf[i]
    return i[keep], j[keep]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_cells(batches):
        cell = rows.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            own = rows.slice(begin, end - begin)
            i, j = _pairs(own)
            if not len(i):
                continue
            node, weight = own.column("node").to_numpy(), own.column("weight").to_numpy()
            links = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
            forest = Forest(len(node))
            forest.join(i, j)
            root = forest.flat()
            child, counted = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)
            none = [None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((node[root[child]], node[counted]))),
                    pa.array(node[child].tolist() + none * len(counted), pa.int64()),
                    pa.array(none * len(child) + links[counted].astype(np.int64).tolist(), pa.int64()),
                ],
                names=["a", "b", "links"],
            )


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).alias("label"),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0)
    rows = written(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    good = rows.where("usable")
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    classes = written(classes, "vector-classes")

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    total, largest = sizes[0] or 0, sizes[1] or 0
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    drawn = F.pmod(F.xxhash64("vector", "label", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))
    samples: dict[int, list] = {}
    for r in classes.where(drawn).orderBy("node").select("dim", "vector").collect():  # At most about SAMPLE_ROWS.
        samples.setdefault(r["dim"], []).append(r["vector"])
    forests = {dim: fit_forest(unit(np.array(v, dtype=np.float64)), largest) for dim, v in samples.items()}

    schema = ROUTED.format(classes.schema["label"].dataType.simpleString())
    routed = classes.select("node", "weight", "label", "dim", "vector").mapInArrow(_router(forests), schema)
    cells = by_cell(dealt(routed, ["label", "dim", "leaf"], F.xxhash64("node"), "vector-leaves", BLOCK))
    found = written(
        cells.select("cell", "piece", "within", "node", "weight", "label", "leaf", "leaves", "vector").mapInArrow(
            _links, FOUND
        ),
        "vector-links",
    )
    counts = written(found.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links")), "vector-counts")
    groups = written(components(found.where("links IS NULL").select("a", "b"), "vector-components"), "vector-groups")
    named = (
        classes.join(counts, classes.node == counts.a, "left")
        .join(groups.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        .select(
            F.col("label").alias("_label"),
            F.col("vector").alias("_vector"),
            "least",
            F.coalesce("component", "node").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    named = written(named, "vector-named")
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "vector-least")
    named = written(named.join(least, "component").select("_label", "_vector", "n_links", "component_id"), "vector-ids")
    joined = good.join(named, (good.label == named._label) & (good.vector == named._vector)).select(
        "vec_id", "n_links", "component_id"
    )
    alone = rows.where("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
