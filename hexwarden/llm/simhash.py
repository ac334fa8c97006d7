"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint has 64 bits, one for each bit position of the XXH64 (seed 42) of the 3-word shingles: set if more than
half of the shingles, repeats included, have it set. Words are runs of other characters than the ASCII blanks, A-Z
lower-cased. Two fingerprints are linked at ``DISTANCE`` = 3 or fewer differing bits.

Candidates: the 64 bits are a ring of 4 segments, whose differences sum to at most 3. Then (pigeonring) there is a
start from which every chain of 1, 2, 3, 4 consecutive segments differs in at most 0, 1, 2, 3 bits. So one segment is
equal and the next differs in one bit at most: every fingerprint is filed, for each start, under these 32 bits, and
also under the variants with one set bit of the second segment cleared; of two fingerprints that differ there the one
with the set bit meets the other. The longer chains are checked before the full distance.

Equal fingerprints are one node, so copies are never paired. Groups that share 32 bits are compared in cells
(``cells.py``).

Defined results: null and empty texts have fingerprint 0, linked like any other; repeated rows and ids all appear;
``component_id`` is the smallest id reachable (null ids are skipped; null if there is no other); an empty table gives
an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from hexwarden.llm.cells import Forest, by_cell, dealt, linked_neighbours, whole_cells
from hexwarden.llm.common import no_cache, packed, table
from hexwarden.llm.components import components
from hexwarden.workspace import written

#: Fixed values of the fingerprint and of the link.
SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS, SEGMENT_BITS = 4, 16


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    # bytes.lower() and bytes.split() know exactly A-Z and the six ASCII blanks.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    size = min(SHINGLE, len(words))
    starts = [0, *ends[:-1]]
    counts, n = np.zeros(64, dtype=np.int64), len(words) - size + 1
    for at in range(0, n, 65_536):
        until = min(n, at + 65_536)
        hashes = [
            xxhash.xxh64_intdigest(line[s : e - 1], SEED)
            for s, e in zip(starts[at:until], ends[at + size - 1 : until + size - 1], strict=True)
        ]
        bits = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    no_cache()
    return texts.map(fingerprint_of).astype("int64")


def fingerprint(text: Column) -> Column:
    return _fingerprints(text)


def _filed(prints: DataFrame) -> DataFrame:
    """(fp, key, exact): every fingerprint under its keys."""
    mask, ring = (1 << SEGMENT_BITS) - 1, F.col("fp")
    entries = []
    for start in range(SEGMENTS):
        first = F.shiftrightunsigned(ring, SEGMENT_BITS * start).bitwiseAND(F.lit(mask))
        following = SEGMENT_BITS * ((start + 1) % SEGMENTS)
        second = F.shiftrightunsigned(ring, following).bitwiseAND(F.lit(mask))
        top = F.shiftleft(F.lit(start).cast("long"), 32).bitwiseOR(F.shiftleft(first, SEGMENT_BITS))
        entries.append(F.struct(top.bitwiseOR(second).alias("key"), F.lit(True).alias("exact")))
        for bit in range(SEGMENT_BITS):
            is_set = second.bitwiseAND(F.lit(1 << bit)) != 0
            cleared = top.bitwiseOR(second.bitwiseAND(F.lit(mask ^ (1 << bit))))
            entries.append(F.when(is_set, F.struct(cleared.alias("key"), F.lit(False).alias("exact"))))
    filed = prints.select("fp", F.explode(F.array_compact(F.array(*entries))).alias("entry"))
    return filed.select("fp", "entry.key", "entry.exact")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask, width = np.uint64((1 << SEGMENT_BITS) - 1), np.uint64(SEGMENT_BITS)
    for rows in whole_cells(batches):
        cell = rows.column("cell").to_numpy()
        fp = rows.column("fp").to_numpy().view(np.uint64)
        exact = rows.column("exact").to_numpy(zero_copy_only=False)
        start = (rows.column("key").to_numpy() >> 32).astype(np.uint64)
        third = width * ((start + np.uint64(2)) % np.uint64(SEGMENTS))

        def close(i, j, fp=fp, exact=exact, start=start, third=third):
            differ = fp[i] ^ fp[j]
            here, then = width * start[i], width * ((start[i] + np.uint64(1)) % np.uint64(SEGMENTS))
            two = np.bitwise_count((differ >> here) & mask) + np.bitwise_count((differ >> then) & mask)
            three = two + np.bitwise_count((differ >> third[i]) & mask)
            chain = (exact[i] | exact[j]) & (three <= 2)
            good = np.zeros(len(i), dtype=bool)
            good[chain] = np.bitwise_count(differ[chain]) <= DISTANCE
            return good

        forest = Forest(len(cell))
        for left, right in linked_neighbours(cell, close):
            forest.join(left, right)
        root = forest.flat()
        child = np.flatnonzero(root != np.arange(len(root)))
        if len(child):
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[root[child]]), pa.array(signed[child])], names=["a", "b"])


def print_components(prints: DataFrame, label: str = "simhash") -> DataFrame:
    """``prints`` (fp; distinct) to (node, component) for the fingerprints that have a link."""
    cells = by_cell(dealt(_filed(prints), ["key"], F.xxhash64("fp"), label))
    edges = cells.select("cell", "key", "fp", "exact").mapInArrow(_links, "a long, b long")
    return components(edges, f"{label}-components")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "simhash-prints"
    )
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    groups = written(print_components(classes.select("fp")), "simhash-groups")
    named = classes.join(groups, classes.fp == groups.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = written(named, "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = written(named.join(written(least, "simhash-least"), "component").select("fp", "component_id"), "simhash-ids")
    return prints.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The input's rows without near duplicates: of each component the row of the smallest id stays."""
    row_id, text = F.col("row")[id_col], F.col("row")[text_col]
    prints = written(packed(docs).withColumn("fp", fingerprint(text)), "simhash-docs")
    groups = written(print_components(prints.select("fp").distinct()), "simhash-groups")
    named = prints.join(groups, prints.fp == groups.node, "left").withColumn("group", F.coalesce("component", "fp"))
    # Null ids come last; of rows that repeat an id the one with the smallest fingerprint and text hash stays.
    rank = F.struct(row_id.isNull(), row_id, F.col("fp"), F.xxhash64(text))
    first = written(named.groupBy("group").agg(F.min(rank).alias("first")), "simhash-first")
    winners = named.join(first, "group").where(rank.eqNullSafe(F.col("first")))
    return winners.dropDuplicates(["group"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
