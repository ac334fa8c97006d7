"""Suffix-array deduplication of byte strings: remove every byte covered by a ``LENGTH``-byte string that also starts
anywhere else in the corpus, the same document included; overlaps count, and strings are judged on the input.

1. Anchors. Of the hashed ``GRAM``-byte substrings of a ``LENGTH``-byte string the leftmost smallest is its anchor.
   Consecutive starts with the same anchor in the same place form a run; its window is the text of all its strings. Equal strings have equal anchors,
   so only windows with the same anchor can share a string.
2. Windows that occur more than once are repeated as a whole. What is left to decide are anchors with several different
   windows: their windows, one copy of each, are dealt by anchor.
3. Shards. A task holds many anchors; of a window it takes the cells of starts whose common core another window has; it splits these texts into shards, builds the Burrows-Wheeler transform of each
   and merges them by interleave refinement (``bwt.py``) up to ``LENGTH`` bytes. Blocks of two or more rows are
   the repeated strings. No text is sorted again after its shard.
4. The runs' places give byte ranges, gathered per document, and the rest of the text is hashed.

An anchor with more than ``ANCHOR_WINDOWS`` different windows (the edge of a passage that very many documents share) is
not held by one task: its cells, and the strings of the few cells that stay open, are counted by their bytes or 128-bit
hashes, which aggregates before the shuffle.

Defined results: null texts are empty, and texts shorter than ``LENGTH`` bytes are kept whole; a row that is repeated
(same id, same text) counts as a document of its own, as do rows with equal or null ids; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexwarden.llm.bits import bit_table, passes
from hexwarden.llm.bwt import Shard, repeated
from hexwarden.llm.cells import whole_cells
from hexwarden.llm.common import table
from hexwarden.workspace import written

LENGTH = 200
GRAM = 32
SHARDS = 8
#: Text that is merged at a time, and different windows of an anchor that one task takes.
MERGE_BYTES = 1 << 20
ANCHOR_WINDOWS = 512
#: Starts that are looked at together before texts are merged.
CELL = 16

RUNS = "anchor long, window long, id long, text_hash long, size int, starts array<int>"
TEXTS = "anchor long, window long, text binary"
SPANS = "anchor long, window long, spans array<struct<first:int,last:int>>"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _slide(values: np.ndarray, width: int, take) -> np.ndarray:
    """The minimum or maximum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = take(values[:-reach], values[reach:])
        reach *= 2
    return take(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` bytes; ``gram`` is a power of 2."""
    hashed, width, power = data.astype(np.uint64), 1, int(_ODD)
    while width < gram:
        hashed = hashed[:-width] * np.uint64(power) + hashed[width:]
        width, power = 2 * width, power * power % 2**64
    hashed ^= hashed >> np.uint64(32)
    hashed *= _MIX
    return hashed ^ hashed >> np.uint64(32)


def anchored_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, anchors): the starts in [cuts[k], cuts[k + 1]) have the anchor hash anchors[k]."""
    hashed = _gram_hashes(data, gram)
    least = _slide(hashed, length - gram + 1, np.minimum)
    # A run ends where the smallest hash changes, or where its leftmost place is left behind for an equal one.
    ends = (least[1:] != least[:-1]) | (hashed[: len(least) - 1] == least[:-1])
    cuts = np.concatenate(([0], np.flatnonzero(ends) + 1, [len(least)]))
    # Minima are small numbers; as keys they are spread again.
    anchors = least[cuts[:-1]] * _ODD
    return cuts, anchors ^ anchors >> np.uint64(29)


def anchor_places(texts: list[bytes]) -> np.ndarray:
    """Where the anchor of each window stands in it: the leftmost smallest hash of the window."""
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    hashed = _gram_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), GRAM)
    inside = np.ones(len(hashed), dtype=bool)
    for k in range(1, GRAM):  # Grams that reach into the next window.
        inside[begins[1:] - k] = False
    hashed[~inside] = np.uint64(2**64 - 1)
    least = np.minimum.reduceat(hashed, begins)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(hashed)]
    hits = np.flatnonzero((hashed == least[owner]) & inside)
    return hits[np.searchsorted(owner[hits], np.arange(len(texts)))] - begins


def cells_of(text: bytes, place: int):
    """A window's starts in cells that are laid out from the anchor, so they agree between windows of an anchor:
    (cell, first start, last start, core). The core is what all strings that can start in the cell have in common."""
    starts = len(text) - LENGTH + 1
    for cell in range((place - starts + 1) // CELL, place // CELL + 1):
        latest, earliest = place - cell * CELL, place - cell * CELL - CELL + 1
        yield cell, max(0, earliest), min(starts - 1, latest), text[latest : earliest + LENGTH]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different run of a document once, with the places where it starts."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            columns: list[list] = [[] for _ in names]
            for doc_id, text_hash, text in zip(
                *(part.column(c).to_pylist() for c in ("id", "text_hash", "text")), strict=True
            ):
                raw = text.encode()
                if len(raw) < LENGTH:
                    continue
                cuts, anchors = anchored_runs(np.frombuffer(raw, dtype=np.uint8))
                places: dict[tuple[int, int], tuple[int, list[int]]] = {}
                cuts = cuts.tolist()
                for begin, end, anchor in zip(cuts, cuts[1:], anchors.view(np.int64).tolist(), strict=False):
                    window = _signed(xxhash.xxh3_64_intdigest(raw[begin : end + LENGTH - 1]))
                    places.setdefault((anchor, window), (end - begin, []))[1].append(begin)
                for (anchor, window), (size, starts) in places.items():
                    for column, value in zip(columns, (anchor, window, doc_id, text_hash, size, starts), strict=True):
                        column.append(value)
            types = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int32())]
            if columns[0]:
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


def _window_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the windows that a document stands for."""
    for batch in batches:
        anchors, windows, texts = [], [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = text.encode()
            for w in wanted:
                anchors.append(w["anchor"])
                windows.append(w["window"])
                texts.append(raw[w["start"] : w["start"] + w["size"] + LENGTH - 1])
        columns = [pa.array(anchors, pa.int64()), pa.array(windows, pa.int64()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "window", "text"])


def _spans_of(string: np.ndarray, offset: np.ndarray) -> dict[int, list[dict]]:
    """String -> runs of consecutive offsets."""
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    fresh = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))))
    last = np.concatenate((fresh[1:], [len(string)])) - 1
    out: dict[int, list[dict]] = {}
    if len(string):
        for k, first, end in zip(string[fresh].tolist(), offset[fresh].tolist(), offset[last].tolist(), strict=True):
            out.setdefault(k, []).append({"first": first, "last": end})
    return out


def _merged(rows: pa.Table) -> pa.RecordBatch:
    """The repeated starts of the windows of some anchors."""
    texts, anchors = rows.column("text").to_pylist(), rows.column("anchor").to_pylist()
    # Only starts whose cell has its core in another window can be repeated: the rest of a window is not merged.
    cells = [list(cells_of(text, place)) for text, place in zip(texts, anchor_places(texts).tolist(), strict=True)]
    cores = Counter((a, cell, core) for a, own in zip(anchors, cells, strict=True) for cell, _, _, core in own)
    parts = []
    for i, (a, own) in enumerate(zip(anchors, cells, strict=True)):
        left = [(first, last) for cell, first, last, core in own if cores[a, cell, core] > 1]
        if left:
            begin, end = min(left)[0], max(left)[1]
            parts.append((i, begin, texts[i][begin : end + LENGTH]))
    dealt = [parts[k::SHARDS] for k in range(min(SHARDS, len(parts)))]
    shards = [
        Shard(np.frombuffer(b"".join(t for _, _, t in own), dtype=np.uint8), np.cumsum([0] + [len(t) for _, _, t in own]))
        for own in dealt
    ]
    found = {}
    for own, (string, offset) in zip(dealt, repeated(shards, LENGTH) if shards else [], strict=True):
        for k, spans in _spans_of(string, offset).items():
            i, begin, _ = own[k]
            found[i] = [{"first": begin + s["first"], "last": begin + s["last"]} for s in spans]
    at = pa.array(sorted(found), pa.int64())
    spans = pa.array([found[i] for i in sorted(found)], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
    columns = [rows.column(c).combine_chunks().take(at) for c in ("anchor", "window")]
    return pa.RecordBatch.from_arrays([*columns, spans], names=["anchor", "window", "spans"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_cells(batches, "anchor"):
        anchor = rows.column("anchor").to_numpy()
        sizes = np.cumsum([len(t) for t in rows.column("text").to_pylist()])
        ends = [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
        begin = 0
        for end, following in zip(ends, [*ends[1:], None], strict=True):
            done = sizes[begin - 1] if begin else 0
            if following is None or sizes[following - 1] - done > MERGE_BYTES:
                yield _merged(rows.slice(begin, end - begin))
                begin = end


def _crowd_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts, out = part.column("text").to_pylist(), []
            keys = zip(part.column("anchor").to_pylist(), part.column("window").to_pylist(), strict=True)
            for (anchor, window), text, place in zip(keys, texts, anchor_places(texts).tolist(), strict=True):
                for cell, first, last, core in cells_of(text, place):
                    own = text[first : last + LENGTH]
                    out.append((anchor, window, cell, first, last, core, own))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.binary()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "window", "cell", "first", "last", "core", "own"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a cell by its 128-bit hash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            out = []
            rows = batch.slice(at, 512)
            for anchor, window, first, text in zip(
                *(rows.column(c).to_pylist() for c in ("anchor", "window", "first", "own")), strict=True
            ):
                for k in range(len(text) - LENGTH + 1):
                    both = xxhash.xxh3_128_intdigest(text[k : k + LENGTH])
                    out.append((anchor, window, first + k, _signed(both >> 64), _signed(both & (1 << 64) - 1)))
            if out:
                arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "window", "start", "high", "low"])


def _crowded(texts: DataFrame) -> DataFrame:
    """Spans of the windows of crowded anchors, by counting: cells whose core occurs once are out, cells that occur
    again are repeated as a whole, and of the few others, at the edge of what is shared, each string is counted."""
    schema = "anchor long, window long, cell int, first int, last int, core binary, own binary"
    cells = written(texts.mapInArrow(_crowd_cells, schema), "repeats-cells")

    def again(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)

    shared = ["anchor", "cell", "core"]
    cells = written(cells.join(written(again(cells, *shared), "repeats-cores"), shared).drop("core"), "repeats-shared-cells")
    same = ["anchor", "cell", "own"]
    equal = written(again(cells, *same), "repeats-equal-cells")
    whole = cells.join(equal, same).select("anchor", "window", "first", "last")
    edge = written(cells.join(equal, same, "left_anti"), "repeats-edge-cells")
    # Strings that start in a cell can also be found in a whole one: one copy of each is counted with the others.
    copies = equal.select("anchor", F.lit(None).cast("long").alias("window"), F.lit(0).alias("first"), "own", "cell")
    there = copies.join(edge.select("anchor", "cell").distinct(), ["anchor", "cell"], "left_semi").drop("cell")
    asked = edge.select("anchor", "window", "first", "own").unionByName(there)
    strings = written(
        asked.mapInArrow(_strings, "anchor long, window long, start long, high long, low long"), "repeats-strings"
    )
    key = ["anchor", "high", "low"]
    found = strings.where("window IS NOT NULL").join(written(again(strings, *key), "repeats-again"), key)
    at = F.col("start").cast("int")
    spans = whole.unionByName(found.select("anchor", "window", at.alias("first"), at.alias("last")))
    return spans.groupBy("anchor", "window").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
            raw = text.encode()
            kept, n_spans, at = hashlib.sha256(), 0, 0
            for r in sorted(ranges or [], key=lambda r: r["first"]):
                if r["first"] > at or not n_spans:
                    kept.update(raw[at : r["first"]])
                    n_spans += 1
                at = max(at, r["last"])
            n_kept = len(raw) - _covered(ranges)
            kept.update(raw[at:])
            out.append((doc_id, len(raw), len(raw) - n_kept, n_spans, kept.hexdigest()))
        if out:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _covered(ranges: list[dict] | None) -> int:
    total = at = 0
    for r in sorted(ranges or [], key=lambda r: r["first"]):
        total += max(0, r["last"] - max(at, r["first"]))
        at = max(at, r["last"])
    return total


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text_hash, text; no nulls) to (id, text_hash, ranges): byte ranges [first, last) of repeats."""
    runs = written(docs.mapInArrow(_runs, RUNS), "repeats-runs")
    totals = runs.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).where("n > 1")
    shared = written(runs.where(passes(bit_table(totals, "anchor"), F.col("anchor"))), "repeats-shared")

    # One row per window: how often it occurs, and where it stands first.
    place = F.struct("id", "text_hash", F.col("starts")[0].alias("start"), "size")
    windows = written(
        shared.groupBy("anchor", "window").agg(F.sum(F.size("starts")).alias("n"), F.min(place).alias("place")),
        "repeats-windows",
    )
    several = windows.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1")
    open_windows = windows.join(written(several, "repeats-several"), "anchor")
    wanted = F.struct("anchor", "window", F.col("place.start").alias("start"), F.col("place.size").alias("size"))
    wanted = open_windows.groupBy(F.col("place.id").alias("w_id"), F.col("place.text_hash").alias("w_hash")).agg(
        F.collect_list(wanted).alias("wanted")
    )
    wanted = written(wanted, "repeats-wanted")
    sources = docs.where(passes(bit_table(wanted, "w_hash"), F.col("text_hash"))).dropDuplicates(["id", "text_hash"])
    sources = sources.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
    texts = written(sources.select("text", "wanted").mapInArrow(_window_texts, TEXTS), "repeats-texts")

    crowds = written(several.where(F.col("different") > ANCHOR_WINDOWS).select("anchor"), "repeats-crowds")
    few = texts.join(crowds, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    spans = few.mapInArrow(_merge, SPANS)
    if not crowds.isEmpty():
        spans = spans.unionByName(_crowded(texts.join(crowds, "anchor", "left_semi")))
    spans = written(spans, "repeats-spans")

    # A window that occurs again is repeated from its first start to its last.
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("place.size") - 1).cast("int").alias("last")))
    known = windows.where("n > 1").select("anchor", "window", whole.alias("spans"))
    partly = spans.join(windows.where("n = 1").select("anchor", "window"), ["anchor", "window"])
    known = written(known.unionByName(partly), "repeats-known")
    found = shared.join(known, ["anchor", "window"]).select("id", "text_hash", F.explode("starts").alias("start"), "spans")
    found = found.select("id", "text_hash", "start", F.explode("spans").alias("span"))
    piece = F.struct(
        (F.col("start") + F.col("span.first")).alias("first"), (F.col("start") + F.col("span.last") + LENGTH).alias("last")
    )
    return written(found.groupBy("id", "text_hash").agg(F.collect_set(piece).alias("ranges")), "repeats-ranges")


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Ranges depend on the text alone, so a null id may share the key of id 0.
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    ranges = repeated_ranges(rows.select("id", "text_hash", "text"))
    hit = passes(bit_table(ranges, "text_hash"), F.col("text_hash"))
    marked = rows.withColumn("hit", hit)
    untouched = marked.where("NOT hit").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
    ranges = ranges.withColumnsRenamed({"id": "r_id", "text_hash": "r_hash"})
    touched = marked.where("hit").join(
        ranges, (F.col("id") == F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left"
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return untouched.unionByName(touched.select("doc_id", "text", "ranges").mapInArrow(_finish, schema))


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
