"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of typed tokens: numbers, units after a number, and names (runs of capitalised words inside a
sentence) turn into placeholders, all other words are lower-cased. Windows of ``WINDOW`` template tokens of documents
and benchmark items are joined on their hash, so a question asked again with other numbers or names still meets its
original. On each alignment (difference of positions) the slots are compared: an item's value must stand for one value
of the document everywhere, or the alignment is dropped. A document holds an item if the windows that remain cover at
least ``COVERAGE`` of all the item's.

A capitalised word at the start of a sentence is read both ways, as a plain word and as (part of) a name; only
``OPENERS`` are plain in any case. Windows under the second reading count if their values agree with all others of the
alignment, and drop none of the first reading.

Windows in which fewer than half of the tokens are plain words say little as templates. They are joined on their literal
values, and as templates only on alignments that other windows have found.

Documents emit only windows that pass a bit table of the benchmark's hashes. The table has ``TABLE_BITS`` bits
whatever the benchmark's size; what passes by chance is removed by the join.

Defined results: an item shorter than a window is one window of its own length; an item without any plain word matches
nothing, and one whose windows all have few plain words is found with its own values only; null and empty texts match
nothing; ids may repeat (a repeated id is judged once, on all its rows together) or be null; empty tables give an empty
result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexwarden.llm.common import CACHE_ENTRIES, table, worker_cache
from hexwarden.workspace import written

WINDOW = 8
COVERAGE = 0.8
TABLE_BITS = 22

#: Units of measure and money, English spelling unless international.
UNITS = frozenset(
    "% $ € £ ° mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters "
    "litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "degree degrees percent cent cents dollar dollars euro euros pound pounds".split()
)
#: Words that open a sentence with a capital and are no names.
OPENERS = frozenset(
    "a an the this that these those there here i he she it we you they his her its our your their my if when while as "
    "after before since because although though until unless and but or so then thus hence how what which who whom whose "
    "where why in on at by for from of to with without under over between during each every all some any no not is are "
    "was were do does did has have had can could should would let now also once both either neither".split()
)
_TOKENS = regex.compile(r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*|[.!?:\n]|[%$€£°]")
#: The same over the letters and numbers of Latin-1, for texts that hold no other characters.
_LATIN_LETTERS, _LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_LATIN_TOKENS = re.compile(f"[{_LATIN_LETTERS}]+|[{_LATIN_NUMBERS}]+(?:[.,][{_LATIN_NUMBERS}]+)*|[.!?:\n]|[%$£°]")
_PLAIN, _NUMBER, _UNIT, _CAPITAL, _STOP, _NAME, _OPENER = range(7)
#: Kinds of windows: joined as templates, joined on literal values, templates looked for on known alignments.
_RICH, _LITERAL, _POOR = range(3)
_PLACEHOLDER = {_NUMBER: 0x9E3779B97F4A7C15, _UNIT: 0xC2B2AE3D27D4EB4F, _NAME: 0x165667B19E3779F9}
_HAS_PLACE = np.array([kind in _PLACEHOLDER for kind in range(7)])
_PLACES = np.array([_PLACEHOLDER.get(kind, 0) for kind in range(7)], dtype=np.uint64)
_BASE = np.uint64(0x100000001B3 * 2 + 1)

WINDOW_SCHEMA = "id long, hash long, pos long, n_windows long, slots array<long>, kind int, second boolean"


def _token_code(token: str) -> int:
    """Hash of the lower-cased token above three bits of its kind."""
    first, lower = token[0], token.lower()
    if first in ".!?:\n":
        kind = _STOP
    elif first.isnumeric():
        kind = _NUMBER
    elif lower in UNITS:
        kind = _UNIT
    elif lower != token and first.isupper() and len(token) > 1 and token[1:].islower():
        kind = _OPENER if lower in OPENERS else _CAPITAL
    else:
        kind = _PLAIN
    return (xxhash.xxh64_intdigest(lower.encode()) >> 4) << 3 | kind


def tokens_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _TOKENS.findall(text)
    return _LATIN_TOKENS.findall(text)


class _Codes(dict):
    def __missing__(self, token: str) -> int:
        code = self[token] = _token_code(token)
        return code


class Reading(NamedTuple):
    """Template tokens: template hash, slot value, plain flag, whether a sentence's first word is (part of) one, and the
    place of the first word."""

    hashed: np.ndarray
    value: np.ndarray
    plain: np.ndarray
    opens: np.ndarray
    place: np.ndarray


def _template(kind: np.ndarray, value: np.ndarray, opens: np.ndarray) -> Reading:
    more_of_name = (kind == _NAME) & (np.concatenate(([_STOP], kind[:-1])) == _NAME) if len(kind) else kind == _NAME
    # A run of names is one slot; its value is the last word, as the first may only begin a sentence.
    place = np.flatnonzero(~more_of_name)
    if len(place):
        value = value[np.concatenate((place[1:], [len(value)])) - 1]
        kind = kind[place]
    keep = kind != _STOP
    kind, value, place = kind[keep], value[keep], place[keep]
    hashed = np.where(_HAS_PLACE[kind], _PLACES[kind], value)
    return Reading(hashed, value, kind == _PLAIN, opens[place], place)


def readings(text: str | None, code_of) -> list[Reading]:
    """The template with sentences' first words as plain words, then, if there are such words, with them as names."""
    tokens = tokens_of(text or "")
    raw = np.fromiter(map(code_of, tokens), dtype=np.int64, count=len(tokens))
    kind, value = raw & 7, (raw >> 3).astype(np.uint64)
    before = np.concatenate(([_STOP], kind[:-1])) if len(kind) else kind
    kind = np.where(((kind == _CAPITAL) | (kind == _OPENER)) & (before != _STOP), _NAME, kind)
    kind = np.where((kind == _UNIT) & (before != _NUMBER), _PLAIN, kind)
    kind[kind == _OPENER] = _PLAIN
    opens = kind == _CAPITAL
    out = [_template(np.where(opens, _PLAIN, kind), value, opens)]
    if opens.any():
        out.append(_template(np.where(opens, _NAME, kind), value, opens))
    return out


def _sums(flags: np.ndarray, size: int) -> np.ndarray:
    counts = np.concatenate(([0], np.cumsum(flags)))
    return counts[size:] - counts[:-size]


def hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` tokens."""
    n = len(hashed) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = total * _BASE + hashed[k : k + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return total


def windows(reading: Reading, size: int, second: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, positions, hashes). The second reading has those that differ from the first one's."""
    if size < 1 or len(reading.hashed) < size:
        return []
    found = hashes(reading.hashed, size)
    rich = 2 * _sums(reading.plain, size) >= size
    own = _sums(reading.opens, size) > 0 if second else np.ones(len(found), dtype=bool)
    rich_at, poor_at = np.flatnonzero(rich & own), np.flatnonzero(~rich & own)
    out = [(_RICH, rich_at, found[rich_at]), (_POOR, poor_at, found[poor_at])]
    if len(poor_at) and not second:
        out.insert(1, (_LITERAL, poor_at, ~hashes(reading.value, size)[poor_at]))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, found, at, counts, slots, kinds, second = zip(*rows, strict=True)
    columns = [pa.array(c, pa.int64()) for c in (ids, found, at, counts)]
    columns += [pa.array(slots, pa.list_(pa.int64())), pa.array(kinds, pa.int32()), pa.array(second, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WINDOW_SCHEMA.split(", ")])


def _item_rows(item_id: int | None, read: list[Reading]) -> Iterator[tuple]:
    """All windows of an item; ``pos`` is that of the first reading, and a window of the second one stands for all
    places of the first that its first token holds."""
    plain, sizes = read[0].plain, [min(WINDOW, len(r.hashed)) for r in read]
    n = len(plain) - sizes[0] + 1
    if not plain.any():
        return
    for k, (r, size) in enumerate(zip(read, sizes, strict=True)):
        place = np.searchsorted(read[0].place, r.place).tolist()
        last = len(place) - size
        for kind, at, found in windows(r, size, k > 0):
            for p, h in zip(at.tolist(), found.view(np.int64).tolist(), strict=True):
                slots = r.value[p : p + size][~r.plain[p : p + size]].astype(np.int64).tolist()
                for pos in range(place[p], min(n, place[p + 1] if p < last else n)):
                    yield item_id, h, pos, n, slots, kind, k > 0


def _document_rows(doc_id: int | None, read: list[Reading], sizes: list[int], table_of_bits: np.ndarray) -> Iterator[tuple]:
    """Windows whose bit is set; poor templates only beside others."""
    for size in sizes:
        met = False
        kept = []
        for k, r in enumerate(read):
            for kind, at, found in windows(r, size, k > 0):
                hit = table_of_bits[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                met |= kind != _POOR and bool(hit.any())
                kept.append((k, r, kind, at[hit], found[hit]))
        if not met:
            continue
        for k, r, kind, at, found in kept:
            place = np.searchsorted(read[0].place, r.place[at]).tolist()
            for p, pos, h in zip(at.tolist(), place, found.view(np.int64).tolist(), strict=True):
                slots = r.value[p : p + size][~r.plain[p : p + size]].astype(np.int64).tolist()
                yield doc_id, h, pos, 0, slots, kind, k > 0


def _emitter(sizes: list[int] | None, bits: np.ndarray | None):
    """Windows of items (their own size, all of them) or of documents (``sizes``, those whose bit is set)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = worker_cache("template codes", _Codes)
        table_of_bits = None if bits is None else np.unpackbits(bits).astype(bool)
        out: list[tuple] = []
        for batch in batches:
            for at_row in range(0, batch.num_rows, 256):
                part = batch.slice(at_row, 256)
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if len(codes) > CACHE_ENTRIES:
                        codes.clear()
                    read = readings(text, codes.__getitem__)
                    out.extend(_item_rows(doc_id, read) if sizes is None else _document_rows(doc_id, read, sizes, table_of_bits))
                if len(out) > 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return emit


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sizes = {min(WINDOW, len(r.hashed)) for t in texts for r in readings(t, codes.__getitem__)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(sizes), pa.int64())], names=["size"])


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", item_col="item_id", text_col="text") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, windows, item_windows, coverage, changed (a slot has
    another value than in the item), first_token and last_token (places of the first and last window)."""
    asked = _named(items, item_col, text_col)
    theirs = written(asked.mapInArrow(_emitter(None, None), WINDOW_SCHEMA), "templates-items")
    sizes = sorted(r["size"] for r in asked.mapInArrow(_lengths, "size long").distinct().collect() if r["size"])
    slot = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    marked = np.zeros(2**TABLE_BITS, dtype=bool)  # The table has a fixed size, so has what is collected for it.
    marked[theirs.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy(dtype=np.int64)] = True
    found = _named(docs, id_col, text_col).mapInArrow(_emitter(sizes or [WINDOW], np.packbits(marked)), WINDOW_SCHEMA)
    found = found.select(
        F.col("id").alias("doc_id"), "hash", F.col("pos").alias("doc_pos"), F.col("slots").alias("ours"),
        F.col("kind").alias("our_kind"), F.col("second").alias("our_second"),
    )
    found = written(found, "templates-found")
    asked_windows = theirs.select(
        F.col("id").alias("item_id"), "hash", "pos", F.col("n_windows").alias("item_windows"), "slots", "kind", "second"
    )
    good_pair = (F.size("ours") == F.size("slots")) & (F.col("kind") == F.col("our_kind"))
    pairs_of = [
        "doc_id", "item_id", "item_windows", "pos", "doc_pos", (F.col("doc_pos") - F.col("pos")).alias("shift"), "kind",
        ((F.col("kind") == _POOR) | F.col("second") | F.col("our_second")).alias("extra"),
        F.arrays_zip("slots", "ours").alias("pairs"),
    ]
    matched = found.where(F.col("our_kind") != _POOR).join(asked_windows.where(F.col("kind") != _POOR), "hash")
    matched = written(matched.where(good_pair).select(*pairs_of), "templates-matched")
    poor = asked_windows.where(F.col("kind") == _POOR)
    if not poor.isEmpty():
        # On the alignments found, what an item's windows of few plain words would be at their place in the document.
        at = matched.select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item"), "shift").distinct()
        due = at.join(poor, F.col("_item").eqNullSafe(F.col("item_id"))).withColumn("_at", F.col("pos") + F.col("shift"))
        due = due.drop("_item", "shift").withColumnRenamed("hash", "_hash")
        more = due.join(
            found.where(F.col("our_kind") == _POOR),
            F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_at") == F.col("doc_pos")) & (F.col("_hash") == F.col("hash")),
        )
        matched = written(matched.unionByName(more.where(good_pair).select(*pairs_of)), "templates-all")

    # Slot consistency on each alignment, of the rich windows of the first reading and of all.
    line = ["doc_id", "item_id", "shift"]
    pairs = matched.where(F.col("kind") != _LITERAL).select(*line, "extra", F.explode("pairs").alias("pair"))
    pairs = pairs.select(*line, "pair.slots", "pair.ours", "extra").groupBy(*line, "slots", "ours").agg(F.min("extra").alias("extra"))
    values = pairs.groupBy(*line, "slots").agg(F.count("*").alias("n_all"), F.count_if(~F.col("extra")).alias("n"))
    lines = values.groupBy(*line).agg((F.max("n") > 1).alias("broken"), (F.max("n_all") > 1).alias("broken_all"))
    lines = lines.select(*(F.col(c).alias(f"_{c}") for c in line), "broken", "broken_all")
    same = F.lit(True)
    for c in line:
        same = same & matched[c].eqNullSafe(lines[f"_{c}"])
    broken = F.col("broken") | (F.col("extra") & F.col("broken_all"))
    kept = (F.col("kind") == _LITERAL) | ~F.coalesce(broken, F.lit(False))
    changed = F.exists("pairs", lambda p: p["slots"] != p["ours"])
    good = matched.join(lines, same, "left").where(kept).withColumn("changed", changed)

    # The places of an item are bounded by its length.
    held = good.groupBy("doc_id", "item_id").agg(
        F.count_distinct("pos").alias("windows"),
        F.max("item_windows").alias("item_windows"),
        F.max("changed").alias("changed"),
        F.min("doc_pos").alias("first_token"),
        F.max("doc_pos").alias("last_token"),
    )
    coverage = F.col("windows") / F.col("item_windows")
    return held.where(coverage >= COVERAGE).select(
        "doc_id", "item_id", "windows", "item_windows", coverage.alias("coverage"), "changed", "first_token", "last_token"
    )


def without_benchmark(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The input's rows and columns without the documents that hold an item."""
    held = contaminated(docs, items, id_col, text_col=text_col).select(F.col("doc_id").alias("_held")).distinct()
    held = written(held, "templates-held")
    return docs.join(held, docs[id_col].cast("long").eqNullSafe(held._held), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
