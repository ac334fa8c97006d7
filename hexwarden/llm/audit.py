"""Filter interaction audit: what five filters remove in each of their 120 orders.

The first four conditions are read off a text. The fifth, a copy of a text with a smaller id, is found by compressed
tries of whole texts:

* a task that reads documents keeps the texts of some 16 MB at a time; of the rows that share a text there, only those
  of the smallest id go on as candidates, the others are copies already. So a text that a third of all rows hold is sent
  on a few times a task, not once a row;
* candidates are dealt by the text's first characters. A prefix whose texts pass ``TRIE_BYTES`` is lengthened fourfold
  until its texts fit or are all one text, so a range of texts is as narrow as its data is dense;
* each range is one radix trie, built in one task: edges hold runs of bytes, terminals the smallest id that ended there.
  A second walk over the range's rows marks those whose id is larger.

What is left of a document then is its part and a mask of five bits; rows are counted by part, mask and labels before
any shuffle, and the orders are unrolled from these counts, of which a part has at most 128.

Defined results: a null or empty text has no words (it fails A alone, and E where an earlier id has such a text; null
and empty are one text); a null lang is the part ''; rows with the same id and text are no copies of each other; a row
with a null id is never a copy and makes none; of several labels of an id any 1 counts; an empty table gives no rows.
Texts of any length are taken whole: a trie holds each byte of its distinct texts once. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexwarden.llm.common import table
from hexwarden.workspace import written

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
COPY = 16  # the bit of E

#: Bytes of distinct texts that a reading task keeps before it passes them on.
KEPT_BYTES = 16 * 2**20
#: Bytes of texts that one trie is made of, unless they are one text.
TRIE_BYTES = 32 * 2**20
FIRST_PREFIX, LONGER = 8, 4

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # all bytes of a code point but its first

MASKED = "doc_id long, part string, mask int, text binary"


def mask_of(text: bytes) -> int:
    """Bits of A to D; bytes split at the six blanks, which are all ASCII blanks of ``split``."""
    words = text.split()
    n = len(words)
    mask = 1 if n < LEAST_WORDS else 0
    if 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * n:
        mask |= 2
    size = len(text)
    capitals = size - len(text.translate(None, _CAPITALS))
    if 100 * capitals > MOST_CAPITALS_PERCENT * len(text.translate(None, _FOLLOWING)):
        mask |= 4
    if len(text.translate(None, _SYMBOLS)) < size:
        mask |= 8
    return mask


class _Kept:
    """Rows of a task by text, up to ``KEPT_BYTES`` of texts."""

    def __init__(self):
        self.of_text: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, text: bytes, doc_id: int, part: str) -> tuple | None:
        """Put a row among the candidates of its text; what is returned is a copy for certain."""
        found = self.of_text.get(text)
        if found is None:
            self.of_text[text] = [mask_of(text), doc_id, [part]]
            self.bytes += len(text)
            return None
        mask, smallest, parts = found
        if doc_id > smallest:
            return doc_id, part, mask | COPY
        if doc_id == smallest:
            parts.append(part)
            return None
        found[1], found[2] = doc_id, [part]
        if len(parts) > 1:
            # Repeated rows of one id; all but one are passed on below as copies.
            return [(smallest, p, mask | COPY) for p in parts]
        return smallest, parts[0], mask | COPY

    def candidates(self) -> list[tuple]:
        return [(i, p, mask, text) for text, (mask, i, parts) in self.of_text.items() for p in parts]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_id, part, mask[, text]) as a batch of ``MASKED``."""
    columns = list(zip(*((*r, None)[:4] for r in rows), strict=True))
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
    names = ("doc_id", "part", "mask", "text")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of at most some 4 MB of text."""
    start = held = 0
    for at, row in enumerate(rows):
        held += len(row[3]) if len(row) > 3 and row[3] else 16
        if held > 4 * 2**20:
            yield _batch(rows[start : at + 1])
            start, held = at + 1, 0
    if start < len(rows):
        yield _batch(rows[start:])


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to masks; only candidates carry their text on."""
    kept = _Kept()
    for batch in batches:
        done = []
        ids, parts, texts = (batch.column(c) for c in ("doc_id", "part", "text"))
        for at in range(batch.num_rows):
            doc_id, part, text = ids[at].as_py(), parts[at].as_py(), texts[at].as_py()
            if doc_id is None:
                done.append((None, part, mask_of(text)))
                continue
            copy = kept.add(text, doc_id, part)
            if copy:
                done.extend(copy if isinstance(copy, list) else [copy])
            if kept.bytes > KEPT_BYTES:
                yield from _batches(kept.candidates())
                kept = _Kept()
        if done:
            yield _batch(done)
    yield from _batches(kept.candidates())


class Trie:
    """A radix trie of byte strings. A node is [text, start, end, smallest id or None, children by first byte]: its
    edge is a slice of some text that passed it, so no text is copied."""

    def __init__(self):
        self.root = [b"", 0, 0, None, {}]

    def insert(self, text: bytes, doc_id: int) -> list:
        """Put the text in; returns its terminal, whose place [3] holds the smallest id so far. A later split keeps
        the terminal itself and puts a new node above it."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            children = node[4]
            child = children.get(text[at])
            if child is None:
                leaf = [text, at, size, doc_id, {}]
                children[text[at]] = leaf
                return leaf
            edge_text, start, end = child[0], child[1], child[2]
            length = _common(edge_text, start, end, text, at)
            if length < end - start:
                above = [edge_text, start, start + length, None, {edge_text[start + length]: child}]
                child[1] = start + length
                children[text[at]] = above
                child = above
            node, at = child, at + length
        if node[3] is None or doc_id < node[3]:
            node[3] = doc_id
        return node


def _common(edge: bytes, start: int, end: int, text: bytes, at: int) -> int:
    """Length of the common start of edge[start:end] and text[at:], by doubling and halving."""
    most = min(end - start, len(text) - at)
    if edge[start : start + most] == text[at : at + most]:
        return most
    same, step = 0, 8
    while same + step < most and edge[start + same : start + same + step] == text[at + same : at + same + step]:
        same += step
        step *= 2
    low, high = same, min(most, same + step)  # equal up to low; not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if edge[start + low : start + middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle
    return low


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates, sorted by prefix, to masks with the bit of E; one trie at a time."""
    trie, now, rows = Trie(), None, []

    def marked():
        for at in range(0, len(rows), 50_000):
            yield _batch([(i, p, mask | (COPY if i > end[3] else 0)) for i, p, mask, end in rows[at : at + 50_000]])

    for batch in batches:
        ids, parts, masks = (batch.column(c).to_pylist() for c in ("doc_id", "part", "mask"))
        prefixes, texts = batch.column("prefix"), batch.column("text")
        for at, doc_id in enumerate(ids):
            prefix = prefixes[at].as_py()
            if prefix != now:
                yield from marked()
                trie, now, rows = Trie(), prefix, []
            rows.append((doc_id, parts[at], masks[at], trie.insert(texts[at].as_py(), doc_id)))
    yield from marked()


def with_prefixes(candidates: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Add ``prefix``: the first characters of the text, as many as it takes for a range of bounded size."""
    text = F.col("text").cast("string")
    keyed = candidates.withColumn("prefix", F.substring(text, 1, FIRST_PREFIX))
    length = FIRST_PREFIX
    while True:
        sizes = keyed.groupBy("prefix").agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(F.length(text)).alias("longest"))
        dense = sizes.where((F.col("bytes") > trie_bytes) & (F.col("longest") > length))
        dense = written(dense.select(F.col("prefix").alias("dense")), "audit-prefixes")
        if dense.isEmpty():
            return keyed
        length *= LONGER
        deeper = F.when(F.col("dense").isNotNull(), F.substring(text, 1, length)).otherwise(F.col("prefix"))
        keyed = keyed.join(dense, F.col("prefix") == F.col("dense"), "left").withColumn("prefix", deeper).drop("dense")


def failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per document: doc_id, part, mask (bit k set if it fails the filter ``FILTERS[k]``)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    masked = written(rows.mapInArrow(_masks, MASKED), "audit-masks")
    candidates = with_prefixes(masked.where("text IS NOT NULL"), trie_bytes)
    ranges = candidates.repartition("prefix").sortWithinPartitions("prefix")
    walked = ranges.mapInArrow(_walk, MASKED)
    return walked.unionByName(masked.where("text IS NULL")).drop("text")


def label_of_id(labels: DataFrame) -> DataFrame:
    """of, good, toxic (0 or 1) of ids with a label."""
    one = {c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))) for c in ("quality", "toxic")}
    ids = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of"))
    return ids.agg(one["quality"].alias("good"), one["toxic"].alias("toxic"))


def _orders() -> DataFrame:
    steps = [
        (f"'{''.join(o)}'", s + 1, 1 << FILTERS.index(o[s]), sum(1 << FILTERS.index(f) for f in o[:s]))
        for o in permutations(FILTERS)
        for s in range(len(FILTERS))
    ]
    rows = ", ".join(f"named_struct('filter_order', {o}, 'step', {s}, 'bit', {b}, 'before', {p})" for o, s, b, p in steps)
    return F.expr(f"inline(array({rows}))")


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for each part, order and step; ``failed`` is what ``failures`` gives."""
    known = failed.join(label_of_id(labels), F.col("doc_id") == F.col("of"), "left")
    good, toxic = (F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic"))
    counts = known.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(good).cast("long").alias("good"), F.sum(toxic).cast("long").alias("toxic")
    )
    rows = written(counts, "audit-counts").select("*", _orders())
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition, column="n", name=""):
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("long").alias(name)

    steps = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone, name="kept"),
        total(fails & ~gone, name="removed"),
        total(fails & gone, name="redundant"),
        total(F.col("mask") == F.col("bit"), name="unique_fails"),
        total(fails & ~gone, "good", "good_lost"),
        total(fails & ~gone, "toxic", "toxic_lost"),
    )
    over_orders = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows each
    return steps.withColumn("shapley", over_orders.cast("long")).drop("bit")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), label AS (
  SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), smallest AS (
  SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), masks AS (
  SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
               + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
               + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts JOIN smallest USING (text) LEFT JOIN label USING (doc_id)
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), summed AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & bit = 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM summed
"""
