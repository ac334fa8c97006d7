"""Grouping of spelling variants: words one edit apart, each led to its most frequent form.

Runs of letters are counted per task and summed. To find words one edit apart a word is cut into two disjoint chunks, its
halves; one edit leaves a half whole, and a word of the same length, or one code point longer, holds that half as a
gram at its own place or, where the edit lies before it, shifted by the difference of lengths, at most one. The rest of
the word is cut the same way once more, as halves of short words are shared by thousands: a key is a whole half plus
the half of the rest that the edit spares, four keys a word. The shorter word of a pair gives the chunks, the other
one its grams at these places; of equal words both do, and the smaller one stands left. Keys are joined as hashes;
every pair that meets is verified by its edit distance, so a hash only proposes. A bucket of a key holds words that
differ in a quarter of their letters, so it does not grow with how often words occur.

Forms double the count, so following them ends; ``roots`` follows twice as far in each round.

Defined results: a null or empty text has no words; a null id counts as the empty text before the colon; rows that
share an id count one by one; a word that no other is near has form null and is its own root; of several most
frequent near words the smallest in code-point order is the form; an empty table gives no rows. A text of any length is
taken whole, a megabyte of letters at a time. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexwarden.llm.common import table
from hexwarden.workspace import written

#: A letter, what is lower-cased, and the rule that takes a code point out of one run in 97.
LETTERS = "A-Za-zÀ-ÿ"
TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
ONE_IN = 97
LEAST_LENGTH, LEAST_TIMES = 5, 3
#: A form has at least so many times the word's count.
FORM_TIMES = 2

#: Distinct words that a task counts before it passes them on, and code points that are cut into runs at a time.
COUNTED_WORDS = 200_000
CUT_AT = 2**20


def runs(text: str, letters: re.Pattern, most: int = CUT_AT) -> Iterator[list[str]]:
    """The runs of letters of a text, some at a time; none is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        further = letters.match(text, end)
        if further:
            end = further.end()
        yield letters.findall(text, at, end)
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = re.compile(f"[{LETTERS}]+")
    counted: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counted.keys(), pa.string()), pa.array(counted.values(), pa.int64())], names=["word", "n"]
        )

    for rows in batches:
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text")
        for at, doc_id in enumerate(ids):
            of_text: Counter[str] = Counter()
            for found in runs(texts[at].as_py().translate(TO_LOWER), letters):
                of_text.update(found)
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in of_text.items():
                h = zlib.crc32(word.encode(), start)
                if not h % ONE_IN:
                    cut = h % len(word)
                    word = word[:cut] + word[cut + 1 :]
                if len(word) >= LEAST_LENGTH:
                    counted[word] += n
            if len(counted) > COUNTED_WORDS:
                yield batch()
                counted.clear()
    if counted:
        yield batch()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_TIMES) -> DataFrame:
    """word, n of the words of enough code points that occur often enough."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least)


def _keys(length: Column, shift: int) -> list[Column]:
    """Keys of a word read as the partner of a word of ``length``, ``shift`` code points shorter: for each quarter that
    may hold the edit, what stands before it and what stands after it."""
    half = F.floor(length / 2).cast("int")
    ends = [F.lit(0), F.floor(half / 2).cast("int"), half, F.floor((half + length) / 2).cast("int"), length]
    word = F.col("word")
    keys = []
    for quarter in range(4):
        first, last = ends[quarter], ends[quarter + 1] + shift
        before, after = word.substr(F.lit(1), first), word.substr(last + 1, F.length(word))
        keys.append(F.xxhash64(length, F.lit(quarter), before, after))
    return keys


def near_pairs(known: DataFrame) -> DataFrame:
    """Pairs of words (``word``, ``n``; each word once) one edit apart, once each: a, a_n, b, b_n."""
    size = F.length("word").cast("int")
    chunks = known.select("word", "n", F.explode(F.array(*_keys(size, 0))).alias("key"))
    longer = known.select("word", "n", F.explode(F.array(*_keys(size - 1, 1))).alias("key"))
    left = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = chunks.unionByName(longer).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = left.join(right, "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def forms(pairs: DataFrame) -> DataFrame:
    """word, n_near, form, form_n (null where no near word is frequent enough) of words with a near word."""
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    found = both.groupBy("word").agg(
        F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    far_more = -F.col("best.less") >= FORM_TIMES * F.col("n")
    return found.select(
        "word", "n_near", F.when(far_more, F.col("best.other")).alias("form"), F.when(far_more, -F.col("best.less")).alias("form_n")
    )


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the rows (word, form) with a form."""
    now = written(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        moved = written(moved, "spelling-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    known = written(words(docs, id_col, text_col), "spelling-words")
    formed = written(forms(near_pairs(known)), "spelling-forms")
    ends = roots(formed)
    joined = known.join(formed, "word", "left").join(ends, "word", "left")
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Near words share what is left when one letter of each, or of the longer one, is taken out; CRC-32 byte by byte.
SQL = rf"""
WITH RECURSIVE crc_steps AS (
  SELECT range AS byte, range AS crc, 0 AS step FROM range(256) UNION ALL
  SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(3988292384, crc >> 1) ELSE crc >> 1 END, step + 1 FROM crc_steps WHERE step < 8
), crc_table AS MATERIALIZED (
  SELECT list(crc ORDER BY byte) AS t FROM crc_steps WHERE step = 8
), found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) AS run
  FROM documents
), counted AS MATERIALIZED (
  SELECT doc, run, count(*) AS n FROM found GROUP BY doc, run
), folding AS (
  SELECT doc, run, n, hex(encode(doc || ':' || run)) AS hex, 0 AS pos, 4294967295 AS crc FROM counted UNION ALL
  SELECT doc, run, n, hex, pos + 2, xor(crc >> 8, t[(xor(crc, ('0x' || substr(hex, pos + 1, 2))::BIGINT) & 255) + 1])
  FROM folding, crc_table WHERE pos < length(hex)
), hashed AS (
  SELECT run, n, xor(crc, 4294967295) AS h FROM folding WHERE pos = length(hex)
), changed AS (
  SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_TIMES}
), taken_out AS MATERIALIZED (
  SELECT word, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM taken_out a JOIN taken_out b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM taken_out WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM taken_out WHERE rest IN (SELECT word FROM words)
), ranked AS (
  SELECT near.word, w.n, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN words w ON w.word = near.word JOIN words o ON o.word = other
), formed AS MATERIALIZED (
  SELECT word, n_near, CASE WHEN other_n >= {FORM_TIMES} * n THEN other END AS form, CASE WHEN other_n >= {FORM_TIMES} * n THEN other_n END AS form_n
  FROM ranked WHERE place = 1
), led AS (
  SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL UNION ALL
  SELECT led.word, formed.form, step + 1 FROM led JOIN formed ON formed.word = led.root WHERE formed.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, step) AS root FROM led GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)
"""
