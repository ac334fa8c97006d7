"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and pairs of neighbouring words are hashed into two ranges of buckets. Over all documents the buckets give two
multinomials, one of documents labelled good and one of the raw corpus; a document's score is the mean over its
grams of ln P(gram | trusted) - ln P(gram | raw). Ratios are whole millionths, so a score does not depend on the
order of additions. Labelled documents whose id's MD5 (first eight hex digits) has remainder 1 modulo 3 are not among the trusted ones, as
a document's own grams raise its score: the threshold is the cut that best separates the good from the bad of these
among those that pass the base rules. Scores are taken in hundredths; a cut lies midway between two that occur; the sum
of both shares is to be largest, and of equal cuts the lowest counts, which keeps most. Every document is held against it. Everything is DataFrame functions; what reaches the driver is one
number per bucket and one count per hundredth of a score in [-SCORE_END, SCORE_END].

Windows of eight words are compared as 64-bit hashes of 64-bit word hashes, inside one document only; two different
windows of a document of a million words share one with a probability of 3e-8. Words go to buckets by CRC-32.

Defined results: a null or empty text has no words, counts 0, a null score, and fails the base rules; a document of
one word has no pair and is scored by its word; a null id is a row like any other, without label; rows that share an
id are scored one by one and share its labels, of which a good one counts before a bad one; ties with the threshold
are kept; without labelled good documents all ratios are 0; without labelled bad ones the threshold is
``NO_LABELS``; an empty table gives an empty table. Texts of any length are taken whole, in memory of some ten times
one text. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexwarden.llm.common import table
from hexwarden.workspace import written

#: Fixed values of the base rules.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Buckets of single words, and as many of pairs.
BUCKETS = 2**15
#: Whole numbers that a nat is counted in.
MICRO = 1_000_000
#: One of so many folds of the labels is held out for the threshold.
FOLDS = 3
#: The threshold where labels give none, in nats per gram, and the end of the scores that a cut is looked for in.
NO_LABELS = -0.25
SCORE_END = 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and ``buckets`` of the words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    split = rows.select(
        "doc_id",
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _words(F.col("text")).alias("words"),
    )
    hashed = split.select(
        "doc_id",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("int")).alias("buckets"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # get() takes a step, a slice inside a lambda would copy the whole array for every word.
    from_each = F.transform("hashes", lambda h, i: F.xxhash64(h, *(F.get("hashes", i + k) for k in range(1, WINDOW))))
    windows = F.slice(from_each, 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0)))
    hashed = hashed.select("*", windows.alias("windows")).drop("hashes")
    # Only texts with a repeated window sort them; equal windows then stand side by side.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    in_order = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    ordered = hashed.withColumn("ordered", F.when(repeated, in_order)).drop("windows")

    def same(k: Column, window: Column) -> Column:
        return F.coalesce(F.get("ordered", k)["w"] == window["w"], F.lit(False))

    twice = F.filter("ordered", lambda x, k: same(k - 1, x) | same(k + 1, x))
    starts = ordered.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("ordered")
    own = F.transform(
        "starts", lambda s, k: F.coalesce(F.least(F.lit(WINDOW), s - F.get("starts", k - 1)), F.lit(WINDOW)).cast("long")
    )
    # least() passes over a null, so the first start counts whole.
    covered = F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)
    return starts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "buckets",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _grams() -> Column:
    """Buckets of words (0 ..) and of pairs (BUCKETS ..)."""
    later = F.slice("buckets", 2, F.greatest(F.size("buckets") - 1, F.lit(0)))
    first = F.slice("buckets", 1, F.greatest(F.size("buckets") - 1, F.lit(0)))
    pairs = F.zip_with(first, later, lambda a, b: F.lit(BUCKETS) + (a * 31 + b) % BUCKETS)
    return F.concat("buckets", pairs)


def gram_ratios(counted: DataFrame, trusted: DataFrame) -> list[int]:
    """ln P(bucket | trusted) - ln P(bucket | raw) in millionths; ``trusted`` has the ids (doc_id), each once."""
    ids = trusted.select(F.col("doc_id").alias("of")).withColumn("good", F.lit(1).cast("long"))
    # Dealt by id at every size: labels grow with the documents. Only the ids are put into hash tables, nothing is sorted.
    marked = counted.select("doc_id", "buckets").join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("of"), "left")
    grams = marked.select("good", F.explode(_grams()).alias("bucket"))
    sums = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).fillna(0)
    sums = written(sums, "quality-grams")
    totals = sums.agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good")).first()
    ratios = [0] * (2 * BUCKETS)
    if totals["all_good"]:
        p_good = (F.col("good") + 1) / F.lit(float(totals["all_good"] + 2 * BUCKETS))
        p_raw = (F.col("raw") + 1) / F.lit(float(totals["all_raw"] + 2 * BUCKETS))
        found = sums.select("bucket", F.round((F.ln(p_good) - F.ln(p_raw)) * MICRO).cast("long").alias("ratio"))
        for bucket, ratio in found.collect():  # at most 2 * BUCKETS rows
            ratios[bucket] = ratio
    return ratios


def _scored(counted: DataFrame, ratios: list[int]) -> DataFrame:
    # A text that is cut and cast folds into one array constant.
    constant = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    total = F.aggregate(_grams(), F.lit(0).cast("long"), lambda a, g: a + F.get(constant, g))
    score = F.when(n > 0, total.cast("double") / n.cast("double") / F.lit(float(MICRO)))
    return counted.withColumn("score", score).drop("buckets").withColumn("base_failed", base_failed())


def best_cut(scored: DataFrame, labels: DataFrame) -> float:
    """The cut between labelled good and bad documents; ``labels`` has one row per id (doc_id, good 0/1)."""
    known = scored.where(~F.col("base_failed")).join(labels.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"))
    place = F.greatest(F.lit(-100 * SCORE_END), F.least(F.lit(100 * SCORE_END), F.floor(F.col("score") * 100)))
    counts = known.groupBy(place.cast("int").alias("place")).agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    rows = sorted(counts.collect())  # one for each hundredth
    all_good, everyone = sum(r["good"] for r in rows), sum(r["n"] for r in rows)
    all_bad = everyone - all_good
    if not all_good or not all_bad:
        return NO_LABELS
    best, cut, good_below, bad_below, last = -1, NO_LABELS, 0, 0, rows[0]["place"] - 1
    for r in rows:
        worth = (all_good - good_below) * all_bad + bad_below * all_good
        if worth > best:
            best, cut = worth, (last + 1 + r["place"]) / 200.0
        good_below, bad_below, last = good_below + r["good"], bad_below + r["n"] - r["good"], r["place"]
    return cut


def label_of_id(labels: DataFrame) -> DataFrame:
    """doc_id, good (1 if any of its labels is 1, else 0), held_out (for the cut, not for the ratios)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    of_id = known.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    digest = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return of_id.withColumn("held_out", digest % FOLDS == 1)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, the four base counts, score, threshold, base_failed, kept."""
    counted = written(base_counts(docs, id_col, text_col), "quality-counts")
    known = written(label_of_id(labels), "quality-labels")  # Spark knows its size when it joins.
    scored = written(_scored(counted, gram_ratios(counted, known.where("good = 1 AND NOT held_out"))), "quality-scores")
    threshold = best_cut(scored, known.where("held_out").drop("held_out"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return scored.select("*", F.lit(threshold).alias("threshold"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = rf"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), crc_steps AS (
  SELECT range AS byte, range AS crc, 0 AS step FROM range(256) UNION ALL
  SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(3988292384, crc >> 1) ELSE crc >> 1 END, step + 1 FROM crc_steps WHERE step < 8
), crc_table AS MATERIALIZED (
  SELECT list(crc ORDER BY byte) AS t FROM crc_steps WHERE step = 8
), folding AS (
  SELECT w, hex(encode(w)) AS hex, 0 AS pos, 4294967295 AS crc FROM (SELECT DISTINCT unnest(words) AS w FROM texts) UNION ALL
  SELECT w, hex, pos + 2, xor(crc >> 8, t[(xor(crc, ('0x' || substr(hex, pos + 1, 2))::BIGINT) & 255) + 1])
  FROM folding, crc_table WHERE pos < length(hex)
), word_bucket AS MATERIALIZED (
  SELECT w, xor(crc, 4294967295) % {BUCKETS} AS bucket FROM folding WHERE pos = length(hex)
), word_hashes AS (
  SELECT row, doc_id, w, i, bucket
  FROM (SELECT row, doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts) JOIN word_bucket USING (w)
), windows AS (
  SELECT row, i, string_agg(w, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS words,
         count(*) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n
  FROM word_hashes
), twice AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, words) AS times FROM windows WHERE n = {WINDOW}) WHERE times > 1
), repeated AS (
  SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range({WINDOW})) AS k) GROUP BY row
), dup_lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), base AS (
  SELECT t.row, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(words) < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED_PERCENT} * len(words) AS base_failed
  FROM texts t LEFT JOIN dup_lines USING (row) LEFT JOIN repeated USING (row)
), label AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {FOLDS} = 1 AS held_out FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), grams AS (
  SELECT row, doc_id, bucket FROM word_hashes UNION ALL
  SELECT row, doc_id, {BUCKETS} + (bucket * 31 + next) % {BUCKETS} FROM (
    SELECT row, doc_id, bucket, lead(bucket) OVER (PARTITION BY row ORDER BY i) AS next FROM word_hashes) WHERE next IS NOT NULL
), sums AS (
  SELECT bucket, count(*) AS raw, coalesce(sum(good) FILTER (NOT held_out), 0) AS good FROM grams LEFT JOIN label USING (doc_id) GROUP BY bucket
), ratios AS (
  SELECT bucket, CASE WHEN all_good = 0 THEN 0 ELSE
           round((ln((good + 1)::DOUBLE / (all_good + {2 * BUCKETS})::DOUBLE) - ln((raw + 1)::DOUBLE / (all_raw + {2 * BUCKETS})::DOUBLE)) * {MICRO})
         END::BIGINT AS ratio
  FROM sums, (SELECT sum(raw)::BIGINT AS all_raw, sum(good)::BIGINT AS all_good FROM sums)
), scores AS (
  SELECT row, sum(ratio)::BIGINT::DOUBLE / count(*)::DOUBLE / {MICRO}.0::DOUBLE AS score FROM grams JOIN ratios USING (bucket) GROUP BY row
), scored AS (
  SELECT * FROM base LEFT JOIN scores USING (row)
), places AS (
  SELECT greatest({-100 * SCORE_END}, least({100 * SCORE_END}, floor(score * 100)))::INT AS place, sum(good) AS good, count(*) - sum(good) AS bad
  FROM scored JOIN label USING (doc_id) WHERE NOT base_failed AND held_out GROUP BY 1
), cuts AS (
  SELECT place, lag(place, 1, place - 1) OVER (ORDER BY place) + 1 + place AS twice_the_cut, (sum(good) OVER () - sum(good) OVER (ORDER BY place) + good) * sum(bad) OVER ()
              + (sum(bad) OVER (ORDER BY place) - bad) * sum(good) OVER () AS worth,
         sum(good) OVER () AS all_good, sum(bad) OVER () AS all_bad FROM places
), chosen AS (
  SELECT coalesce((SELECT twice_the_cut / 200.0::DOUBLE FROM cuts WHERE all_good > 0 AND all_bad > 0 ORDER BY worth DESC, place LIMIT 1),
                  {NO_LABELS}::DOUBLE) AS threshold
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, score, threshold,
       base_failed, NOT base_failed AND coalesce(score >= threshold, false) AS kept
FROM scored, chosen
"""
