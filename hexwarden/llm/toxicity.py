"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: density, number and strength of lexicon hits, how many of them stand near a second-person word, second-person
density, shares of capitalised and of shouted words, exclamation and question marks per word, share of obfuscated words
and density of lexicon hits among them, number of words. Only the text is read; a label, language, source or id never
enters a score.

Learning takes labelled rows whose crc32(id) mod 3 is not 1, at most about ``SAMPLE_ROWS`` of them, chosen by a hash of
the id. The lexicon holds at most ``LEXICON_TERMS`` words and word beginnings that are significantly more frequent in
toxic rows. It is learned from all of them for scoring, and from either half to describe the other half, so the trees
(seven tenths of the rows) and the calibration (the rest) see hits as they are in unseen texts.

Defined results: null and empty texts have all features 0 and get a score like any other; a null id is not held out
(its crc32 is that of the empty text); rows with the same id but several labels count with the majority (ties: 1);
with no labels, or labels of one class only, every score is the smoothed share of toxic rows (1/2 without labels);
repeated rows all appear; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexwarden.llm.common import CACHE_ENTRIES, crc_fold, packed, table, unit_hash, worker_cache
from hexwarden.workspace import written

#: Bounds of what is learned from: labelled rows, and terms of the lexicon.
SAMPLE_ROWS = 25_000
LEXICON_TERMS = 5_000
THRESHOLD = 0.7
HELD_OUT = 1
SEED = 7
#: A term must occur in so many toxic rows, be so many times likelier there, and reach this log-likelihood ratio.
TERM_ROWS, TERM_ODDS, TERM_G2 = 3, 8.0, 16.0
#: Words on either side of a hit in which a second-person word counts as near.
NEAR = 5
PREFIXES = (4, 5, 6)

#: Second-person words (English, German, French, Spanish), and look-alike characters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu toi te ton ta tes vous votre vos "
    "tú ti tuyo tuya usted ustedes vosotros vuestro".split()
)
LOOK_ALIKES = str.maketrans("013457@$!|+", "oieastasiit")

FEATURES = (
    "hit_density",
    "hits",
    "strongest",
    "mean_strength",
    "hits_near_second_person",
    "second_person",
    "capitalised",
    "shouted",
    "exclamations",
    "questions",
    "obfuscated",
    "obfuscated_hits",
    "words",
)

_LETTERS = regex.compile(r"\p{L}+")
_DISGUISED = regex.compile(r"\p{L}[\d@$!|+*._-]+\p{L}")


def terms_of(word: str) -> list[str]:
    """A lower-case word as it can stand in the lexicon: itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each term, by half and label; summed within the task as far as memory is bounded."""
    counts = {(half, label): Counter() for half in (0, 1) for label in (1, 0)}

    def flush() -> pa.RecordBatch:
        names = list(set().union(*counts.values()))
        columns = [pa.array([c[n] for n in names], pa.int64()) for c in counts.values()]
        for c in counts.values():
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["term", *COUNTS])

    for batch in batches:
        for text, half, label in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "label")), strict=True):
            words = set(_LETTERS.findall((text or "").lower()))
            counts[half, int(label)].update({t for w in words for t in terms_of(w)})
            if sum(map(len, counts.values())) > 1_000_000:
                yield flush()
    yield flush()


COUNTS = ("toxic_0", "clean_0", "toxic_1", "clean_1")


def _lexicon(counts: DataFrame, toxic: Column, clean: Column, n1: int, n0: int) -> dict[str, float]:
    """Term -> log of how many times likelier it is in toxic rows."""
    if not n1 or not n0:
        return {}
    odds = ((toxic + 0.5) / (n1 + 1.0)) / ((clean + 0.5) / (n0 + 1.0))
    both, share = toxic + clean, n1 / (n1 + n0)
    clean_part = F.when(clean > 0, clean * F.log(clean / (both * (1 - share)))).otherwise(0.0)
    g2 = 2 * (toxic * F.log(toxic / (both * share)) + clean_part)
    found = (
        counts.where(toxic >= TERM_ROWS)
        .select("term", odds.alias("odds"), g2.alias("g2"))
        .where((F.col("odds") >= TERM_ODDS) & (F.col("g2") >= TERM_G2))
        .orderBy(F.desc("g2"), "term")
        .limit(LEXICON_TERMS)
    )
    return {r["term"]: math.log(r["odds"]) for r in found.collect()}


def learn_lexicons(rows: DataFrame) -> tuple[dict[str, float], ...]:
    """``rows`` (text, half, label) to the lexicons of half 0, of half 1, and of all rows."""
    n = {(r["half"], int(r["label"])): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    n = {(h, k): n.get((h, k), 0) for h in (0, 1) for k in (0, 1)}
    terms = rows.mapInArrow(_count_terms, "term string, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = written(terms.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS)), "toxicity-terms")
    t0, c0, t1, c1 = map(F.col, COUNTS)
    return (
        _lexicon(counts, t0, c0, n[0, 1], n[0, 0]),
        _lexicon(counts, t1, c1, n[1, 1], n[1, 0]),
        _lexicon(counts, t0 + t1, c0 + c1, n[0, 1] + n[1, 1], n[0, 0] + n[1, 0]),
    )


# What the trees need of a word, as bits of one number; the strength of a hit lies above them.
_SECOND, _CAPITAL, _SHOUT, _OBFUSCATED, _OBFUSCATED_HIT, _STRENGTH = 1, 2, 4, 8, 16, 5


def word_code(word: str, lexicon: dict[str, float]) -> int:
    """The bits of one word with its punctuation."""
    lower = word.lower()

    def strength(text: str) -> float:
        return max((lexicon[t] for w in _LETTERS.findall(text) for t in terms_of(w) if t in lexicon), default=0.0)

    code, found = 0, strength(lower)
    if _DISGUISED.search(lower):
        code |= _OBFUSCATED
        plain = lower.translate(LOOK_ALIKES)
        hidden = max(strength(plain), strength(regex.sub(r"[^\p{L}]", "", plain)))
        if hidden > found:
            code, found = code | _OBFUSCATED_HIT, hidden
    if not SECOND_PERSON.isdisjoint(_LETTERS.findall(lower)):
        code |= _SECOND
    if word[:1].isupper():
        code |= _CAPITAL
        if len(word) > 1 and word.isupper():
            code |= _SHOUT
    return code | min(31, math.ceil(4 * found)) << _STRENGTH


def features_of(text: str | None, code_of) -> np.ndarray:
    words = (text or "").split()
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    n = len(words)
    codes = np.fromiter(map(code_of, words), dtype=np.int64, count=n)
    strength = codes >> _STRENGTH
    hits, second = np.flatnonzero(strength), np.flatnonzero(codes & _SECOND)
    if len(hits):
        near = np.searchsorted(second, hits + NEAR, side="right") > np.searchsorted(second, hits - NEAR, side="left")
        out[:5] = len(hits) / n, math.log1p(len(hits)), strength.max(), strength[hits].mean(), near.mean()
    out[5:8] = [np.count_nonzero(codes & bit) / n for bit in (_SECOND, _CAPITAL, _SHOUT)]
    out[8:10] = text.count("!") / n, text.count("?") / n
    out[10:12] = [np.count_nonzero(codes & bit) / n for bit in (_OBFUSCATED, _OBFUSCATED_HIT)]
    out[12] = math.log1p(n)
    return out


class _Codes(dict):
    """Codes of words seen so far."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        code = self[word] = word_code(word, self.lexicon)
        return code


def features(lexicon: dict[str, float]):
    """A function of a text column: its features as array<double>."""
    name = f"word codes {hash(frozenset(lexicon.items()))}"

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        codes = worker_cache(name, lambda: _Codes(lexicon))
        out = []
        for text in texts:
            if len(codes) > CACHE_ENTRIES:
                codes.clear()
            out.append(features_of(text, codes.__getitem__))
        return pd.Series(out)

    return dense


class Scorer:
    """What was learned: lexicon, trees, calibration; or only a share of toxic rows."""

    def __init__(self, prior: float, lexicon=None, trees=None, calibration=None):
        self.prior, self.lexicon, self.trees, self.calibration = prior, lexicon, trees, calibration

    def score(self, docs: DataFrame, text_col="text") -> DataFrame:
        """``docs`` with a column ``_score`` added."""
        if self.trees is None:
            return docs.withColumn("_score", F.lit(self.prior))
        scored = _raw(self.trees, docs.withColumn("_features", features(self.lexicon)(F.col(text_col))))
        if self.calibration is None:
            return scored.withColumnRenamed("_raw", "_score")
        # Calibration has steps; a hundredth of the raw value keeps the order of what lies on one step.
        score = 0.99 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated"))) + 0.01 * F.col("_raw")
        return self.calibration.transform(scored).withColumn("_score", score).drop("_raw", "_calibrated")


def _raw(trees, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows.withColumn("_vector", array_to_vector("_features")))
    raw = vector_to_array("_probability")[1]
    return out.withColumn("_raw", raw).drop("_features", "_vector", "_probability", "_margin", "_class")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Scorer:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("share"))
    known = known.where(crc_fold(F.col("doc_id")) != HELD_OUT).select(
        "doc_id", (F.col("share") >= 0.5).cast("double").alias("label")
    )
    n, toxic = known.agg(F.count("*"), F.sum("label")).first()
    prior = ((toxic or 0.0) + 1.0) / (n + 2.0)
    chosen = known.where(unit_hash(SEED, F.col("doc_id")) < min(1.0, SAMPLE_ROWS / max(n, 1)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    halves = (unit_hash(SEED + 1, F.col("doc_id")) < 0.5).cast("int").alias("half")
    late = (unit_hash(SEED + 2, F.col("doc_id")) >= 0.7).alias("late")
    rows = written(texts.join(chosen, "doc_id").select("text", "label", halves, late), "toxicity-rows")
    *of_half, lexicon = learn_lexicons(rows.select("text", "half", "label"))
    parts = [
        rows.where(F.col("half") == half).select("label", "late", features(of_half[1 - half])(F.col("text")).alias("_features"))
        for half in (0, 1)
    ]
    described = written(parts[0].unionByName(parts[1]), "toxicity-features")
    classes = {(r["late"], r["label"]) for r in described.select("late", "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= classes:
        return Scorer(prior)
    boosting = GBTClassifier(
        featuresCol="_vector", labelCol="label", predictionCol="_class", maxIter=20, maxDepth=3, stepSize=0.3, seed=SEED
    )
    boosting = boosting.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    early = described.where("not late").withColumn("_vector", array_to_vector("_features"))
    trees = boosting.fit(early.coalesce(4))
    if not {(True, 0.0), (True, 1.0)} <= classes:
        return Scorer(prior, lexicon, trees)
    isotonic = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated")
    return Scorer(prior, lexicon, trees, isotonic.fit(_raw(trees, described.where("late"))))


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = fit(docs, labels, id_col, text_col).score(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    )
    return scored.select(
        "doc_id",
        (crc_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The input's rows and columns without those predicted toxic."""
    rows = packed(docs).withColumn("text", F.col("row")[text_col])
    scored = fit(docs, labels, id_col, text_col).score(rows)
    return scored.where(F.col("_score") < THRESHOLD).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
