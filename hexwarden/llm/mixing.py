"""Mixing sources to target weights.

Sources take ``budget`` times all words between them, in proportion to their weights, but none takes more than
``most`` times what it has; what a source cannot take is shared among the others by weight until none is above.
A source's rate is its target over its size; each document is emitted floor(rate) times, plus once more if a coin
seeded by its id falls below the fraction.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; a source of size 0 has
target and rate 0, so its documents are not emitted (their ``taken`` is 0); rows that share an id share the coin; an
empty table gives an empty table. Extra columns are kept by ``mix`` and never read.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexwarden.llm.common import WORD, packed, table, unit_hash
from hexwarden.workspace import written

#: Fixed values of the production mix.
WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
MOST = 2
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _ranked(sources: DataFrame, label: str) -> DataFrame:
    """Add ``rank`` (0, 1, ...) in code-point order, null last, without gathering the sources in one task."""
    parts = written(
        sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), label
    )
    # One row per range partition: their number is a setting, not a property of the data.
    offsets = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return parts.withColumn("inside", inside).join(offsets, "part").select(
        "source", "source_size", (F.col("inside") + F.col("offset")).alias("rank")
    )


def plan_rates(sizes: DataFrame, weights=WEIGHTS, budget: Fraction = BUDGET, most: int = MOST) -> DataFrame:
    """``sizes`` (source, size; several rows per source are summed) to (source, source_size, target, rate)."""
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = _ranked(sources, "mix-sources")
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = written(ranked.withColumn("weight", weight), "mix-weights")

    # Water filling: the share per weight only grows when sources reach their cap, so capped sources stay capped.
    # All comparisons are between whole numbers: share = top / bottom.
    big = "decimal(38,0)"
    total = int(weighed.agg(F.sum(F.col("source_size").cast(big))).first()[0] or 0)
    top, bottom, capped = 0, 1, F.lit(False)
    while total:
        full, open_weight = (
            int(x or 0)
            for x in weighed.agg(
                F.sum(F.when(capped, F.col("source_size").cast(big))),
                F.sum(F.when(~capped, F.col("weight"))),
            ).first()
        )
        now = (budget.numerator * total - budget.denominator * most * full, budget.denominator * open_weight)
        if not open_weight or now == (top, bottom):
            break
        top, bottom = now
        capped = (F.lit(top).cast(big) * F.col("weight")) > (
            F.lit(most * bottom).cast(big) * F.col("source_size").cast(big)
        )
    cap = (most * F.col("source_size")).cast("double")
    share = F.lit(float(top)) * F.col("weight").cast("double") / F.lit(float(bottom))
    target = F.when(F.col("source_size") == 0, 0.0).when(capped, cap).otherwise(share)
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    return weighed.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """How often a document is emitted: floor(rate), and once more with probability of the fraction."""
    coin = (unit_hash(seed, doc_id) < rate - F.floor(rate)).cast("long")
    return F.floor(rate).cast("long") + coin


def plan_copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words the mix takes)."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = written(sized, "mix-sizes")
    rates = written(plan_rates(sized.select("source", "size")).withColumnRenamed("source", "named"), "mix-rates")
    joined = sized.join(rates, sized.source.eqNullSafe(rates.named))
    taken = F.col("size") * copies(F.col("rate"), F.col("doc_id"), seed)
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED) -> DataFrame:
    """The mixed documents: the input's rows and columns, each row as often as the mix takes it."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rates = written(plan_rates(sizes), "mix-rates")
    joined = packed(docs).join(rates, F.col("row")[source_col].eqNullSafe(F.col("source")))
    times = copies(F.col("rate"), F.col("row")[id_col], seed).cast("int")
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return plan_copies(table(spark, sf_dir, "documents"))


#: Sources in ascending order of cap per weight; the first prefix whose share lies within the next cap is full.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS s,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), filling AS (
  SELECT source, s, w, sum(s) OVER () AS total, sum(w) OVER () AS all_w,
         sum(s) OVER (ORDER BY s::DOUBLE / w, source ASC NULLS LAST) - s AS full_s,
         sum(w) OVER (ORDER BY s::DOUBLE / w, source ASC NULLS LAST) - w AS full_w,
         row_number() OVER (ORDER BY s::DOUBLE / w, source ASC NULLS LAST) AS place
  FROM sources
), share AS (
  SELECT 3 * total - 4 * full_s AS top, 2 * (all_w - full_w) AS bottom, place FROM filling
  WHERE (3 * total - 4 * full_s) * w <= 4 * s * (all_w - full_w) ORDER BY place LIMIT 1
), targets AS (
  SELECT source, s::BIGINT AS source_size,
         CASE WHEN s = 0 THEN 0.0::DOUBLE WHEN filling.place < share.place THEN (2 * s)::DOUBLE
              ELSE top::DOUBLE * w::DOUBLE / bottom::DOUBLE END AS target
  FROM filling, share
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT
               + (coin < rate - floor(rate))::BIGINT) AS taken
FROM (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size::DOUBLE END AS rate,
         ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS coin
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
"""
