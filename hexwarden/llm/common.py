"""What several operators share: a per-worker store, hashed coins, table reads."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entries of a cache; who fills one empties it when it has more.
CACHE_ENTRIES = 200_000


def worker_cache(name: str, build: Callable[[], Any]) -> Any:
    """A cache that outlasts the task. A Python worker keeps one: asking for another lets go of it, so workers that
    serve several stages do not gather the caches of all."""
    store = sys.modules.setdefault("hexwarden_worker_cache", types.ModuleType("hexwarden_worker_cache")).__dict__
    if store.get("name") != name:
        store["cache"] = None
        store["name"], store["cache"] = name, build()
    return store["cache"]


def no_cache() -> None:
    """For tasks that need none: let go of what an earlier stage left in the worker."""
    worker_cache("", lambda: None)


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns' texts: the same in every run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def crc_fold(key: Column, folds: int = 3) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one column ``row``, so that no column of a caller meets a name used inside; ``select("row.*")``
    gives them back."""
    return docs.select(F.struct("*").alias("row"))
