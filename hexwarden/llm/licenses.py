"""License scan: canonical digests of entire texts, paragraphs and lines, looked up among those of known licences.

A text is canonicalised - lower case, copyright lines removed, punctuation and white space to single blanks, equivalent
spellings to one - and its MD5 is joined with the digests of known licence texts and notices, canonicalised alike. The
whole document, each paragraph (run of non-empty lines) and each line count as a text.

Whole documents and paragraphs are read without regard to their line breaks as well ("unwrapped"): then only lines that
begin a paragraph are copyright lines, as inside one a line may begin with "copyright" by chance.

Defined results: one row per document and licence found (doc_id, license_id, n_lines, whole); n_lines counts lines that
are its text by themselves and lines of paragraphs that are; null and empty texts and
texts without letters or digits match nothing; rows that repeat an id are summed; null ids form one group; an empty
table gives an empty result; extra columns are not read. Known texts that are equal after canonicalisation count for
the smallest license_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexwarden.llm.common import table
from hexwarden.llm.license_texts import DIGESTS, FULL
from hexwarden.workspace import written

#: Public licence notices. A caller's own table (license_id, text) can take their place.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("all-rights-reserved", "All rights reserved."),
)
#: Spellings that count as equal, between blanks, after punctuation is gone.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("share alike", "sharealike"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("v", "version"),
)
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
#: Copyright lines at the start of a paragraph.
COPYRIGHT_HEAD = r"(\A|\n[ \t\r]*\n)\s*([ \t]*(copyright|\(c\)|©)[^\n]*(\n|\z))+"
BLANK_LINE = r"\n[ \t\r]*\n"
OTHER = r"[^\p{L}\p{N}]+"


def _plain(lowered: Column) -> Column:
    out = F.concat(F.lit(" "), F.regexp_replace(lowered, OTHER, " "), F.lit(" "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.trim(out)


def canonical(text: Column) -> Column:
    return _plain(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""))


def unwrapped(text: Column) -> Column:
    """The canonical text whatever its line breaks inside paragraphs."""
    return _plain(F.regexp_replace(F.lower(text), COPYRIGHT_HEAD, "\n\n"))


def known_digests(known: DataFrame, by_digest: DataFrame | None = None) -> DataFrame:
    """``known`` (license_id, text) and ``by_digest`` (license_id, digest) to (digest, license_id)."""
    each = F.explode(F.array_distinct(F.array(canonical(F.col("text")), unwrapped(F.col("text")))))
    texts = known.select("license_id", each.alias("canonical")).where("canonical <> ''")
    digests = texts.select("license_id", F.md5("canonical").alias("digest"))
    if by_digest is not None:
        digests = digests.unionByName(by_digest.select("license_id", "digest"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *FULL], "license_id string, text string")


def built_in_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIGESTS), "license_id string, digest string")


def scan(
    docs: DataFrame, known: DataFrame, id_col="doc_id", text_col="text", by_digest: DataFrame | None = None
) -> DataFrame:
    """One row per document and licence: doc_id, license_id, n_lines (lines that are its text), whole (the document is)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    readings = F.explode(F.array_distinct(F.array(F.md5(canonical(F.col("text"))), F.md5(unwrapped(F.col("text"))))))
    whole = rows.select("doc_id", readings.alias("digest"), none.alias("n"), F.lit(True).alias("whole"))
    lines = rows.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select("doc_id", F.md5(canonical(F.col("line"))).alias("digest"), one.alias("n"), F.lit(False).alias("whole"))
    digests = written(known_digests(known, by_digest), "license-digests")
    # Paragraphs of one line are lines.
    parts = rows.select("doc_id", F.explode(F.split("text", BLANK_LINE, -1)).alias("part")).where(F.instr(F.trim("part", F.lit("\n")), "\n") > 0)
    parts = parts.select("doc_id", "part", F.md5(unwrapped(F.col("part"))).alias("digest")).join(digests, "digest")
    body = F.split(F.regexp_replace(F.lower("part"), COPYRIGHT_HEAD, ""), "\n", -1)
    n = F.size(F.filter(body, lambda line: F.regexp_replace(line, OTHER, "") != "")).cast("long")
    parts = parts.select("doc_id", "license_id", n.alias("n"), F.lit(False).alias("whole")).where("n > 1")
    found = whole.unionByName(lines).join(digests, "digest").select("doc_id", "license_id", "n", "whole")
    found = found.unionByName(parts)
    return found.groupBy("doc_id", "license_id").agg(F.sum("n").alias("n_lines"), F.max("whole").alias("whole"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), built_in(spark), by_digest=built_in_digests(spark))


def _sql_canonical(text: str) -> str:
    out = f"' ' || regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g'), '{OTHER}', ' ', 'g') || ' '"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {one} ')"
    return f"trim({out})"


def sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN)
    return f"""
WITH known AS (
  SELECT md5(c) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_sql_canonical("text")} AS c FROM (VALUES {quoted}) AS t(license_id, text))
  WHERE c <> '' GROUP BY 1
), units AS (
  SELECT doc_id, md5({_sql_canonical("text")}) AS digest, true AS whole FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, md5({_sql_canonical("line")}), false
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
)
SELECT doc_id, license_id, count(*) FILTER (WHERE NOT whole) AS n_lines, bool_or(whole) AS whole
FROM units JOIN known USING (digest) GROUP BY ALL
"""
