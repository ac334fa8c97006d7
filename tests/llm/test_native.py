"""Operators with SQL counterparts: mixing and the licence scan."""

import hashlib
import textwrap

import pytest
from pyspark.sql import functions as F

from hexwarden.llm import license_texts, licenses, mixing
from tests.llm.conftest import SF, ordered

DOCS = "doc_id long, text string, source string, size string, rate string"


def _same(df, oracle, sql, **tables):
    columns, want = oracle(sql, **tables)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert ordered(got) == ordered(want)
    return got


def test_mix_equals_sql(spark, oracle):
    _same(mixing.query(spark, SF), oracle, mixing.SQL)


def test_mix_of_odd_rows(frame, oracle):
    rows = [(i, "w " * (i % 13), f"s{i % 5}", None, "x") for i in range(200)]
    rows += [(None, "a b", None, None, None), (None, "a b", None, None, None), (7, None, "empty", None, None), (8, "", "empty", None, None)]
    docs = frame(rows, DOCS)
    got = _same(mixing.plan_copies(docs), oracle, mixing.SQL, documents=docs.select("doc_id", "text", "source"))
    assert all(taken <= 2 * size for _, size, _, _, taken in got) and len(got) == len(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(g[4] for g in got)
    assert ordered(mixed.collect()) == ordered(mixing.mix(docs.repartition(7)).collect())
    assert mixing.plan_copies(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


def test_targets_stop_at_twice_the_source(frame):
    sizes = frame([("a", 100), ("b", 1000), ("c", 1000), (None, 3)], "source string, size long")
    got = {r.source: r.target for r in mixing.plan_rates(sizes).collect()}
    assert got["a"] == 200 and got["b"] + got["c"] + got[None] + 200 == pytest.approx(1.5 * 2103)
    assert all(got[r.source] <= 2 * r["size"] for r in sizes.collect()) and got[None] == 6


def test_sources_come_near_their_targets(spark):
    got = mixing.query(spark, SF.replace("0.001", "0.1"))
    by_source = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in by_source)


def test_licenses_equal_sql(spark, oracle):
    _same(licenses.query(spark, SF), oracle, licenses.sql())


def test_licenses_of_odd_rows(spark, frame, oracle):
    rows = [
        (1, "Copyright 2020 X\nReleased under the MIT Licence", "a"), (1, "released  under the mit license!", "a"), (2, None, "a"),
        (3, "", "a"), (None, "ALL rights   reserved!!", "a"), (4, "x" * 100_000 + "\nLicensed under CC BY-NC 4.0\n", "a"),
        (5, "Licensed under CC BY-NC 5.0.", "a"), (6, "...", "a"),
    ]
    docs = frame(rows, "doc_id long, text string, digest string")
    df = licenses.scan(docs, licenses.built_in(spark))
    _same(df, oracle, licenses.sql(), documents=docs)
    got = {(r.doc_id, r.license_id): (r.n_lines, r.whole) for r in df.collect()}
    assert got == {(1, "MIT"): (2, True), (None, "all-rights-reserved"): (1, True), (4, "CC-BY-NC-4.0"): (1, False)}
    assert licenses.scan(docs.limit(0), licenses.built_in(spark)).count() == 0


def test_full_texts_and_wrapped_notices(spark, frame):
    full = {}
    for name, text in license_texts.FULL:
        full.setdefault(name, []).append(text)
    wrap = lambda text, width: "\n\n".join(textwrap.fill(part, width) for part in text.split("\n\n"))
    rows = [(1, "MIT License\n\nCopyright (c) 2020 X\n\n" + wrap(full["MIT"][0], 79)), (2, "Copyright 2021 Y\n" + wrap(full["ISC"][0], 72))]
    rows += [(3, wrap(full["BSD-3-Clause"][1], 60)), (4, wrap(full["BSD-2-Clause"][0], 30)), (5, wrap(full["MIT"][0], 79) + " Or not.")]
    rows += [(6, "Intro.\n\nThis work is licensed under the GNU General Public License,\nversion 3.\n \nEnd."), (7, "Intro.\nAll rights\nreserved.")]
    docs = frame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = {(r.doc_id, r.license_id, r.whole) for r in licenses.scan(docs, licenses.built_in(spark)).collect()}
    assert got == {(1, "MIT", True), (2, "ISC", True), (3, "BSD-3-Clause", True), (4, "BSD-2-Clause", True), (6, "GPL-3.0", False)}
    assert {r.n_lines for r in licenses.scan(docs, licenses.built_in(spark)).where("doc_id = 6").collect()} == {2}
    digest = frame([("own", hashlib.md5(b"intro all rights reserved").hexdigest())], "license_id string, digest string")
    own = licenses.scan(docs, licenses.built_in(spark), by_digest=digest).where("license_id = 'own'").collect()
    assert [(r.doc_id, r.whole, r.n_lines) for r in own] == [(7, True, 3)]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= {r.license_id for r in licenses.built_in_digests(spark).collect()}
