"""Operators that give back the caller's rows: columns with the names used inside come back as they were."""

import pytest
from pyspark.sql import functions as F

from hexwarden.llm import decontamination, mixing, simhash, toxicity

NAMES = (
    "_fp", "fp", "_group", "group", "node", "component", "first", "row", "_score", "_features", "_raw", "_vector", "_probability",
    "_margin", "_class", "_calibrated", "_mix_rate", "_mix_source", "_mix_copy", "rate", "target", "copy", "size", "score", "label", "half",
    "late", "_held", "id", "with.dot",
)


@pytest.fixture
def docs(frame):
    vile = "you are a vile rotten creep and everybody hates you so much"
    kind = "the garden by the river is full of light on quiet mornings"
    rows = [(i, f"{vile if i % 2 else kind} {i % 7} {'x' * (i % 5)}", f"s{i % 3}") for i in range(80)] + [(None, None, None), (3, "", "s0")]
    plain = frame(rows, "doc_id long, text string, source string")
    return plain.select("*", *(F.concat(F.lit(f"{n}:"), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in NAMES))


def _unchanged(got, docs):
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == f"{n}:{-1 if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
    return rows


def test_one_of_each(docs):
    kept = _unchanged(simhash.one_of_each(docs), docs)
    plain = simhash.one_of_each(docs.select("doc_id", "text"))
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept])) == sorted(map(str, [tuple(r) for r in plain.collect()]))
    assert len(kept) < 82 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_without_toxic(docs, frame):
    labels = frame([(i, i % 2, "x") for i in range(80)], "doc_id long, toxic int, _score string")
    kept = _unchanged(toxicity.without_toxic(docs, labels), docs)
    assert len(kept) < 82 and toxicity.without_toxic(docs.limit(0), labels).count() == 0


def test_mix(docs):
    got = _unchanged(mixing.mix(docs), docs)
    plain = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in plain)


def test_without_benchmark(docs, frame):
    items = frame([(1, "the garden by the river is full of light on quiet mornings")], "item_id long, text string")
    kept = _unchanged(decontamination.without_benchmark(docs, items), docs)
    assert {r.doc_id % 2 for r in kept if r.doc_id is not None and r.text} == {1}
