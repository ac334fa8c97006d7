"""Quality rules against SQL, and against counting by hand."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from hexwarden.llm import quality
from tests.llm.conftest import SF, ordered

DOCS = "doc_id long, text string, score string, label string, buckets string"
LABELS = "doc_id long, quality int, toxic int, good string"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text):
    return (text or "").encode().split()


def _by_hand(text):
    words, lines = _words(text), (text or "").split("\n")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [line for line in lines if line.encode().split()]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(covered)


def _odd_rows():
    passage = "one two three four five six seven eight nine ten"
    texts = [None, "", " \n\t\x0b\x0c\r ", "word", " one two \x1c", "a\n\na\n \nb\na", "x " * 8, "x " * 9, "x y " * 2000]
    texts += [f"{passage} gap {passage} other {passage}", "#*$%&|<> ééé 𝒳𝒳", "line\r\nline\r\nline", "tail\n" * 40, "z" * 2_000]
    texts += [" ".join(f"w{i % 700}" for i in range(60_000)), " ".join(f"w{i}" for i in range(20_000))]
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(texts)]
    return [*rows, (None, "null id", "x", "x", "x"), (9, texts[9], None, None, None), (9, "same id, other text", None, None, None)]


def test_base_counts_by_hand(frame):
    rows = [*_odd_rows(), (50, "z" * 200_000 + " " + "# " * 50_000, "x", "x", "x")]
    got = quality.base_counts(frame(rows, DOCS)).select("doc_id", *COUNTS).collect()
    assert ordered(tuple(r) for r in got) == ordered((r[0], *_by_hand(r[1])) for r in rows)


def _prose(seed, n, junk):
    words = [f"{'zq' if junk else 'w'}{(i * i * 7 + seed * 13) % 97}" for i in range(n)]
    return " ".join(words)


@pytest.fixture
def labelled(frame):
    rows = _odd_rows() + [(100 + i, _prose(i, 40 + i % 9, i % 4 == 0), "x", "x", "x") for i in range(240)]
    labels = [(100 + i, int(i % 4 != 0), 0, "x") for i in range(0, 200)] + [(101, 0, 0, "x"), (101, 1, 0, "x"), (None, 1, 0, "x"), (102, None, 0, "x")]
    return frame(rows, DOCS), frame(labels, LABELS)


def _same(df, oracle, **tables):
    columns, want = oracle(quality.SQL, **tables)
    assert set(columns) == set(df.columns)
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(want)


def test_equals_sql(spark, oracle):
    _same(quality.query(spark, SF), oracle)


def test_odd_rows_equal_sql(labelled, oracle):
    docs, labels = labelled
    plain = docs.select("doc_id", "text")
    _same(quality.judge(docs, labels), oracle, documents=plain, labels=labels)
    # Neither labels nor rows; the same rows in other partitions.
    _same(quality.judge(docs, labels.limit(0)), oracle, documents=plain, labels=labels.limit(0))
    _same(quality.judge(docs.limit(0), labels), oracle, documents=plain.limit(0), labels=labels)
    again = quality.judge(docs.repartition(5), labels)
    assert ordered(again.collect()) == ordered(quality.judge(docs, labels).collect())


def test_junk_without_label_goes(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect() if r.doc_id and r.doc_id >= 300}
    assert all(r.kept == ((i - 100) % 4 != 0) and not r.base_failed for i, r in got.items())
    assert len({r.threshold for r in got.values()}) == 1


def test_main_path_has_no_python(spark, labelled):
    docs, labels = labelled
    counted = quality.base_counts(docs)
    plans = [counted, quality._scored(counted, [0] * (2 * quality.BUCKETS)), counted.select(F.explode(quality._grams()))]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
