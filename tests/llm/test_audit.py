"""Filter interaction audit against SQL, and its tries against plain dictionaries."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from hexwarden.llm import audit
from tests.llm.conftest import SF, ordered

DOCS = "doc_id long, text string, lang string, mask string, prefix string, part string"
LABELS = "doc_id long, quality int, toxic int, part string"


def _same(df, oracle, **tables):
    columns, want = oracle(audit.SQL, **tables)
    assert set(columns) == set(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert ordered(got) == ordered(want)
    return got


@given(st.lists(st.tuples(st.binary(max_size=6) | st.sampled_from([b"ab" * 40, b"ab" * 40 + b"c", b"ab" * 39]), st.integers(0, 9))))
@settings(max_examples=300, deadline=None)
def test_trie_holds_smallest_ids(pairs):
    trie = audit.Trie()
    ends = [(text, trie.insert(text, i)) for text, i in pairs]
    least = {}
    for text, i in pairs:
        least[text] = min(i, least.get(text, i))
    assert all(end[3] == least[text] for text, end in ends)
    # What the tree spells out is the set of texts.
    spelled, todo = set(), [(trie.root, b"")]
    while todo:
        node, path = todo.pop()
        path += node[0][node[1] : node[2]]
        if node[3] is not None:
            spelled.add(path)
        todo += [(child, path) for child in node[4].values()]
    assert spelled == set(least)


@given(st.text(alphabet="aA #é\n\x1c|", max_size=60))
@settings(max_examples=300, deadline=None)
def test_masks(text):
    words = text.encode().split()
    want = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)]
    want.append(any(c in "#$%&*|" for c in text))
    assert audit.mask_of(text.encode()) == sum(1 << k for k, bad in enumerate(want) if bad)


def _rows():
    rng, long_text = random.Random(5), " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "x", "x #", "SHOUT", long_text, long_text + " ", long_text + " |", long_text.upper(), "a b " * 200, "y" * 300_000]
    texts += ["shared start " * 40 + str(i) for i in range(12)]
    rows = [(rng.randrange(500), rng.choice(texts), rng.choice(["en", "de", "", None]), "x", None, "q") for _ in range(900)]
    hot = [(i, "hot text", "en", None, "x", "q") for i in range(1000, 1600)]
    nulls = [(None, "x", "en", "x", "x", "x"), (None, "x", "en", "x", "x", "x"), (None, None, None, None, None, None)]
    return [*rows, *hot, *nulls, rows[0], rows[0]]


@pytest.mark.parametrize("trie_bytes", [audit.TRIE_BYTES, 2_000])
def test_odd_rows_equal_sql(frame, oracle, trie_bytes):
    rows = _rows()
    docs = frame(rows, DOCS).repartition(6)
    labels = frame([(i, i % 3 % 2, i % 7 % 2, "x") for i in range(0, 1600, 2)] + [(4, 1, None, "x"), (4, None, 1, "x"), (None, 1, 1, "x")], LABELS)
    failed = audit.failures(docs, trie_bytes=trie_bytes)
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    want = [(r[0], r[2] or "", r[0] is not None and r[0] > least[r[1] or ""]) for r in rows]
    assert ordered((r.doc_id, r.part, bool(r["mask"] & audit.COPY)) for r in failed.collect()) == ordered(want)
    got = _same(audit.audit(failed, labels), oracle, documents=frame(rows, DOCS).select("doc_id", "text", "lang"), labels=labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_small_blocks_of_kept_texts(frame, monkeypatch):
    docs, want = frame(_rows(), DOCS), None
    want = ordered(audit.failures(docs).collect())
    monkeypatch.setattr(audit, "KEPT_BYTES", 5_000)
    assert ordered(audit.failures(docs.repartition(3)).collect()) == want


def test_dense_prefixes_are_lengthened(frame):
    rows = [(i, ("a" if i % 2 else "b") * 600 + str(i), b"x", 0) for i in range(50)]
    rows = [(i, t.encode()) for i, t, *_ in rows] + [(100, b"same " * 400), (101, b"same " * 400), (102, b"short")]
    got = audit.with_prefixes(frame(rows, "doc_id long, text binary"), 5_000).collect()
    # Texts that differ early enough part; those that are one text stay together, whole.
    sizes = {}
    for r in got:
        assert bytes(r.text).decode().startswith(r.prefix)
        sizes.setdefault(r.prefix, []).append(bytes(r.text))
    assert all(sum(map(len, texts)) <= 5_000 or len(set(texts)) == 1 for texts in sizes.values())


def test_empty_and_unlabelled(frame, oracle):
    docs, labels = frame(_rows(), DOCS), frame([], LABELS)
    assert audit.audit(audit.failures(docs.limit(0)), labels).count() == 0
    got = _same(audit.audit(audit.failures(docs), labels), oracle, documents=docs.select("doc_id", "text", "lang"), labels=labels)
    assert all(len(r) == 10 for r in got)


def test_equals_sql(spark, oracle):
    _same(audit.query(spark, SF.replace("0.001", "0.01")), oracle, **{t: spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels")})
