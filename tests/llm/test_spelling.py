"""Spelling variants against SQL and against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from hexwarden.llm import spelling
from tests.llm.conftest import SF, ordered

DOCS = "doc_id long, text string, word string, n string, root string"


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    near = {w: [v for v in n if _one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def _texts(seed, documents=60):
    rng, base = random.Random(seed), ["abcde", "ringed", "straße", "Ñandúes", "ÿÀ×÷q", "aaaaaa", "lengthier", "internationally"]
    def changed(word):
        i, c = rng.randrange(len(word) + 1), rng.choice("abcdeÿß")
        return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word, word])
    pool = [changed(changed(w)) for w in base for _ in range(25)] + base * 4
    return [(rng.randrange(1000), rng.choice([" ", "-", "1"]).join(rng.choice(pool) for _ in range(200))) for _ in range(documents)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(frame, oracle, seed):
    rows = _texts(seed) + [(None, "Abcde ABCDE abcde ringed"), (None, None), (3, None), (4, ""), (5, "x" * 300_000 + " " + "y" * 300_000)]
    rows += [(7, "twice twice twice"), (7, "twice twice twice"), (8, "étude etude étude ɐbcde ٣ ſabcde"), (9, "abcde " * 300_000)]
    docs = frame([(*r, "x", None, "x") for r in rows], DOCS)
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    assert ordered(got) == ordered(_by_hand(rows))
    assert any(r[1] and r[2] != r[1] for r in got) and any(r[4] == 0 for r in got)
    docs = docs.where("length(text) < 1000000 AND doc_id <> 5 OR doc_id IS NULL")  # The SQL takes a step for each letter.
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    columns, want = oracle(spelling.SQL, documents=docs.select("doc_id", "text"))
    assert columns == spelling.variants(docs).columns and ordered(got) == ordered(want)


def test_same_result_however_dealt(frame, monkeypatch):
    docs = frame([(*r, "x", None, "x") for r in _texts(3)], DOCS)
    want = ordered(spelling.variants(docs).collect())
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 10)
    assert ordered(spelling.variants(docs.repartition(7)).collect()) == want
    assert spelling.variants(docs.limit(0)).count() == 0


@given(st.text(alphabet="ab1 ", max_size=40), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_runs_are_not_cut(text, most):
    letters = re.compile("[a-z]+")
    assert [r for found in spelling.runs(text, letters, most) for r in found] == letters.findall(text)


def test_every_near_pair_is_met(frame):
    rng = random.Random(9)
    some = {"".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(300)}
    pairs = spelling.near_pairs(frame([(w, 3) for w in some], "word string, n long")).collect()
    got = [frozenset((r.a, r.b)) for r in pairs]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in some for b in some if _one_edit(a, b)}


def test_long_chains_of_forms(frame):
    # Each form is the next one's word: a chain of seven.
    chain = [("a" * (5 + i), 3 * 2**i) for i in range(8)]
    known = frame(chain, "word string, n long")
    got = {r.word: r.root for r in spelling.roots(spelling.forms(spelling.near_pairs(known))).collect()}
    assert got == {w: chain[-1][0] for w, _ in chain[:-1]}


def test_equals_sql(spark, oracle):
    sf = SF.replace("0.001", "0.01")
    columns, want = oracle(spelling.SQL, documents=spark.read.parquet(f"{sf}/documents.parquet"))
    assert ordered(tuple(r) for r in spelling.query(spark, sf).select(*columns).collect()) == ordered(want)
