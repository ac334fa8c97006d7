"""Repeated strings, passages, benchmark items and token files against brute force and exact round trips."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hexwarden.llm import bwt, decontamination, passages, repeats, tokenfiles
from hexwarden.llm.bits import bit_table, in_table
from tests.llm.conftest import SF, ordered

DOCS = "doc_id long, text string, anchor string, id string"


def _documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_bit_table_keeps_every_key(frame):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    table = bit_table(frame([(int(k),) for k in keys], "k long"), "k")
    assert in_table(table, keys).all() and in_table(table, ~keys[::-1] * 3 + 1).mean() < 0.01


# Repeated strings


def _shard(strings):
    return bwt.Shard(np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum([0] + [len(s) for s in strings]))


def test_shards_are_sorted_and_merge_finds_repeats():
    rng = random.Random(1)
    for _ in range(60):
        length, alphabet = rng.choice([2, 4, 8]), rng.choice([b"ab", b"ab\x00\xff"])
        sets = [[bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        shards = [_shard(s) for s in sets]
        for strings, shard in zip(sets, shards, strict=True):
            suffixes = [strings[k][o:] for k, o in zip(shard.string.tolist(), shard.offset.tolist(), strict=True)]
            assert [s[:8].ljust(8, b"\0") for s in suffixes] == sorted(s[:8].ljust(8, b"\0") for s in suffixes)
        counts = Counter(s[i : i + length] for strings in sets for s in strings for i in range(len(s) - length + 1))
        want = {(k, j, i) for k, strings in enumerate(sets) for j, s in enumerate(strings) for i in range(len(s) - length + 1) if counts[s[i : i + length]] > 1}
        found = bwt.repeated(shards, length)
        assert {(k, int(j), int(i)) for k, (js, offsets) in enumerate(found) for j, i in zip(js, offsets, strict=True)} == want


def _removed(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                covered[k : k + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if covered[p] and not (p and covered[p - 1]))
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [256, 4])
def test_repeats_equal_brute_force(frame, monkeypatch, most):
    monkeypatch.setattr(repeats, "ANCHOR_WINDOWS", most)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(300)
    rows = [
        (1, text(50) + shared + text(70)), (2, shared[30:290]), (3, None), (4, ""), (5, "x" * 1000), (6, text(400) * 3), (None, shared),
        (7, text(199)), (8, text(500)), (8, text(500)), (9, "é" * 150), (10, "zé" + "é" * 150), (12, shared[:200]), (12, shared[:200]), (None, shared), (13, "ab" * 5000),
    ]
    rows += [(100 + i, text(5) + shared + text(40)) for i in range(30)]
    docs = frame([(*r, "a", "b") for r in rows], DOCS)
    assert ordered(map(tuple, repeats.deduplicate(docs).collect())) == ordered(_removed(rows))
    assert repeats.deduplicate(docs.limit(0)).count() == 0


def test_repeats_of_the_documents(spark):
    assert ordered(map(tuple, repeats.query(spark, SF).collect())) == ordered(_removed(_documents(spark)))


# Passages


def test_compact_windows_are_the_ranges_of_minima():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, width = int(rng.integers(5, 60)), int(rng.integers(2, 6))
        values = rng.integers(0, rng.choice([4, 1000]), n).astype(np.uint64)
        want = []
        for c in range(n):
            left, right = c, c
            while left and values[left - 1] > values[c]:
                left -= 1
            while right < n - 1 and values[right + 1] >= values[c]:
                right += 1
            if right - left + 1 >= width:
                want.append((left, c, right))
        assert ordered(zip(*(x.tolist() for x in passages.compact_windows(values, width)), strict=True)) == ordered(want)


@pytest.mark.parametrize("similarity, most", [(0.8, 0.0017), (0.85, 0.0005)])
def test_few_starts_are_not_proposed(similarity, most):
    n = passages.HASHES
    missed = sum(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(passages.ENOUGH))
    assert missed < most


def test_passages_are_found_and_others_left(frame):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, longer = words(60), words(120)
    changed = list(longer)
    changed[60] = "CHANGED"
    docs = {1: words(100) + shared + words(30), 2: words(10) + shared + words(200), 3: words(30) + longer, 4: changed + words(70), 6: words(500), 7: words(40)}
    docs |= {n: words(n) + [*shared[:30], f"w{n}", *shared[30:]] + words(20) for n in range(8, 20)}
    docs |= {41: ["aa"] * 300, 42: words(60) + ["aa"] * 120}
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(50, None), (51, ""), (None, " ".join(words(20) + shared)), (6, " ".join(docs[6]))]
    df = frame([(*r, "a", "b") for r in rows], DOCS)
    got = {}
    for r in passages.near_passages(df).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.other_id != r.doc_id
    begin = {1: (100, 60), 2: (10, 60), 3: (30, 120), 4: (0, 120), None: (20, 60), 41: (0, 300), 42: (60, 120)} | {n: (n, 61) for n in range(8, 20)}
    assert set(got) == set(begin)
    for i, (start, size) in begin.items():
        # The shared words, and at most five more at each end that similarity leaves room for; a little less beside edits.
        assert len(got[i] & set(range(start, start + size))) >= size - 6
        assert got[i] <= set(range(start - 6, start + size + 6))
    assert passages.near_passages(df.limit(0)).count() == 0


def test_every_partner_of_a_passage_is_linked(frame):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    text, other = words(125), words(70)
    docs = {5: text[:125], 3: text[:60] + words(30), 9: words(30) + text[55:120], 6: other + words(9), 7: words(9) + other, 8: words(90)}
    rows = passages.near_passages(frame([(i, " ".join(w), "a", "b") for i, w in docs.items()], DOCS)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(5, 3), (3, 5), (5, 9), (9, 5), (6, 7), (7, 6)} and len(rows) == 6
    spans = {r.other_id: (r.start_word, r.end_word) for r in rows if r.doc_id == 5}
    # Similarity leaves room for up to five words more at each end.
    assert spans[3][0] == 0 and 60 <= spans[3][1] <= 65 and 50 <= spans[9][0] <= 55 and 120 <= spans[9][1] <= 125
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows} == {(5, 3, 2), (3, 3, 1), (9, 3, 1), (6, 6, 1), (7, 6, 1)}


def test_live_windows_hold_a_passage_of_recurring_shingles():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(passages.TOKENS, 200))
        recurring = rng.random(n) < rng.choice([0.8, 0.88, 0.95])
        l, c, r = passages.compact_windows(rng.integers(0, 2**60, n).astype(np.uint64), passages.TOKENS)
        starts = [range(max(a, b - passages.TOKENS + 1), min(b, z - passages.TOKENS + 1) + 1) for a, b, z in zip(l, c, r, strict=True)]
        want = [any(recurring[s : s + passages.TOKENS].sum() >= passages.SHARED for s in each) for each in starts]
        assert passages._live(recurring, l, c, r).tolist() == want


def test_windows_of_documents_laid_out_together_are_those_of_each():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 9, n)) for n in (50, 49, 300, 0, 120, 80)]
    every = np.full(1 << 18, ~np.uint64(0))
    batch = pa.RecordBatch.from_pydict({"text_hash": range(10, 16), "id": range(6), "text": texts})
    got = [r for b in passages._windower(every, every)([batch]) for r in b.to_pylist()]
    want = []
    for i, text in enumerate(texts):
        found = passages.shingles(text)
        for fn in range(passages.HASHES) if len(found) >= passages.TOKENS else ():
            values = passages._mix(found, 2 + fn)
            l, c, r = passages.compact_windows(values, passages.TOKENS)
            first, last = np.maximum(l, c - passages.TOKENS + 1), np.minimum(c, r - passages.TOKENS + 1)
            keys = passages._mix(values[c], 99 + fn).view(np.int64)
            want += zip(keys.tolist(), [10 + i] * len(c), [i] * len(c), first.tolist(), c.tolist(), last.tolist(), [fn] * len(c), strict=True)
    place = passages._unpacked(np.array([r["place"] for r in got]))
    rows = zip(*([r[n] for r in got] for n in ("key", "text_hash", "id")), *(place[n].tolist() for n in ("first", "c", "last", "fn")), strict=True)
    assert all(r["live"] for r in got) and ordered(rows) == ordered(want)


def test_windows_of_one_document_only_are_not_kept(frame, monkeypatch):
    rng = random.Random(10)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    shared = words(60)
    docs = {1: words(400) + shared + words(400), 2: words(300) + shared + words(500)}
    kept, written = {}, passages.written

    def noted(rows, label):
        kept[label] = written(rows, label)
        return kept[label]

    monkeypatch.setattr(passages, "written", noted)
    rows = passages.near_passages(frame([(i, " ".join(w), "a", "b") for i, w in docs.items()], DOCS)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(1, 2), (2, 1)}
    windows = [r for label, df in kept.items() if "key" in df.columns and "open" not in label for r in df.where("key IS NOT NULL").collect()]
    holders = {}
    for r in windows:
        holders.setdefault(r.key, set()).add(r.id)
    assert windows and all(len(ids) > 1 for ids in holders.values())


def test_a_pair_brings_only_the_words_its_evidence_concerns():
    text = " ".join(f"w{k}" for k in range(2000))
    place = passages._packed(np.array([1000, 1010]), np.array([980, 1000]), np.array([990, 1010]), 3)
    evidence = [[{"key": 1, "place": int(p), "other_c": 7} for p in place]]
    sides = {n: [k] for k, n in enumerate(passages.SIDES)}
    kind = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64()), ("other_c", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([*map(pa.array, sides.values()), pa.array(evidence, kind), pa.array([text])], names=[*sides, "evidence", "text"])
    (row,) = [r for b in passages._cut_out([batch]) for r in b.to_pylist()]
    words = row["text"].split()
    assert words == text.split()[row["begin"] : row["begin"] + len(words)] and len(words) < 200
    assert row["begin"] <= 1000 - passages.TOKENS - 2 * passages.SLACK
    assert row["begin"] + len(words) >= 1010 + passages.PASSAGE + 2 * passages.SLACK


def test_a_common_line_pairs_no_documents(frame, monkeypatch):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    line, before = words(30), words(30)
    docs = {i: words(60) + line + words(60) for i in range(78)}
    docs |= {i: words(40) + before + line + words(40) for i in (100, 101)}
    met, paired = [], passages._paired
    monkeypatch.setattr(passages, "_paired", lambda found, label: met.append(found.count()) or paired(found, label))
    rows = passages.near_passages(frame([(i, " ".join(w), "a", "b") for i, w in docs.items()], DOCS)).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(100, 101), (101, 100)}
    assert all(r.start_word <= 40 and r.end_word >= 100 for r in rows)
    assert sum(met) < len(docs) ** 2


# Benchmark


def test_items_are_found_also_with_other_values(frame):
    items = [
        (1, "If Mary has 12 apples and gives 5 kg of them to Tom then how many apples does Mary keep for herself"),
        (2, "tiny item here"), (3, None), (4, ""), (5, "7 8 9"),
    ]
    docs = [
        (1, "Hello. If Anna has 99 apples and gives 7 kg of them to Bob then how many apples does Anna keep for herself? ok"),
        (2, "If Anna has 99 apples and gives 7 kg of them to Bob then how many apples does Eve keep for herself"),
        (3, "x tiny item here y"), (None, "x tiny item here y"), (5, None), (6, ""), (7, "7 8 9"), (8, "word " * 30_000 + items[0][1] + "."), (8, "other"),
    ]
    df, asked = frame([(*d, "x") for d in docs], "doc_id long, text string, hash string"), frame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.changed) for r in decontamination.contaminated(df, asked).collect()}
    assert got == {(1, 1): (1.0, True), (3, 2): (1.0, False), (None, 2): (1.0, False), (8, 1): (14 / 15, False)}
    kept = decontamination.without_benchmark(df, asked)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7]
    assert decontamination.contaminated(df.limit(0), asked).count() == decontamination.contaminated(df, asked.limit(0)).count() == 0


def _held(frame, items, docs):
    df = frame([(*d, "x") for d in docs], "doc_id long, text string, hash string")
    return {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, frame(items, "item_id long, text string")).collect()}


def test_items_of_few_plain_words_are_found(frame):
    sums = "Work out the value of the sum 12 + 7 * 3 - 4 / 2 + 9 - 8 + 6 * 5 and write down the result of it"
    items = [(1, "What is 12 + 7 * 3 - 4 / 2 ?"), (2, sums), (3, "Anna Lee met Bob Ray near Rome then Eve Fox saw Dan Poe near Oslo")]
    docs = [(1, f"Hello. {items[0][1]} Yes."), (2, "What is 13 + 7 * 3 - 4 / 2 ?"), (3, f"so: {sums}."), (None, items[2][1])]
    docs += [(4, sums.replace("12", "31").replace("9", "77")), (5, sums[:31] + " and write down the result of it"), (6, sums[:36])]
    got = _held(frame, items, docs)
    assert {k: (r.coverage, r.changed) for k, r in got.items()} == {(1, 1): (1.0, False), (3, 2): (1.0, False), (None, 3): (1.0, False), (4, 2): (1.0, True)}


def test_names_at_sentence_starts_are_slots(frame):
    ask = "{0} has 12 red apples and gives some of them to a friend at school. {0} then buys 5 more apples at the shop and eats one. How many apples are left"
    docs = [(1, ask.format("Anna")), (2, ask.format("Anna Maria")), (3, ask.format("Bob").replace("12", "40")), (4, "Two. " + ask.format("Mary"))]
    docs += [(5, ask.replace("{0} then", "Eve then").format("Mary")), (6, "Anna has a dog.")]
    got = _held(frame, [(1, ask.format("Mary"))], docs)
    assert {k[0]: r.changed for k, r in got.items() if k[0] != 5} == {1: True, 2: True, 3: True, 4: False} and got[1, 1].coverage == got[3, 1].coverage == 1.0


def test_items_of_the_documents(spark):
    flat = lambda t: " ".join(t.lower().split())
    items = [(r.item_id, flat(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in _documents(spark) for i, text in items if text in flat(t)}
    assert {(r.doc_id, r.item_id) for r in decontamination.query(spark, SF).collect()} == want


# Token files


def test_token_files_round_trip(spark, frame, tmp_path):
    rows = _documents(spark) + [
        (None, "á b"), (-5, None), (-4, ""), (-3, "<|endoftext|> x <|ENDOFTEXT|>"), (-2, "ΑΣ ΣΑΣ. İst ŐŐ ǅ ﬁ 日本 é\ń"), (-1, "don't I'LL 12\x1c34\x85q w​v"),
        (10**12, "Very Long. " * 40_000), (10**12, "Very Long. " * 40_000), (10**12, "tie"),
    ]
    docs = frame([(*r, "x", "y") for r in rows], "doc_id long, text string, part string, offset string")
    tokenizer = Tokenizer.from_file(tokenfiles.vocabulary_path())
    ids = {(i, t): tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    manifest = tokenfiles.write_files(docs, str(tmp_path / "files"), tokenfiles.vocabulary_path(), file_text_bytes=50_000)
    assert manifest.count() > 3
    got = tokenfiles.read_digests(manifest, str(tmp_path / "files")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered((i, len(ids[i, t]), crc(ids[i, t])) for i, t in rows)
    # Any record by itself, in any order.
    part = manifest.orderBy("part").first()
    back = list(tokenfiles.records_of(str(tmp_path / "files"), part.records, part["index"], order=[part.n_docs - 1, 0]))
    assert len(back) == 2 and back[1][0] is None and back[1][1].tolist() == ids[None, "á b"]
    assert tokenfiles.encode_and_read(docs.limit(0)).count() == 0


def test_damaged_records_are_refused(frame, tmp_path):
    manifest = tokenfiles.write_files(frame([(1, "some words")], "doc_id long, text string"), str(tmp_path / "f"), tokenfiles.vocabulary_path())
    (row,) = manifest.collect()
    path = tmp_path / "f" / row.records
    data = bytearray(path.read_bytes())
    for place in (3, 14, len(data) - 1):
        bad = bytearray(data)
        bad[place] ^= 1
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            list(tokenfiles.records_of(str(tmp_path / "f"), row.records, row["index"]))


def test_encoder_equals_whole_texts():
    path = tokenfiles.vocabulary_path()
    whole, encoder = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    rng = random.Random(4)
    alphabet = "aBcÉßÿĀǅµªΣ'sşé1²٣.,;:!?#*$%&\")(]['’-_/ \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2003\u3000\u0301\u1100\u1161한İ<|"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["don't We'Re they'll!", "a<|endoftext|>b <|startoftext|>, end.", "Word, word. WORD*** word...", "École. ÉCOLE, école"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype=encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    # A cache that is emptied all the time gives the same.
    assert tokenfiles.Encoder(path, 3).encode(texts) == encoder.encode(texts)


def test_reader_joins_nothing(spark, frame, tmp_path):
    docs = frame([(i, "some words here " * 9, "x", "x") for i in range(50)], DOCS)
    folder = str(tmp_path / "files")
    manifest = tokenfiles.write_files(docs, folder, tokenfiles.vocabulary_path(), file_text_bytes=600)
    read = tokenfiles.read_digests(manifest, folder)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    rows = sorted(tuple(r) for r in read.collect())
    assert manifest.count() > 3 and [r[1] for r in rows] == [sum(r[2] for r in rows[:k]) for k in range(50)]


def test_latin_tokens_are_the_general_ones():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(chr(rng.randrange(256)) for _ in range(200))
        assert decontamination.tokens_of(text) == decontamination._TOKENS.findall(text)
    mixed = "Größe 3½ € ǅungla ١٢ é\u0301a"
    assert decontamination.tokens_of(mixed) == decontamination._TOKENS.findall(mixed)
    for letter in map(chr, range(256)):
        assert decontamination.tokens_of(letter) == decontamination._TOKENS.findall(letter)
