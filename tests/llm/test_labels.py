"""Toxicity, main text and the pipeline: held-out accuracy, planted cases, brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexwarden.llm import decontamination, maintext, mixing, simhash, tokenfiles, toxicity
from tests.llm.conftest import SF, ordered


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(900):
        words, toxic = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))], i % 6 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blorkhead", "snivelgit", "krudling", "fimwit" + rng.choice("abcd")]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    schema = "doc_id long, text string, label string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and 200 < len(held) < 400 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 700 < kept.count() < 780


def test_labels_do_not_leak_and_odd_rows(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(5000, None, "x"), (5001, "", "x"), (None, "you KRUDLING!!", "x"), (0, "again", "x"), (5002, "word " * 50_000, "x")], docs.schema)
    held = toxicity.crc_fold(F.col("doc_id")) == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped = flipped.unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema))
    first = ordered(map(tuple, toxicity.score(docs.unionByName(odd), labels).collect()))
    assert first == ordered(map(tuple, toxicity.score(docs.unionByName(odd), flipped).collect())) and len(first) == 905
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_without_both_classes(labelled):
    docs, labels = labelled
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()}) == 1


def test_words_and_features():
    lexicon = {"blork": 3.0, "fimw*": 2.0}
    code = lambda w: toxicity.word_code(w, lexicon)
    assert code("Blork!") >> 5 == 12 and code("fimwits") >> 5 == 8 and code("plain") == 0
    assert code("bl0rk") & 24 == 24 and code("b.l.o.r.k") & 16 and code("YOU") & 7 == 7
    found = dict(zip(toxicity.FEATURES, toxicity.features_of("you blork a b c d e f g h", code), strict=True))
    assert found["hit_density"] == 0.1 and found["hits_near_second_person"] == 1.0 and found["second_person"] == 0.1
    assert not toxicity.features_of(None, code).any()


# Main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept.</div>
%s<div class="sidebar"><h3>More</h3><ul><li><a href=x>One story</a></li></ul></div><section id="comments"><p>Great post, I liked it a lot.</p></section>
<form><p>Mail us your name and address please.</p><select><option>x</option></select></form><footer>&copy; 2020 Site. All of it.</footer></body></html>"""


@pytest.mark.parametrize("article", [
    "<article><h1>Title of it</h1><p>First &amp; long paragraph,\n with <b>bold</b><br>words.<p>Second one&nbsp;here.</p><div class=ad>Buy now!</div><p>Last words of the story.</p></article>",
    "<div id='content'><h1>Title of it</h1><p>First &amp; long paragraph, with bold words.</p><p>Second one here.</p><div class='advert'>Buy <b>now</b>!</div><p>Last words of the story.</p></div>",
    "<main><h1>Title of it</h1><p>First &amp long paragraph, with bold words.<p>Second one here.<aside>Buy now!</aside><p>Last words of the story.</main>",
])
def test_main_text_of_pages(article):
    want = ["Title of it", "First & long paragraph, with bold words.", "Second one here.", "Last words of the story."]
    assert maintext.main_text(PAGE % article) == "\n\n".join(want)


def test_pages_of_all_kinds(frame):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<article><p>a&am b", "x"), (2, "u", "<nav>only menu</nav>", "x"), (3, "u", "<article>" + "<p>Word here.</p>" * 3000, "x"), (4, "u", "<<>><p", "x")]
    got = maintext.extract_pages(frame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 6
    by_id = {r.page_id: r for r in got.collect()}
    assert by_id[1].text == "" and by_id[1].n_chars == 0 and by_id[None].text == "a&am b" and by_id[2].text == ""
    assert by_id[3].text.count("\n\n") == 2999 and got.limit(0).count() == 0


def test_minimum_cut_equals_all_labellings():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(labels, gain=gain, edges=edges):
            alone = sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gain, labels, strict=True))
            return alone + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(maintext.minimum_cut(gain, edges)) == pytest.approx(best)


# Pipeline


def test_stages_act_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    columns, now, seen = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, corpus_pipeline.written(stage(spark, now, SF), "test-stage")
        seen.append(name)
        rows, kept = before.collect(), now.collect()
        if len(seen) == 1:
            bad = {r.doc_id for r in toxicity.score(before, labels).collect() if r.predicted}
            assert ordered(kept) == ordered(r for r in rows if r.doc_id not in bad)
        elif len(seen) == 2:
            first = {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert ordered(kept) == ordered(r for r in rows if r.doc_id in first)
        elif len(seen) == 3:
            bad = {r.doc_id for r in decontamination.contaminated(before, items).collect()}
            assert ordered(kept) == ordered(r for r in rows if r.doc_id not in bad) and bad
        elif len(seen) == 4:
            size = {r.doc_id: (r["size"], r.taken) for r in mixing.plan_copies(before).collect()}
            assert ordered(kept) == ordered(r for r in rows for _ in range(size[r.doc_id][1] // max(1, size[r.doc_id][0])))
        else:
            assert ordered(map(tuple, kept)) == ordered(map(tuple, tokenfiles.encode_and_read(before).collect())) and len(kept) == len(rows)
        if len(seen) < len(corpus_pipeline.STAGES):
            assert now.columns == columns
    assert len(seen) == 5
    assert ordered(map(tuple, corpus_pipeline.run(spark, SF).collect())) == ordered(map(tuple, now.collect()))


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<div>word " * 20_000, 20_000),
        ("<b>x" * 20_000 + "</i>" * 20_000, 1),
        ("<i><p>" + "<b>x" * 20_000 + "</i>" * 20_000, 1),
        ("<ul><li>some text here " * 8_000, 8_000),
        (("<div>" * 2_000 + "word " + "</div>" * 2_000 + "more ") * 10, 20),
        ("text <!--" * 30_000, 1),
        ("text <a " * 30_000, 1),
        ("<" * 50_000, 1),
    ],
)
def test_hostile_pages_take_linear_time(page, blocks):
    started = time.monotonic()
    found = maintext.blocks_of(page)
    maintext.minimum_cut([maintext.odds(b) for b in found], maintext._edges(found))
    assert len(found) == blocks and time.monotonic() - started < 10


def test_a_comment_that_never_closes_hides_no_tags():
    found = maintext.blocks_of("<p>One.</p><!-- seen --><!-- open <p>Two.</p> <!-- again</body>")
    assert [(b.text, b.tag) for b in found] == [("One.", "p"), ("<!-- open", "body"), ("Two.", "p"), ("<!-- again", "body")]


def _plain_blocks(page):
    """Blocks with their whole path, by walking the stack for every tag and every block."""
    from html.parser import HTMLParser

    inline, silent, void = maintext.INLINE, maintext.SILENT, maintext.VOID
    blocks, stack, parts, nodes = [], [], [], [0]

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            path = [e for e in stack if e[0] not in inline]
            zones = [e[2] for e in stack if e[0] in inline] + [path[-1][2] if path else 0]
            blocks.append((text, path[-1][0] if path else "body", min(zones), [e[1] for e in path]))

    def close(tag, stops=lambda other: False):
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] == tag:
                del stack[at:]
                return
            if stops(stack[at][0]):
                return

    class Walk(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("br", "hr"):
                parts.append(" ")
            if tag not in inline | silent:
                flush()
                if tag == "body":
                    stack.clear()
                elif tag in ("p", "div", "ul", "ol", "table", "section", "article", "footer", "nav", "aside"):
                    close("p", lambda other: other not in inline | {"p"})
                elif tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                    close(tag, lambda other: other not in inline | {"p", tag})
            if tag not in void:
                nodes[0] += 1
                stack.append((tag, nodes[0], maintext._zone(tag, attrs, stack[-1][2] if stack else 0)))

        def handle_endtag(self, tag):
            if tag not in inline | silent:
                flush()
            close(tag, (lambda other: other not in inline) if tag in inline else lambda other: False)

        def handle_data(self, data):
            if not any(e[0] in silent for e in stack):
                parts.append(data)

    walk = Walk()
    walk.feed(page)
    walk.close()
    flush()
    return blocks


def _plain_edges(blocks):
    out, last = [], {}
    for i, (*_, path) in enumerate(blocks):
        near, under = {i - 1} if i else set(), tuple(path[:-1])
        near |= {last[under]} if under in last else set()
        last[under] = i
        for j in near:
            common = sum(x == y for x, y in zip(path, blocks[j][3], strict=False))
            out.append((j, i, maintext.SMOOTH / (1 + len(path) + len(blocks[j][3]) - 2 * common)))
    return sorted(out)


def test_blocks_of_random_tag_soup_equal_a_walk_of_the_stack():
    rng = random.Random(5)
    tags = "div p b i a span li ul td tr table article nav script section form body html br h1 em footer select dl dt header".split()
    names = ("", "", ' class="ad"', ' class="article"', ' id="comments"', ' class="main story"')
    texts = ("word ", "A sentence. ", " ", "&amp; ", "<!-- note -->", "<a ", "< ", "\u00a9 2020 ")
    for _ in range(1500):
        soup = [rng.choice((f"<{rng.choice(tags)}{rng.choice(names)}>", f"</{rng.choice(tags)}>", rng.choice(texts))) for _ in range(rng.randint(1, 40))]
        page = "".join(soup)
        want, got = _plain_blocks(page), maintext.blocks_of(page)
        assert [(b.text, b.tag, b.zone) for b in got] == [w[:3] for w in want], page
        assert sorted(maintext._edges(got)) == _plain_edges(want), page
