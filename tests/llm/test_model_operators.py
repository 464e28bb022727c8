"""Toxicity, page texts, packing, neighbours and the pipeline: accuracy on held-out rows, round trips, brute force."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import cases
from shelfspark.llm import html_text, packing, permutation_index, toxicity
from shelfspark.llm.common import read
from shelfspark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.DOC_SCHEMA)


# toxicity ---------------------------------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in read(spark, cases.SF_MORE, "labels").collect()}
    found = QUERIES["op1_toxicity"](spark, cases.SF_MORE).collect()
    assert len(found) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in yes for b in no]) >= 0.9
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.93 * len(held)


def test_toxicity_locates_the_sentence(spark):
    rng = random.Random(2)
    plain = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "café"]
    sentence = lambda: " ".join(rng.choices(plain, k=6)) + "."
    texts, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        texts.append(" ".join([sentence(), sentence(), *(["Such a nastyword here!"] if bad else []), sentence()]))
        marks.append((i, 1, int(bad), "clash"))
    docs = cases.frame(spark, texts)
    labels = spark.createDataFrame(marks + [(None, 1, 1, ""), (7, 1, None, "")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in out)
    for r in out:
        assert [texts[r.doc_id][x.start:x.end] for x in r.offending] == (["Such a nastyword here!"] if r.predicted else [])


def test_toxicity_score_is_noisy_or(spark):
    model = ({"bad": 3.0, "worse": 5.0, "worse*": 1.0}, -2.0)
    p = lambda z: 1 / (1 + np.exp(-z))
    texts = ["Bad day. worse! ok", None, "", " \n ", "bad bad\nfine", "x" * 300_000 + ". bad"]
    expected = [1 - (1 - p(1.0)) * (1 - p(4.0)) * (1 - p(-2.0)), p(-2.0), p(-2.0), p(-2.0), 1 - (1 - p(4.0)) * (1 - p(-2.0)), 1 - (1 - p(-2.0)) * (1 - p(1.0))]
    out = {r.doc_id: r.score for r in toxicity.score(cases.frame(spark, texts), model).collect()}
    assert [round(out[i], 9) for i in range(len(texts))] == [round(float(x), 9) for x in expected]


def test_toxicity_without_labels(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = cases.frame(spark, ["a", None])
    assert [r.score < 1e-9 for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()] == [True, True]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert all(r.predicted == 1 for r in toxicity.score(docs, toxicity.learn(docs, one)).collect())
    assert toxicity.score(empty, ({}, 0.0)).count() == 0


# page texts -------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><script>var x='</p><p>no';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>"
     "<header><h2>Site</h2></header><article><header><h1>Head &amp; more</h1></header><p>One  two<br>three &eacute;&#8212;<b>bold</b>.</p>"
     "<p>Next <a href=x>linked</a>\n&nbsp;words<ul><li>a<li>b</ul><div class='ad box'>Buy</div><form><p>mail<input></form></article>"
     "<section id=comments><p>I think so</p></section><aside>side</aside><footer>&copy; foot</footer></body></html>",
     "Head & more\nOne two three é—bold.\nNext linked words\na\nb"),
    ("<body><div id=page><div class=menu><a href=1>one</a> <a href=2>two</a></div><div class=content><p>" + "Long text of the story. " * 20
     + "</p><p>" + "And more of that here. " * 20 + "</p><p>Short.</p></div><div class='cookie-notice'>We use cookies</div>"
     "<div><a href=3>other page</a><a href=4>another page</a></div></div></body>",
     ("Long text of the story. " * 20).strip() + "\n" + ("And more of that here. " * 20).strip() + "\nShort."),
    ("<p>no closing <b>tags<p>second", "no closing tags\nsecond"),
    (None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt;  only", "plain <text> only"), ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>a<!-- no --><![CDATA[b]]></p><style>p{}</style><script>1<2</article></script><p>c", "ab\nc"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<nav>only menus</nav>", ""),
    ("<body><div class='site-header'>Site name and slogan</div><article class='has-sidebar overflow-hidden'><div class='entry-header'><h1>T</h1></div>"
     "<p>Body text.</p><div class='comment-list'><p>me too</p></div><div id=sidebar>x</div></article></body>", "T\nBody text."),
]


def test_page_texts():
    for page, text in PAGES:
        assert html_text.main_text(page) == text


def _prose(word: str, n: int = 40) -> str:
    return f"{word} is told of in many words and a few more. " * (n // 8)


def test_pages_are_searched_whole():
    """Without an article, with several, with nested ones, and with text beside a short one: density decides, no part of the text is lost."""
    a, b, c = (_prose(w).strip() for w in ("Alpha", "Beta", "Gamma"))
    paragraphs = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
    links = "<div>" + "".join(f"<a href={i}>page {i}</a> " for i in range(12)) + "</div>"
    text = lambda body: html_text.main_text(f"<html><body>{body}</body></html>").split("\n")
    assert text(links + "<div>" + paragraphs(a, b) + "</div>" + links) == [a, b]
    # several: all that pass the threshold, with their headings
    assert text(links + f"<article><h2>One</h2>{paragraphs(a, b, a)}</article><article><h2>Two</h2>{paragraphs(c, b)}</article>" + links) \
        == ["One", a, b, a, "Two", c, b]
    # nested: the inner one has more paragraphs than the one around it
    assert text(links + f"<article><h1>Outer</h1>{paragraphs(a)}<article><h2>Inner</h2>{paragraphs(b, c, b, c)}</article><p>End.</p></article>") \
        == ["Outer", a, "Inner", b, c, b, c, "End."]
    # the title stands beside the dense part; a list of links in the article is no text
    assert text(f"<article><h1>Title</h1><div>{paragraphs(a, b, c)}</div>{links}</article>") == ["Title", a, b, c]
    # a short article beside the text
    assert text(f"<article><p>Teaser</p></article><div>{paragraphs(a, b, c)}</div>") == [a, b, c]
    assert text(f"<main><h1>Title</h1><div>{paragraphs(a, b)}</div></main><div>{paragraphs(c)}</div>") == ["Title", a, b, c]


def test_page_class_words_leave_the_text():
    """Names of an article's own parts, and of whatever holds most of the text, leave nothing out; parts that are really named so go."""
    a, b, c = (_prose(w).strip() for w in ("Alpha", "Beta", "Gamma"))
    links = "".join(f"<a href={i}>page {i}</a> " for i in range(12))
    text = lambda body: html_text.main_text(f"<html><body>{body}</body></html>").split("\n")
    for name in ("post category-social", "tag-search", "ad", "comment"):
        assert text(f"<article class='{name}'><h1>T</h1><p>{a}</p><p>{b}</p></article>") == ["T", a, b]
    assert text(f"<article><h2 id='related-work'>Related work</h2><p>{a}</p><section id='discussion'><h2 id=comments>D</h2><p>{b}</p></section>"
                f"<p class='notice'>{c}</p><section class='social-history'><p>{a}</p></section><pre><span class='token comment'># {c}</span></pre></article>") \
        == ["Related work", a, "D", b, c, a, "# " + c]
    assert text(f"<div class='sidebar'><p>{a}</p><p>{b}</p></div><p>Short.</p>")[:2] == [a, b]
    assert text("".join(f"<div class='ad'><p>{x}</p></div>" for x in (a, b, c))) == [a, b, c]
    for part in (f"<div class='ad-300x250'>{b}</div>", f"<ul class='related-links'><li>{links}</ul>", f"<div id=comments><p>{b}</p><p>{c}</p><p>{a}</p></div>",
                 f"<div class='cookie-notice'><p>{b}</p></div>", f"<div role=navigation><p>{b}</p></div>", f"<span class='promo-box'>{b}</span>"):
        assert text(f"<article><p>{a}</p><p>{c}</p>{part}</article>") == text(f"<article><p>{a}</p><p>{c}</p></article>{part}") == [a, c]


def test_pages_given(spark):
    found = {r.page_id: r for r in QUERIES["op8_html_text"](spark, cases.SF_MORE).collect()}
    pages = read(spark, cases.SF_MORE, "pages").collect()
    assert len(found) == len(pages)
    for p in pages:
        article = re.search("<article>(.*)</article>", p.html, re.S).group(1)
        blocks = [" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        text = "\n".join(x for x in blocks if x)
        assert (found[p.page_id].text, found[p.page_id].url, found[p.page_id].n_chars) == (text, p.url, len(text))


N = 1_000_000
HOSTILE = {
    "open quote": ("<a " * (N // 3) + '"', N), "open names": ("<a" * (N // 2) + ' "', N + 2), "open quotes in turn": ('<a ""' * (N // 5) + "'", N + 1),
    "signs": ("<" * N, N), "nested": ("<div class=x>" * (N // 13) + "deep", 4), "stray ends": ("<div>" * (N // 11) + "</p></section>" * (N // 22) + "end", 3),
    "inline chain": ("<i><div>" + "<b>" * (N // 8) + "</i>" * (N // 8) + "end", 3), "open headers": ("<article>" + "<header>" * (N // 8) + "end", 3),
    "items": ("<li><b>" * (N // 7) + "end", 3), "open cdata": ("<![CDATA[" * (N // 9) + "x", 0), "white space": ("<a class" + " " * N + ">end", 3),
    "digits": ("<p>&#" + "9" * N + ";", 1), "comments": ("<!--" * (N // 4), 0),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    import time
    page, n = HOSTILE[kind]
    begun = time.time()
    assert len(html_text.main_text(page)) == n
    assert time.time() - begun < 30


def test_markup_of_broken_tags():
    kinds = lambda page: [x[2:] for x in html_text._Markup(page)]
    assert kinds('a<b c="d>e">f</b >g') == [("open", "b", ' c="d>e"'), ("close", "b", " ")]
    assert kinds('<a "<b>x') == [("open", "b", "")]  # an open quote: no tag, but one begins inside
    assert kinds("<a '<b \"'>'>\">") == [("open", "a", " '<b \"'")]
    assert kinds("< a><1><!x><?y?><![CDATA[z<b>]]><![CDATA[w") == [("", "", ""), ("", "", ""), ("cdata", "z<b>", ""), ("", "", "")]
    assert kinds("<p cut off") == [("open", "p", " cut off")] and kinds("<p/") == [("open", "p", "/")]


def test_page_table_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, PAGES[0][0], "clash", ""), (1, None, PAGES[0][0], "clash", ""), (None, "u", None, None, None)]
    out = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, ""), (1, PAGES[0][1]), (1, PAGES[0][1])]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


# packing ----------------------------------------------------------------------------------------------------------

def _check_packing(found, texts: dict, window=2048, slot=64):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for i, x in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in found:
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.length == len(piece) > 0 and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.queue))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(x)
    sizes = {}
    for s, pieces in by_sequence.items():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        sizes[s] = at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    queues = len({r.queue for r in found})
    assert sum(window - x for s, x in sizes.items() if s != max(sizes)) <= slot * queues
    return ids, by_sequence


def test_packing_given(spark):
    docs = read(spark, cases.SF, "documents").collect()
    found = QUERIES["op9_packing"](spark, cases.SF).collect()
    ids, by_sequence = _check_packing(found, {r.doc_id: r.text for r in docs})
    # every window holds the target mixture, to a slot or two of each queue, up to the one where the first queue runs out
    slots = {}
    for r in docs:
        slots[f"={r.source}"] = slots.get(f"={r.source}", 0) + len(ids[r.doc_id])
    owed = {q: (-(-n // 64)) ** packing.MIXTURE_POWER for q, n in slots.items()}
    share = {q: w / sum(owed.values()) for q, w in owed.items()}
    last = {}
    for s, pieces in by_sequence.items():
        for _, _, q in pieces:
            last[q] = max(last.get(q, 0), s)
    assert min(last.values()) >= 3
    for s in range(min(last.values())):
        own = {}
        for _, n, q in by_sequence[s]:
            own[q] = own.get(q, 0) + n
        assert all(abs(own.get(q, 0) - 2048 * p) <= 2.01 * 64 for q, p in share.items())


def test_packing_cases(spark, empty):
    texts = ["a <|endoftext|> b", None, "", "x", "word " * 5000, "é\U0001f600\n\t  <|endoftext|>", "b"]
    df = cases.frame(spark, texts, source=["s", None, None, "t", "s", "t", ""]).repartition(3)
    _check_packing(packing.pack(df).collect(), dict(enumerate(texts)))
    with_ids = packing.pack(df, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)
    few = packing.pack(df, max_queues=2).collect()
    assert {(r.source, r.queue) for r in few} == {("s", "=s"), (None, "rest"), ("t", "rest"), ("", "rest")}
    _check_packing(few, dict(enumerate(texts)))
    assert packing.pack(empty).count() == 0
    again = cases.frame(spark, ["same", "same"], ids=[1, 1])
    assert sum(r.length for r in packing.pack(again).collect()) == 2 * packing.pack(again).first().doc_tokens


def _first_shares(found) -> dict:
    own: dict = {}
    for r in found:
        if r.sequence_id == 0:
            own[r.source] = own.get(r.source, 0) + r.length
    return own


@pytest.mark.parametrize("weights", [{"x": 1, "y": 3, "z": 1}, {"x": 0.2, "y": 0.6, "z": 0.2, "absent": 4}])
def test_packing_follows_weights(spark, weights):
    texts = ["a b c d " * 3000, "e f g h " * 3000, "i j k l " * 800]
    df = cases.frame(spark, texts, source=["x", "y", "z"])
    found = packing.pack(df, weights=weights).collect()
    _check_packing(found, dict(enumerate(texts)))
    own = _first_shares(found)
    assert abs(own["y"] - 2048 * 3 / 5) <= 64 and abs(own["x"] - 2048 / 5) <= 64


def test_packing_weights_are_proportions(spark):
    df = cases.frame(spark, ["a b c d " * 3000, "e f g h " * 3000], source=["a", "b"])
    own = _first_shares(packing.pack(df, weights={"a": 0.7, "b": 0.3}).collect())
    assert abs(own["a"] - 2048 * 0.7) <= 64
    for bad in ({"a": 0, "b": 1}, {"a": -1.5, "b": 1}, {"a": float("nan"), "b": 1}, {"a": "1", "b": 1}, {"a": 1}):
        with pytest.raises(ValueError, match="weight"):
            packing.pack(df, weights=bad)


def test_packing_many_sources(spark):
    """Sources beyond the largest share a queue and keep their names."""
    n = 1500
    texts = [f"text number {i} " * (1 + i % 5) for i in range(n)]
    df = cases.frame(spark, texts, source=[f"s{i}" for i in range(n)]).repartition(3)
    found = packing.pack(df).collect()
    ids, _ = _check_packing(found, dict(enumerate(texts)))
    assert all(r.source == f"s{r.doc_id}" for r in found)
    rest = {r.source for r in found if r.queue == "rest"}
    assert len({r.queue for r in found}) == packing.MAX_QUEUES and len(rest) == n - packing.MAX_QUEUES + 1
    assert max(len(texts[int(s[1:])]) for s in rest) <= min(len(texts[i]) for i in range(n) if f"s{i}" not in rest)


def test_schedule_is_a_permutation_with_either_arithmetic():
    totals = {f"s{i}": n for i, n in enumerate([1, 64, 65, 1000, 10_000, 33_333])}
    for power in (1.0, 0.7):
        plan = packing.Schedule(totals, power=power)
        slots = [(q, j) for q, n in enumerate(plan.slots.tolist()) for j in range(n)]
        queue, j = (np.array(x) for x in zip(*slots, strict=True))
        ranks = plan.rank(queue, j)
        assert sorted(ranks.tolist()) == list(range(len(slots)))
        # by definition: due dates in order, of equal ones the earlier queue
        order = sorted(slots, key=lambda x: (Fraction(2 * x[1] + 1, 2 * int(plan.weight[x[0]])), x[0]))
        place = {x: k for k, x in enumerate(order)}
        assert ranks.tolist() == [place[x] for x in slots]
        plan.slots, plan.weight = plan.slots.astype(object), plan.weight.astype(object)
        assert ranks.tolist() == plan.rank(queue, j).tolist()


# neighbours -------------------------------------------------------------------------------------------------------

def _exact(vectors: dict[int, np.ndarray], k=20, every=20):
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = x @ vectors[i]
        out[i] = [j for j in ids[np.lexsort((ids, -s))] if j != i][:k]
    return out


@pytest.mark.parametrize("folder", [cases.SF_MORE, "/root/testdata/sf0.1"])
def test_neighbours_recall(spark, folder):
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in read(spark, folder, "embeddings").collect()}
    exact = _exact(vectors)
    found = {}
    for r in QUERIES["op10_permutation_index"](spark, folder).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(exact)
    hit = total = 0
    for q, expected in exact.items():
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, len(expected) + 1))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(abs(float(vectors[q] @ vectors[v]) - s) < 1e-12 for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & set(expected))
        total += len(expected)
    assert hit / total >= 0.95


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_neighbours_recall_with_varied_lengths(spark, spread):
    """Directions without clusters, log-normal lengths, a table of four times the candidates in one block; all queries."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 64))
    x *= np.exp(spread * rng.normal(size=(8000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in permutation_index.nearest_neighbours(df, candidates=2000, block_vectors=8192).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact = _exact(dict(enumerate(x)))
    assert set(found) == set(exact)
    assert sum(len(found[q] & set(e)) for q, e in exact.items()) / (20 * len(exact)) >= 0.95


def test_neighbours_cases(spark):
    rng = np.random.default_rng(0)
    good = {i: rng.normal(size=4).round(3) for i in range(60)}
    for i in range(20, 55):
        good[i] = good[20]  # a large group of equal vectors
    rows = [(i, v.tolist(), "clash") for i, v in good.items()]
    bad = [(100, None, ""), (120, [0.0] * 4, ""), (140, [1.0, None, 0.0, 0.0], ""), (160, [float("nan"), 1.0, 0.0, 0.0], ""),
           (180, [float("inf"), 0.0, 0.0, 0.0], ""), (200, [1.0], ""), (220, [], ""), (None, [1.0] * 4, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, perm string")
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect() if r.vec_id is not None and r.vec_id < 60}
    found = {}
    for r in permutation_index.nearest_neighbours(df, block_vectors=5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in found.items()} == _exact(vectors)
    few = spark.createDataFrame(rows[:3], df.schema)
    assert permutation_index.nearest_neighbours(few).count() == 2
    assert permutation_index.nearest_neighbours(df.limit(0)).count() == 0


# pipeline ---------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = read(spark, cases.SF_MORE, "documents")
    items = [(r.item_id, r.text) for r in read(spark, cases.SF_MORE, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    def step(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), cases.SF_MORE)
        assert out.columns == docs.columns
        found = out.collect()
        assert all(r.n_chars == len(r.text) for r in found)
        return found

    kept = step("language_id", rows)
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if any(c.isalpha() for c in r.text))
    ids = [r.doc_id for r in kept]
    lines = step("line_dedup", kept)
    assert sorted((r.doc_id, cases.sha(r.text)) for r in lines) == sorted((i, s) for i, _, _, s in cases.line_dedup([r.text for r in kept], ids))
    near = step("simhash_near_dedup", lines)
    prints = [cases.fingerprint(r.text) for r in lines]
    assert sorted(r.doc_id for r in near) == sorted(set(cases.components(prints, [r.doc_id for r in lines])))
    clean = step("decontamination", near)
    left = cases.contamination([r.text for r in clean], [r.doc_id for r in clean], items)
    assert not any(x[5] for x in left)
    before = {x[0]: x for x in cases.contamination([r.text for r in near], [r.doc_id for r in near], items)}
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == {i for i, x in before.items() if x[2] > 0.5 * x[1]}
    same = {r.doc_id: r.text for r in near}
    assert all(r.text == same[r.doc_id] for r in clean if not before[r.doc_id][5])
    packed = stages["packing"](spark, spark.createDataFrame(clean, docs.schema), cases.SF_MORE).collect()
    _check_packing(packed, {r.doc_id: r.text for r in clean})


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline
    texts, ids = cases.awkward(random.Random(8))
    cases.frame(spark, texts, ids).write.parquet(f"{tmp_path}/a/documents.parquet")
    read(spark, cases.SF_MORE, "benchmark").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    cases.frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
