"""Phrase mining, lexical search and page text: against plain versions, with awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skyledger.llm import best_position, collocations, html_text
from tests.llm.common import awkward, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, longest=3, least=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang or "und", *words[i:i + n]) for i in range(len(words) - n + 1))
    found = {key: a for key, a in counts.items() if len(key) > 2 and a >= least}
    out = {}
    for (lang, *words), a in found.items():
        score, k = min((1000000 * a * a // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words)))
        longer = [b for (other, *own), b in found.items() if other == lang and len(own) > len(words) and any(own[i:i + len(words)] == words for i in range(len(own)))]
        if not any(100 * b >= share * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]], totals[lang]))
    return {(lang, rank, p.decode(), -a, left, right, n, -score) for lang, own in out.items() for rank, (score, a, p, left, right, n) in enumerate(sorted(own)[:top], 1)}


def phrase_rows(frame):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}


def spoken(seed, n, words=25):
    rng = random.Random(seed)
    return "".join(f"W{rng.randrange(words)}" + rng.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", "\x0b", "; "]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_match_counting_everything(spark, seed):
    rows = [(k, spoken(seed * 100 + k, 300), ["en", "de", None][k % 3], "s") for k in range(24)] + awkward()
    rows += [(99, "new york city " * 40 + "É é É é " * 12 + "again again again", "en", "s")] * 2
    docs = documents(spark, rows).repartition(4)
    got = phrase_rows(collocations.mine(docs))
    assert got == plain_phrases([(r[1], r[2]) for r in rows])
    assert phrase_rows(collocations.mine(docs, top=5)) == plain_phrases([(r[1], r[2]) for r in rows], top=5)


def test_phrases_across_small_chunks_and_wide_keys(spark, monkeypatch):
    """Chunks of a few texts, and more words than fit a packed key, give the same."""
    rows = [(k, spoken(k, 200, 12), "en", "s") for k in range(20)]
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 100)
    want = plain_phrases([(r[1], r[2]) for r in rows], longest=4, least=4)
    assert phrase_rows(collocations.mine(documents(spark, rows).repartition(3), longest=4, min_count=4)) == want
    texts = [" ".join(f"v{k}" for k in range(70_000)).encode() + b" v1 v2 v3 v4"]
    _, total, sizes = collocations.grams(texts, 4)
    found = [dict(zip(map(tuple, f.tolist()), c.tolist(), strict=True)) for f, c in sizes]
    assert total == 70_004 and found[3][2, 3, 4, 5] == 2 and len(found[3]) == 70_000


def test_no_phrases(spark):
    for rows in ([], [(1, None, "en", "a"), (2, "", None, "a"), (3, " . , ", "en", "a")], [(1, "one two " * 3, "en", "a")]):
        assert collocations.mine(documents(spark, rows)).collect() == []


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for least in (5, 10):
        keys = np.concatenate([rng.integers(0, 1 << 60, 60_000), np.repeat(rng.integers(0, 1 << 60, 300), rng.integers(1, 40, 300)), np.full(5_000, 7)]).astype(np.uint64)
        rng.shuffle(keys)
        summary = collocations.Summary(collocations.SLACK * len(keys) // least + 1)
        summary.capacity = len(keys) // least + 1  # the least that the guarantee allows
        for part in np.array_split(keys, 50):
            summary.add(*np.unique(part, return_counts=True))
        own, times = np.unique(keys, return_counts=True)
        left = summary.frequent(least)
        assert set(own[times >= least].tolist()) <= set(left.tolist())
        assert 0 < summary.error < least and len(summary.keys[0]) <= summary.capacity


def test_phrase_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    found = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big), ("en", 2, "a b", big - 13)], "group string, n int, phrase string, f long")
    row = collocations.scored(found).first()
    assert (row.l, row.r, row.score) == (big + 7, big, 1000000 * (big - 13) ** 2 // ((big + 7) * big))


def plain_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, length, df = len(bags), sum(x[2] for x in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        query = set(term.findall((text or "").translate(LOWER)))
        found = []
        for i, bag, size in bags:
            m = 100 - 50 + (50 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in query if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_rows(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("k", "postings", "read"), [(50, 2_000_000, 32), (3, 200, 1), (10, 50, 4)])
def test_search_matches_scoring_every_document(spark, monkeypatch, k, postings, read):
    monkeypatch.setattr(best_position, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(best_position, "FIRST_READ", read)
    rng = random.Random(k)
    rows = [(i, prose(i, rng.randrange(1, 90), 9), "en", "s") for i in range(150)] + awkward() + [(500 + i, "w1x1 W2X2, é_É", "en", "s") for i in range(30)]
    items = [(i, prose(1000 + i, rng.randrange(1, 12), 9)) for i in range(12)] + [(50, None), (51, ""), (52, "...!"), (53, "nowhere"), (54, "É é w1x1 one"), (54, "É é w1x1 one"), (None, "w2x2 again")]
    queries = spark.createDataFrame([(*x, "s", 1) for x in items], "item_id long, text string, doc_id string, number int")
    got = search_rows(best_position.search(documents(spark, rows).repartition(3), queries, k=k))
    assert got == plain_search([(r[0], r[1]) for r in rows], dict.fromkeys(items), k)


def test_search_in_slices_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(best_position, "SLICE_TERMS", 20)
    rows = [(i, prose(i, 40, 6), "en", "s") for i in range(60)]
    items = [(i, prose(100 + i, 5, 6)) for i in range(9)]
    docs, queries = documents(spark, rows), spark.createDataFrame(items, "item_id int, text string")
    assert search_rows(best_position.search(docs, queries)) == plain_search([(r[0], r[1]) for r in rows], items, 50)
    for some, others in ((docs, queries.limit(0)), (docs.limit(0), queries), (documents(spark, [(1, None, "en", "s")]), queries)):
        assert best_position.search(some, others).collect() == []


def test_search_stops_early():
    """On lists of which the best documents lead, only a part is met, and the bound is strictly below the k-th score."""
    n = 5_000
    size = np.full(n, 2)
    times = np.repeat(np.arange(n, 0, -1), 2)
    block = best_position.Block(pa.array(range(n), pa.int64()), np.full(n, 50), size, np.tile([0, 1], n), times, np.array([500, 700]), n, 50 * n)
    met = []
    original = np.unique
    try:
        np.unique = lambda x, *a, **b: (met.append(len(x)), original(x, *a, **b))[1]
        found, totals = block.search([0, 1], 10, np.zeros(0, np.int64))
    finally:
        np.unique = original
    assert found.tolist() == list(range(10)) and (np.diff(totals) <= 0).all() and sum(met) < n


ARTICLE = ["A headline, here", "First paragraph of the story, with some length and a few marks; it goes on. And on.", "Short.", "Second paragraph, which says more about the matter, at length, and ends. It does."]
BODY = f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p><p>{ARTICLE[3]}</p>"
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, sport, more.</a></li></ul></nav>'
FOOT = "<footer>&copy; all rights reserved, see the terms. They are long, and full of marks; read them.</footer>"
LONG = "I read this with interest, and I disagree; the matter is older, and more involved. See my page, where I say why."


@pytest.mark.parametrize("page", [
    f"<html><head><title>x, y.</title></head><body>{MENU}<div class='ad'>{LONG}</div><article>{BODY}</article>{FOOT}</body></html>",
    f"<body>{MENU}<main><article>{BODY}</article><section id=comments><p>{LONG}</p><p>{LONG}</p></section></main><aside>{LONG}</aside>{FOOT}",
    f"<body><header><p>{LONG}</p></header><article>{BODY}<div class='share-buttons social'><p>Share, like, and so on.</p></div><form><p>{LONG}</p></form><ul><li><a href=x>{LONG}</a></li></ul></article>",
    f"<body>{MENU}<div id=content class='post has-sidebar-left'>{BODY}</div><div class=cookie-notice><p>{LONG}</p></div>{FOOT}</body>",
    f"<body>{MENU}<div>{BODY}</div><div class='commentList'><p>{LONG}</p></div><script>var a = '</p>' + \"<article>\";</script>{FOOT}",
    f"<BODY>{MENU}<ARTICLE><STYLE>p > b {{}}</STYLE><H1>{ARTICLE[0]}<P>{ARTICLE[1].replace('story', '<b>st<i>o</i>ry</b>')}<P><B>{ARTICLE[2]}<BR><P>{ARTICLE[3].replace(' ', ' ' * 3 + chr(10))}</ARTICLE><!-- <p>no --><FOOTER>x",
    f"<article class=comment><p>{LONG}</p></article><article>{BODY}</article><article class='comment'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>",
    f"<div class='layout-sidebar'><article>{BODY}<div class=newsletter>{LONG}</div></article></div>",
    f"<form action=/>{MENU}<article title='a > b' data-x=it's>{BODY}</article></form><p hidden>{LONG}</p><div style='display: none'>{LONG}</div>",
])
def test_page_text_is_the_article(page):
    assert html_text.main_text(page) == "\n".join(ARTICLE)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("<html><body><nav>menu</nav>", ""), ("<script>only", ""), ("<article>a &lt;b&gt; &amp; c&#33; &eacute;&nbsp;d &am", "a <b> & c! é d &am"),
    ("plain text, no markup.", "plain text, no markup."), ("<article><p>one<p>two</b></i></div><td>three</article>", "one\ntwo\nthree"),
    ("<article><p>a < b and 3 > 2</p><p>cut <a href='", "a < b and 3 > 2\ncut"), ("<div>" * 3000 + "deep, down." + "</div>" * 3000, "deep, down."),
    ("<article><p>x</p><script>", "x"), ("<article><svg><title>t</title><path></svg><p>y<svg/>z</p></article>", "y z"), ("<article><ul><li>one<li>two</ul>tail</article>", "one\ntwo\ntail"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_path_ratios_part_prose_from_lists():
    """Without marks or names: the paths of the paragraphs stand out by length and punctuation."""
    page = "<body>" + "".join(f"<span><ul><li>Item {k}</li></ul></span>" for k in range(12)) + f"<div><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>" + "".join(f"<ol><li>Link {k}</li></ol>" for k in range(12))
    assert html_text.main_text(page) == "\n".join([LONG, LONG, "Short.", LONG])


def test_extract_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "t", 5), (1, "u", f"<article>{BODY}</article>", "t", 5), (None, None, None, None, None), (3, "v", "<article><p>" + "\U0001F600 word " * 60_000, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()), key=str)
    long = ("\U0001F600 word " * 60_000).strip()
    want = [(1, "u", "\n".join(ARTICLE), len("\n".join(ARTICLE)))] * 2 + [(0, None, "", 0), (3, "v", long, len(long))]
    assert got == sorted(want, key=str)
    assert html_text.extract(pages.limit(0)).collect() == []
