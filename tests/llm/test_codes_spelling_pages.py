"""Vector codes, spelling variants and page texts against brute force and written-out layouts."""

import hashlib
import html
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.llm import codes, pages, spelling

VECTORS = "vec_id long, embedding array<float>, label int, `id` string, `numbers` int"


def by_hand(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) and the codebooks, one number after the other."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wide = max(1, -(-max([len(v) for _, v, _ in kept], default=0) // parts)) * parts
    kept = sorted(((i is None, i or 0, v + [0] * (wide - len(v)), lab) for i, v, lab in kept), key=lambda r: r[:3])
    w = wide // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(r[2])[p] for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for r in kept:
                x = cut(r[2])[p]
                got[best(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(got, books[p])]
    out = []
    for none, i, v, lab in kept:
        found = [best(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((None if none else i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    per = Counter()
    for r in out:
        per[r[3]] += r[2]
    return sorted(((i, c, d, per[lab], sha) for i, c, d, lab in out), key=repr)


@pytest.mark.parametrize("n, width, seed", [(60, 16, 1), (9, 8, 2), (40, 13, 3)])
def test_codes_equal_a_plain_version(spark, n, width, seed):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 0.2) for _ in range(width)], r.choice([1, 2, None])) for k in range(n)]
    rows[3] = (3, rows[5][1], None)
    rows += [(4, rows[4][1], 1), (4, [x / 2 for x in rows[4][1]], 2), (None, rows[7][1], 1), (90, None, 1), (91, [None] + rows[1][1][1:], 1), (92, [float("nan")] * width, 2), (93, [float("inf")] + rows[1][1][1:], None), (94, [0.25] * (width - 3), 2), (95, [], 2)]
    table = spark.createDataFrame([(*x, "a", 7) for x in rows], VECTORS).repartition(3)
    assert sorted((tuple(x) for x in codes.op11_codes(table).collect()), key=repr) == by_hand(rows)


def test_codes_of_hard_tables(spark):
    assert codes.op11_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert codes.op11_codes(spark.createDataFrame([(1, None, 1, "a", 1)], VECTORS)).collect() == []
    far = spark.createDataFrame([(1, [3e38] * 8, 1, "a", 1), (2, [-3e38] * 8, 1, "a", 1)] + [(k, [0.5] * 8, 1, "a", 1) for k in range(3, 30)], VECTORS)
    found = codes.op11_codes(far).collect()
    assert len(found) == 29 and all(r["error"] >= 0 for r in found)
    books = np.array([[[1, 2], [1, 2], [5, -7]]])
    assert codes.nearest(np.array([[[1, 2]], [[4, -6]]]), books)[0].tolist() == [[0], [2]]


def spelled(rows, least=6, often=5, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c in spelling.UPPER else c for c in run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= often}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_spelling_equals_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abéß") for _ in range(r.randint(5, 9))) for _ in range(60)]
    rows = []
    for k in range(300):
        words = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.08)), 59)]
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abé") + w[at:], w[:at] + r.choice("abé") + w[at + 1 :]])
            words.append(w if r.random() < 0.9 else w.upper())
        rows.append((k if k % 11 else None, r.choice([" ", "-", "\n", "1"]).join(words)))
    rows += [(1, None), (2, ""), (3, "×÷× É"), (7, rows[8][1]), (7, rows[8][1]), (8, "longword" * 5000 + " " + "ab" * 4)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert sorted(tuple(x) for x in spelling.op12_spelling(table).collect()) == spelled(rows)
    assert spelling.op12_spelling(table.limit(0)).collect() == []


def test_blocks_of_any_size_give_the_same_pairs(spark):
    r = random.Random(9)
    found = {"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(900)} | {"é", "", "x", "xy", "common" + "q" * 30, "common" + "q" * 31, "a b", "a  b", "1 2", "12"}
    want = {(a, b) if len(a) < len(b) or len(a) == len(b) and a < b else (b, a) for a in found for b in found if a < b and one_edit(a, b)} - {("", x) for x in found}
    table = spark.createDataFrame([(w,) for w in sorted(found)] * 2 + [(None,)], "word string")
    for most in (1, 8, 100_000):
        pairs = [tuple(x) for x in spelling.near_words(table, most).collect()]
        assert len(pairs) == len(set(pairs)) and {p for p in pairs if p[0]} == want


ARTICLE = ["The first paragraph of the article says what happened, where, and to whom it happened.", "A second one, with <a href='/x'>a link</a> and <b>bold <i>words</i></b>, goes on at length about why that matters.", "Short one.", "The last paragraph&nbsp;closes with a question &mdash; what comes next, &amp; when?"]
SAID = "A heading The first paragraph of the article says what happened, where, and to whom it happened. A second one, with a link and bold words, goes on at length about why that matters. Short one. The last paragraph closes with a question — what comes next, & when?"
BODY = "<h1>A heading</h1>" + "".join(f"<p>{p}</p>" for p in ARTICLE)
LINKS = "".join(f"<li><a href='/{k}'>Some section {k}</a></li>" for k in range(12))
CHAT = "".join(f"<li>I think that the author of this is quite wrong about all of it, number {k}, and let me say why at great length here.</li>" for k in range(20))
LAYOUTS = {
    "semantic": f"<!doctype html><html><head><title>T</title><script>if (a < b) document.write('<p>x</p>')</script></head><body><header><h1>Site</h1><nav><ul>{LINKS}</ul></nav></header><main><article>{BODY}</article><aside><p>Read this other long story that we also have for you today.</p></aside></main><footer>&copy; 2020 Some company, all rights reserved in all countries.</footer></body></html>",
    "divs": f"<body><div id=top><ul class='main-menu'>{LINKS}</ul></div><div class='cookie-notice'>We use cookies to make this site better for you, and for our 700 partners too.</div><div id=wrap><div class='sidebar'>{LINKS}</div><div id=content>{BODY}</div></div><div id='footer'>All rights reserved by the company that made this page for you to read.</div>",
    "comments by id": f"<body><div class='page has-sidebar'><div class=post>{BODY}</div><div id='comments'><h3>20 comments</h3><ol>{CHAT}</ol></div></div>",
    "comments by heading": f"<body><article>{BODY}<section><h2>Comments (20)</h2><ol>{CHAT}</ol></section></article>",
    "comments as articles": f"<body><main><article class='post comments-open'>{BODY}</article><section class='comments-area'>{''.join(f'<article class=comment><p>{c}</p></article>' for c in CHAT.split('</li>'))}</section></main>",
    "form around the page": f"<body><form id='aspnetForm'><div class='nav'>{LINKS}</div><div class='main-column'>{BODY}</div><div class='login-form'><input name=u value='no'> Your name and password, please, to go on reading.</div></form>",
    "adverts inside": f"<body><article><h1>A heading</h1><p>{ARTICLE[0]}</p><div class='ad-slot'>Buy a thing that you don't need, now at half of its price!</div><p>{ARTICLE[1]}</p><ins class='adsbygoogle'>Ad</ins><form><label>Your mail</label><input></form><p>{ARTICLE[2]}<p>{ARTICLE[3]}<div class='share-buttons'><a href=x>Share</a></div></article>",
    "unclosed": f"<html><head><meta charset=utf-8><title>T</title><body><nav><ul><li><a href=/>One<li><a href=/>Two</ul></nav><article><h1>A heading</h1><p><p>{'<p>'.join(ARTICLE)}</article><footer>Foot",
    "table layout": f"<body><table><tr><td><ul>{LINKS}</ul><td><table><tr><td>{BODY}</table></table>",
    "white space": "<body><article>\n  <h1>A\n heading</h1>\n\n" + "\n".join(f"<div>\t{p}\r\n </div>" for p in ARTICLE) + "\n</article>\n",
    "hidden": f"<body><div hidden>Not to be seen by any reader of this page at all.</div><div style='color:red; display: none'>Nor is this, whatever it says to its readers.</div><div role=dialog>Subscribe to our letter, and get a mail each day.</div><article>{BODY}</article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_article_of_a_layout(name):
    assert pages.main_text(LAYOUTS[name]) == SAID


def test_whole_articles_stay():
    listed = "<article><h1>How to</h1><ul>" + "".join(f"<li>Step {k}</li>" for k in range(30)) + "</ul><table><tr><th>a</th><td>b</td></tr></table><pre>x  =  1\n y</pre><figure><img src=x><figcaption>Shown</figcaption></figure><blockquote>Said</blockquote></article>"
    assert pages.main_text(f"<body><ul>{LINKS}</ul>{listed}") == "How to " + " ".join(f"Step {k}" for k in range(30)) + " a b x = 1 y Shown Said"
    assert pages.main_text("a &lt;b&gt; c<br>d") == "a <b> c d" and pages.main_text("plain  text") == "plain text"
    assert pages.main_text("<div>1 < 2 & 3 > 2</div><p title='a>b'>x</p") == "1 < 2 & 3 > 2 x"
    assert pages.main_text("") == pages.main_text("<script>x</script>") == pages.main_text("<!-- <p>x</p> -->") == ""


def test_long_pages_take_time_by_their_length():
    for unit in ("<p>word ", "<div>", "<a href='", "<!--", "</b>", "<b", "&amp", "<script>", "x<", "<li><ul>", "<td>", "<h2>Comments</h2>", "<div class=comments>", "<p =\"'"):
        took = []
        for n in (40_000, 160_000):
            began = time.process_time()
            pages.main_text(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 1, unit


def test_pages_as_a_table(spark):
    rows = [(1, "u", LAYOUTS["divs"]), (1, "u", LAYOUTS["divs"]), (2, None, None), (3, "v", ""), (None, "w", "<p>é𝄞"), (5, "long", "<article>" + "<p>word word</p>" * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("own"), "row": F.lit(1), "__html": F.lit("x")})
    found = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in pages.op13_html(table).collect()}
    assert found[1, "u"] == (SAID, len(SAID)) and found[2, None] == found[3, "v"] == ("", 0) and found[None, "w"] == ("é𝄞", 2)
    assert found[5, "long"] == (" ".join(["word word"] * 100_000), 999_999)
    assert pages.op13_html(table).count() == 6 and pages.op13_html(table.limit(0)).collect() == []
    whole = pages.extract(table)
    assert whole.columns == ["row", "text"] and whole.where("row.text = 'own'").count() == 6
    assert html.unescape("&am") == "&am"
