"""Main texts of web pages: planted articles in several layouts, awkward HTML, and the
given pages, whose articles are marked."""

import html as entities
import random
import re

import pyarrow.parquet as pq
import pytest

from slatewright.llm import dom, extraction

SCHEMA = "page_id long, url string, html string"
WORDS = "river stone light window garden market silver paper north winter letter bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(rng):
    return [prose(rng, 6), *[prose(rng, rng.randrange(25, 60)) for _ in range(rng.randrange(2, 6))]]


def paragraphs(blocks):
    return f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])


def menu(rng, n=6):
    return "".join(f'<li><a href="/{k}">{prose(rng, 1)}</a></li>' for k in range(n))


def marked(rng, blocks):
    """Everything says what it is."""
    return f"""<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>p{{x:1}}</style><script>if (a<b) "</p>";</script></head><body class="page has-sidebar">
<header><h2>{prose(rng, 3)}</h2><nav><ul>{menu(rng)}</ul></nav></header><div id="cookie-notice">{prose(rng, 20)}</div><main><article class="post">{paragraphs(blocks)}
<aside>{prose(rng, 30)}</aside><div class="ad">{prose(rng, 9)}</div><form><label>Mail</label><input name=q><button>Send</button></form></article>
<section id="comments"><article class="comment"><p>{prose(rng, 40)}</p></article><article class="comment"><p>{prose(rng, 40)}</p></article></section></main>
<div class="sidebar"><p>{prose(rng, 50)}</p></div><footer>&copy; {prose(rng, 8)}</footer></body></html>"""


def plain(rng, blocks):
    """Nothing says what it is: a constant menu, notice and imprint, a list of links."""
    return f"""<html><body><div class="q1"><ul><li>Home</li><li>Travel and leisure</li><li>Contact</li></ul></div><div class="q2">This site is read by many people every day.</div>
<div class="q3">{paragraphs(blocks)}<div class="q9">Tell a friend</div></div><div class="q4"><ul>{menu(rng, 20)}</ul></div><div class="q5">All rights are with the owner of this paper, who prints it in the north.</div></body></html>"""


def ragged(rng, blocks):
    """Unclosed and misnested markup, references, breaks."""
    body = "".join(f"<p><b>{b}<br>" for b in blocks[1:])
    return f"<nav><ul><li><a href=/x>{prose(rng, 1)}<li><a href=/y>{prose(rng, 1)}</ul></nav><article><h1>{blocks[0]}</h2></i></h1>{body}</article></div></section><footer>{prose(rng, 5)}"


LAYOUTS = {"marked": marked, "plain": plain, "ragged": ragged}


@pytest.fixture(scope="module")
def planted():
    rng, rows, truth = random.Random(3), [], {}
    for name, layout in LAYOUTS.items():
        for _ in range(30):
            blocks, i = article(rng), len(rows)
            truth[i] = " ".join(blocks)
            rows.append((i, f"https://www.{name}.example.org/a/{i}?x=1", layout(rng, blocks)))
    return rows, truth


def found(spark, rows, schema=SCHEMA):
    made = extraction.extract(spark, spark.createDataFrame(rows, schema))
    assert made.columns == ["page_id", "url", "text", "n_chars"]
    out = [tuple(r) for r in made.collect()]
    assert all(n == len(t) for _, _, t, n in out)
    return out


def test_planted_articles(spark, planted):
    rows, truth = planted
    assert {i: t for i, _, t, _ in found(spark, rows)} == truth


def test_copies_make_nothing_constant(spark, planted):
    """Copies of a page outnumber the others of its host; near copies share long paragraphs."""
    rng, rows = random.Random(5), list(planted[0])
    truth, blocks = dict(planted[1]), article(rng)
    copy = marked(rng, blocks)
    for name in ("marked", "plain"):
        for _ in range(60):
            truth[len(rows)] = " ".join(blocks)
            rows.append((len(rows), f"http://www.{name}.example.org", copy))
    for _ in range(90):
        near = [*blocks, prose(rng, 30)]
        truth[len(rows)] = " ".join(near)
        rows.append((len(rows), "http://near.example.org/", marked(rng, near)))
    assert {i: t for i, _, t, _ in found(spark, rows)} == truth


def test_wrapper_by_shuffle(spark, planted, monkeypatch):
    monkeypatch.setattr(extraction, "SENT", 0)
    rows, truth = planted
    assert {i: t for i, _, t, _ in found(spark, rows)} == truth


def test_given_pages(spark):
    def marked_article(page):
        body = re.search(r"(?s)<article>(.*?)(</article>|\Z)", page)[1]
        return " ".join(entities.unescape(re.sub(r"<[^>]*>", "\n", re.sub(r"</?b>", "", body))).split())

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {i: t for i, _, t, _ in found(spark, [(r["page_id"], r["url"], r["html"]) for r in rows])}
    assert got == {r["page_id"]: marked_article(r["html"]) for r in rows}


ODD = [
    (None, ""), ("", ""), (" \n\t ", ""), ("plain words &amp; no markup", "plain words & no markup"), ("<p>one<p>two", "one two"), ("<p>a&nbsp;&#8211;&#x41; &bogus; &amp", "a –A &bogus; &"),
    ("<p>cut <b", "cut"), ("<!-- never ends <p>x", ""), ("<script>never ends <p>x", ""), ("a < b and 3 <5", "a < b and 3 <5"), ("</p></div>stray", "stray"), ("<p>foo<b>bar</b><br>baz<wbr>qux</p>", "foobar bazqux"),
    ("<p hidden>no</p><p style='display: none'>no</p><p title='a>b'>yes</p>", "yes"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<div>x" * 1500, " ".join(["x"] * 1500)),
    ("<article>" + "<p>w</p><div>v</div>" * 3000 + "</article>", " ".join(["w v"] * 3000)), ("<p>" + "long " * 80_000, ("long " * 80_000).strip()), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
]


@pytest.mark.parametrize("page,text", ODD)
def test_awkward_html(page, text):
    assert extraction.main_text(page or "") == text
    assert extraction.main_text(page or "", dom.read_template(dom.induce([page or "", "<p>x</p>"]))) == text


def test_odd_rows(spark):
    rows = [(i, url, page, "k", 1) for i, (page, _) in enumerate(ODD) for url in (None, "no host", f"https://h{i % 2}.example.org/")]
    rows += [(None, None, None, None, None), rows[10], rows[10]]
    got = found(spark, rows, SCHEMA + ", host string, template long")
    want = {i: t for i, (_, t) in enumerate(ODD)} | {None: ""}
    assert sorted((str(i), str(u), t) for i, u, t, _ in got) == sorted((str(r[0]), str(r[1]), want[r[0]]) for r in rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_matching_is_simple_tree_matching():
    """Against the plain recursion over all elements, on small random trees without runs."""

    def tree(rng, depth):
        kids, last = [], None
        for _ in range(rng.randrange(4) if depth else 0):
            tag = rng.choice([t for t in ("div", "section", "ul", "table") if t != last])
            last = tag
            kids.append((tag, tree(rng, depth - 1)))
        return kids

    def markup(kids):
        return "".join(f"<{t}>{markup(k)}</{t}>" for t, k in kids)

    def best(a, b):
        if a[0] != b[0]:
            return 0
        rows = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1]):
            for j, y in enumerate(b[1]):
                rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + best(x, y))
        return 1 + rows[-1][-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = tree(rng, 3), tree(rng, 3)
        page = dom.parse(markup(b))
        dom.settle(page)
        slot = dom.read_template(dom.induce([markup(a)]))
        want = best(("#", a), ("#", b))
        assert dom.score(slot, page, {}) == want
        dom.align(slot, page)
        stack, aligned = [page], 0
        while stack:
            n = stack.pop()
            aligned += n.tid is not None
            stack += n.kids
        assert aligned == want
