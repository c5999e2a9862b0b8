import math
import re
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from factgraph.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><header>site</header>
<article><header><h1>Head &amp; line</h1></header><p><b>One <i>two</i>.<br><p>Three&nbsp;four &lt;x&gt; <div class="share-box">share</div><aside>side</aside>
<form><input value="a">send</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><section id="comments"><p>reader</p></section><footer>foot</footer></article><p>outside</p><footer>&copy;</footer></body>"""


def test_article():
    assert h.main_text(PAGE) == "Head & line\n\nOne two.\n\nThree four <x>\n\na\n\nb\n\nc\n\nd"


def test_without_an_article():
    page = "<body><div id=menu>m</div><div class=content><h2>H</h2>one<p>two <em>three</em></div><div class='cookie-banner'>c</div><div hidden>x</div><div style='display: none'>y</div>"
    assert h.main_text(page) == "H\n\none\n\ntwo three"


def test_wrappers_named_after_what_they_hold():
    assert h.main_text('<div class="with-sidebar"><form><article class="post has-comments"><p>a</p><div class="comments">b</div></article></form></div>') == "a"
    assert h.main_text('<article class="comment"><p>x</p></article><article><p>a</p></article>') == "a"
    assert h.main_text('<div class="site-header">top</div><p>a</p>') == "a"
    assert h.main_text('<article><div class="header"><h1>t</h1></div><p>a</p></article>') == "t\n\na"
    assert h.main_text('<div class="no-sidebar"><p>all there is</p></div>') == "all there is"
    assert h.main_text("<nav>menu</nav><aside>x</aside>") == ""


def test_broken_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<html><body></body></html>") == ""
    assert h.main_text("just < text & more") == "just < text & more"
    assert h.main_text("<p>open <b") == "open"
    assert h.main_text("<article><p>a</div></span></p>b</article>") == "a\n\nb"
    assert h.main_text("<article>x<script>never closed") == "x"
    assert h.main_text("<article>a<!-- not closed") == "a"
    assert h.main_text('<article><p title="a>b">c</p></article>') == "c"
    assert h.main_text("<ARTICLE><P>Big</P></ARTICLE>") == "Big"
    assert h.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_words_within_values_are_no_attributes():
    kept = [
        'title="The hidden valley"', "title='hidden'", 'data-id="ad-17"', 'data-x="a" title="role=navigation class=ad"', "data-class=ad", "title=hidden/hidden", 'x:hidden="1"',
        'title="display: none" data-style="display:none"', 'class="a" class="ad"',
    ]
    for a in kept:
        assert h.main_text(f"<div {a}><article><p {a}>a</p></article></div>") == "a", a
    assert h.main_text('<article><p>b <a href="/guides/hidden-costs">c</a> <a href="/p?id=related">d</a> <a href=/p?id=related>e</a></p></article>') == "b c d e"
    for a in ("hidden", "title='x'hidden", "HIDDEN=''", 'class = "ad"', "class=ad", "aria-hidden=true", 'title="x" role=\'navigation\'', "style=display:none"):
        assert h.main_text(f"<article><p>a</p><div {a}>b</div></article>") == "a", a


def test_names_that_say_noise_in_part():
    kept = [
        '<h2 id="social-policy">b</h2>', '<h2 id="related-work">b</h2>', '<h3 id="comments">b</h3>', '<section id="search-menu">b</section>', '<section class="social-policy">b</section>',
        '<pre><span class="hljs-comment">b</span></pre>', '<pre><code><span class="token comment">b</span></code></pre>', '<p><span class="hljs-comment">b</span></p>',
        '<div id="comment-syntax">b</div>', '<p class="widget-theory">b</p>', '<p><a id="notice">b</a></p>',
    ]
    for x in kept:
        assert h.main_text(f"<article><p>a</p>{x}</article>") == "a\n\nb", x
    for x in kept[:8]:  # nor without an article
        assert h.main_text(f"<p>a</p>{x}") == "a\n\nb", x
    for x in ('<div class="share-box">b</div>', '<section id="comments">b</section>', '<ul class="post related-posts">b</ul>', '<div id="comment-12">b</div>', '<p><a class="skip-link">b</a></p>'):
        assert h.main_text(f"<article><p>a</p>{x}</article>") == "a", x
    assert h.main_text('<article class="related-research"><p>a</p></article><p>out</p>') == "a"
    assert h.main_text('<div role="main" class="with-sidebar"><p>a</p></div><p>out</p>') == "a"
    assert h.main_text('<p>a</p><div class="site-navigation">b</div>') == "a"


def test_the_tree_decides_about_hints_inside_an_article(spark):
    body = '<article><p>story {0}</p><div class="acme-widget-x">Same here</div><div class="acme-widget-y">note {0}</div></article>'
    found = h.extract(pages(spark, [(i, "http://a.example/", body.format(i)) for i in range(9)]))
    assert {r.page_id: r.text for r in found.collect()} == {i: f"story {i}\n\nnote {i}" for i in range(9)}


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "h") for r in rows], "page_id long, url string, html string, id string, salt int, low int, host string")


def test_repeated_branches_of_a_host_go(spark):
    body = "<body><div class=top>Welcome to us</div><div class=text><p>{0} story about {0}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", body.format(f"n{i}")) for i in range(12)]
    rows += [(100, "http://b.example/1", body.format("alone")), (101, None, None), (102, "::bad::", "<p>bad url</p>"), (103, "http://a.example/0", "")]
    found = {r.page_id: r.text for r in h.extract(pages(spark, rows)).collect()}
    assert found[3] == "n3 story about n3"
    # one page says nothing about its host
    assert found[100] == "Welcome to us\n\nalone story about alone"
    assert (found[101], found[102], found[103]) == ("", "bad url", "")


NINE = (
    '<article><h2 id="related-work">one</h2><h2 id="social-comment">two</h2><p class="alert">three</p><div class="share-price">four</div>'
    '<p id="ads-in-history">five</p><p>so <math><mi>x</mi><mo>=</mo><mn>6</mn></math></p><p><label>seven</label></p><p><button>eight</button></p><p>body {0}</p></article>'
)


def test_names_that_are_no_noise_keep_their_text(spark):
    whole = "one\n\ntwo\n\nthree\n\nfour\n\nfive\n\nso x=6\n\nseven\n\neight\n\nbody {0}"
    assert h.main_text(NINE.format("nine")) == whole.format("nine")
    found = h.extract(pages(spark, [(i, "http://a.example/", NINE.format(i)) for i in range(3)]))
    assert {r.page_id: r.text for r in found.collect()} == {i: whole.format(i) for i in range(3)}
    assert h.main_text("<article><p>a</p><form><label>b</label><button>c</button></form></article>") == "a"
    assert h.main_text('<article><p>a <math><mi>x</mi><annotation encoding="tex">\\x</annotation></math></p></article>') == "a x"


def site(n):
    """Pages whose boxes say what they are by repeating alone; every third page has another menu."""
    out = []
    for i in range(n):
        menu = "".join(f'<li><a href="/{k}">{k}</a></li>' for k in (["Home", "News"] if i % 3 else ["Start", "About"]))
        out.append(
            f"<body><div class=b0>Welcome to all</div><ul class=x1>{menu}</ul><article><h1>Same title</h1><p>Story {i} of {i * i}</p><table><tr><td>yes</td></tr></table>"
            f"<div class=y2><a href=/m>Mail this</a></div><div class=z3>Words {i % 2}</div><p>More {i} <em>each</em></p></article><div class=e4>Bye</div></body>"
        )
    return out


def test_the_tree_removes_repeated_boxes_around_and_inside_articles(spark):
    whole = "Same title\n\nStory {0} of {1}\n\nyes\n\n{2}Words {3}\n\nMore {0} each"
    for n, gone in ((12, ""), (5, "Mail this\n\n")):
        found = h.extract(pages(spark, [(i, "http://a.example/", p) for i, p in enumerate(site(n))])).collect()
        assert {r.page_id: r.text for r in found} == {i: whole.format(i, i * i, gone, i % 2) for i in range(n)}
    bare = [p.replace("article>", "main2>") for p in site(12)]  # nothing says where the article is
    found = h.extract(pages(spark, [(i, "http://a.example/", p) for i, p in enumerate(bare)])).collect()
    assert {r.text for r in found if r.page_id == 7} == {"Story 7 of 49\n\nWords 1\n\nMore 7 each"}
    alone = h.extract(pages(spark, [(i, f"http://{i}.example/", p) for i, p in enumerate(bare)])).collect()
    assert {r.text for r in alone if r.page_id == 7} == {"Welcome to all\n\nHome\n\nNews\n\nSame title\n\nStory 7 of 49\n\nyes\n\nMail this\n\nWords 1\n\nMore 7 each\n\nBye"}


class Plain(HTMLParser):
    """Elements of a well-formed page, as (path of styles, child styles, text below)."""

    def __init__(self, page):
        super().__init__()
        self.open, self.found = [("", [], [])], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        style = tag + "".join(f".{v}" for k, v in attrs if k == "class")
        style = re.sub(r"\d", "0", style) if "." not in style else style.split(".")[0] + "." + re.sub(r"\d", "0", style.split(".", 1)[1])
        self.open[-1][1].append(style)
        self.open.append((f"{self.open[-1][0]}>{style}", [], []))

    def handle_data(self, data):
        for _, _, said in self.open:
            said.append(data)

    def handle_endtag(self, tag):
        self.found.append(self.open.pop())


def brute_tree(texts):
    """Importance of each style node of a site by the formulas, with sequences and texts themselves for keys."""
    shown, said, kinds = defaultdict(list), defaultdict(list), defaultdict(int)
    for page in texts:
        here = {}
        for path, children, text in Plain(page).found:
            if path.rsplit(">", 1)[1] not in ("html", "body", "head"):
                c, t = here.setdefault(path, ([], []))
                c += [x for x, before in zip(children, [None, *children]) if x != before]
                t += text
        for path, (children, text) in here.items():
            shown[path].append(tuple(children))
            said[path].append(" ".join(" ".join(text).split()))
            kinds[path] = max(kinds[path], len(set(children)))
    out = {}
    for path in shown:
        m = len(shown[path])
        entropy = lambda seen: 1.0 if m == 1 else -sum(seen.count(x) / m * math.log(seen.count(x) / m, m) for x in set(seen))
        content = 1.0 if m == 1 else 1 - sum(math.log(said[path].count(x), m) for x in said[path]) / m
        weight = 0.9 ** kinds[path]
        out[path] = (m, entropy(shown[path]), content, (1 - weight) * entropy(shown[path]) + weight * content)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_the_tree_like_brute_force(spark, n):
    texts = [f"<html>{p}</html>" for p in site(n)] + ["<html><body><div class=b0>Other</div><p>Odd one</p></body></html>"] * (n > 2)
    tree = h.style_tree(pages(spark, [(i, "http://a.example/x", p) for i, p in enumerate(texts)])).collect()
    expected = brute_tree(texts)
    assert len(tree) == len(expected)
    key = lambda r: tuple(round(x, 6) + 0.0 for x in r)
    assert sorted(key((r.pages, r.presentation, r.content, r.importance)) for r in tree) == sorted(map(key, expected.values()))
    low = h.low_branches(h.style_tree(pages(spark, [(i, "http://a.example/x", p) for i, p in enumerate(texts)]))).collect()
    most = max(m for m, *_ in expected.values())
    best = max(i for m, _, _, i in expected.values() if 2 * m >= most)
    count = lambda limit, least: sum(m >= least and i / best < limit for m, _, _, i in expected.values())
    assert [tuple(map(len, (r.low, r.lowest, r.boxes))) for r in low] == ([(count(h.LOW, 4), count(h.LOWEST, 4), count(h.LOWEST, 8))] if n > 2 else [])


def test_importance(spark):
    body = "<body><div class=top>Same</div><div class=text>{0}</div></body>"
    tree = {(round(r.content, 6), r.pages) for r in h.style_tree(pages(spark, [(i, "http://a.example/", body.format(i)) for i in range(8)])).collect()}
    assert tree == {(0.0, 8), (1.0, 8)}


def test_a_host_of_copies_keeps_its_text(spark):
    found = h.extract(pages(spark, [(i, "http://a.example/", "<div><p>copy</p></div>") for i in range(9)]))
    assert {r.text for r in found.collect()} == {"copy"} and found.count() == 9


def test_a_declared_article_is_never_removed(spark):
    found = h.extract(pages(spark, [(i, "http://a.example/", "<div>x</div><article><p>copy</p></article>") for i in range(9)]))
    assert {r.text for r in found.collect()} == {"copy"}


def test_empty_table(spark):
    assert h.extract(pages(spark, [])).count() == 0
