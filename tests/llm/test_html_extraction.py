"""Main text of pages: page parts by name and by recurrence, malformed pages, a plain reading, both template look-ups."""

import random
import time
from html.parser import HTMLParser

import pytest

from leafmark.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page">
<header><a href="/">Site</a></header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="newsletter-signup"><form><input>Sign up<button>Go</button></form></div>
<aside>Aside</aside><div class="sidebar-left">Side</div><div role="complementary">Also</div><div class="widget">W</div>
<main><article class="post category-social tag-search"><header><h1>Title &amp; more</h1><span class="byline">By A</span><p>Stand first.</p></header>
<p>One   <b>two</b>&nbsp;three.</p><p class="related-work">Related work is text.</p><h2 id="discussion">Discussion</h2>
<section id="comments-on-method"><p>Method text.</p></section><div class="ad-hoc">Ad hoc text.</div>
<div class="ad-slot">Buy now</div><div class="share">Share it</div><math><mi>x</mi><annotation>tex</annotation></math>
<ul><li>first<li>second</ul><table><tr><td>a<td>b</table><footer>Foot</footer></article></main>
<ol class="commentlist"><li>Reader says</li></ol><section id="comments"><p>Reader too</p></section><div class="post-comments">Three</div>
<script>var x = "<p>no</p>";</script><!-- <p>gone</p> --><noscript>None</noscript><footer>Legal</footer></body></html>"""


def test_page_parts_go_and_article_stays():
    want = "Title & more Stand first. One two three. Related work is text. Discussion Method text. Ad hoc text. x first second a b"
    assert H.extract(PAGE) == want


@pytest.mark.parametrize("source,want", [
    ('<p class="x>hello world', "hello world"), ('<p class="a>hello</p><p>w <a href="y">z</a></p>', "hello w z"), ("a < b and c > d", "a < b and c > d"), ("<![CDATA[x]]>y<![foo[x]]>z", "yz"), ("</p></div>text", "text"),
    ("<body><form><p>" + "word " * 20 + "</p></form></body>", ("word " * 20).strip()), ("<main><p>" + "long " * 50 + "</p><article>teaser</article></main>", ("long " * 50).strip() + " teaser"),
    ("<article><p>one two three</p></article><article><p>four five six</p></article><article>x</article>", "one two three four five six"), ("<p title='a>b' data-x=\"<i>\">t</p>", "t"), ("&#x1F600;&eacute;&bogus;", "\U0001f600é&bogus;"), ("\0<p>\t</p>", ""),
])
def test_odd_markup(source, want):
    assert H.extract(source).replace("\0", "") == want


@pytest.mark.parametrize("bad", ["<a ", "<a '", "<!", "</x", '<p class="x>', "<li><b>", "<b></x>", "<p =", "<", "<a <", "<!--", "&amp", "<td>", "<dd><dl>"])
def test_reading_takes_linear_time(bad):
    source = bad * (1_000_000 // len(bad))
    began = time.process_time()
    H.extract(source)
    assert time.process_time() - began < 12


class Plain(HTMLParser):
    """Text of the article element, a block at a time."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in H.BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in H.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_pages_equal_a_plain_reading_both_ways(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html or "")
        want[r.page_id] = " ".join(t for b in p.blocks if (t := " ".join(b.split())))
    assert {r.page_id: r.text for r in H.extract_pages(pages).collect()} == want
    monkeypatch.setattr(H, "FEW_TEMPLATES", -1)
    assert {r.page_id: r.text for r in H.extract_pages(pages).collect()} == want


def test_a_sites_template_goes_both_ways(spark, monkeypatch):
    box, note = "<div><p>Get our letter every week</p></div>", "<div><span>Follow our site</span></div>"
    site = [(i, f"http://s/{i}", f"<body>{note}<p>Text number {i} is here.</p>{box if i < 15 else ''}</body>") for i in range(30)]
    copies = [(100 + i, f"http://c/{i}", f"<body><article><p>One article that was copied many times with {'x' * 40}</p><div><p>same small part</p></div><p>edit {i}</p></article></body>") for i in range(30)]
    odd = [(200, None, "<p>no host"), (200, None, "<p>no host"), (None, "http://s/x", None), (201, "http://s/y", "")]
    rows = spark.createDataFrame(site + copies + odd, "page_id long, url string, html string")
    want = {i: f"Text number {i} is here." for i in range(30)} | {100 + i: f"One article that was copied many times with {'x' * 40} same small part edit {i}" for i in range(30)} | {200: "no host", None: "", 201: ""}
    for few in (H.FEW_TEMPLATES, -1):
        monkeypatch.setattr(H, "FEW_TEMPLATES", few)
        got = H.extract_pages(rows).collect()
        assert len(got) == 64 and {r.page_id: r.text for r in got} == want
        assert H.extract_pages(rows.limit(0)).count() == 0


ARTICLE = "<p>" + " ".join(f"word{i}" for i in range(30)) + ".</p>"
SENTENCE = "Here the article goes on with a sentence that says something of its own."


@pytest.mark.parametrize("name", "reader-comments user-comments article-comments blog-comments fb-comments author-comments commentSection related-posts related-articles share-buttons social-icons cookie-policy-notice cookiebar inline-ad google-ad video-ad adbox user-menu topnav login-form".split())
def test_parts_by_common_class_names_go(name):
    assert "REMOVE" not in H.extract(f"<html><body><main>{ARTICLE}<div class={name}><p>REMOVE me</p></div></main></body></html>")


@pytest.mark.parametrize("tag", ['section class="search"', 'div class="discussion"', 'div class="related"', 'section id="related-work"', 'div class="ad-hoc"', 'p class="notice"', 'span class="menu"'])
def test_article_sections_under_doubtful_names_stay(tag):
    assert SENTENCE in H.extract(f"<html><body><article>{ARTICLE}<{tag}>{SENTENCE}</{tag.split()[0]}></article></body></html>")


def test_comments_of_any_name_and_lists_of_links_go():
    comments = "".join(f"<div class=item><b>Ann {i}</b><p>{SENTENCE}</p></div>" for i in range(4))
    for part in (f"<div class='thread-xyz-comments'>{comments}</div>", f"<div class='search'><a href=x>{SENTENCE}</a></div>", "<div class='related'><input><p>ask here for all that you want to know</p></div>", f"<div class='related-xyz'>{comments}</div>"):
        assert SENTENCE not in H.extract(f"<body><article>{ARTICLE * 3}{part}</article></body>"), part
    both = f"<div class=discussion><p>{SENTENCE}</p></div><div class=notice><p>{SENTENCE}</p></div>"
    assert H.extract(f"<article>{both}</article>") == f"{SENTENCE} {SENTENCE}"


@pytest.mark.parametrize("tag", "video svg object canvas noscript audio".split())
def test_what_follows_an_unclosed_element_is_read(tag):
    assert H.extract(f"<article>{ARTICLE}<{tag} src=x><p>rest of it</p></article>").endswith("rest of it")


def test_comments_scripts_and_nested_drawings():
    assert H.extract("<article><svg><svg>in</svg>leak</svg><p>a b</p></article>") == "a b"
    assert H.extract("<article><!--><p>a b</p><!-- x --></article>") == "a b"
    assert H.extract("<!-- never closed") == "" and H.extract("<article>a<!-- never") == "a"
    assert H.extract("<article>a<script>x</script>b<script>c") == "ab"


def test_generated_pages_keep_their_articles_and_lose_the_rest():
    """Articles between parts under many names, each page of a host of its own: names and features alone."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kept = lost = noise = 0
    for _ in range(60):
        paragraphs = [text(rng.randint(12, 60)) for _ in range(rng.randint(3, 8))]
        parts = []
        for name in rng.sample("reader-comments commentSection userComments related-posts shareBar social-links cookie-notice adSlot top-menu newsletter-signup".split(), 4):
            inner = "".join(f"<div class=i><a href=#>NOISE{rng.randint(0, 99)}</a> NOISE {'NOISE ' * rng.randint(0, 9)}</div>" for _ in range(rng.randint(3, 5)))
            parts.append(f"<div class='{name}'>{inner}</div>")
        blocks = [f"<p>{p}</p>" for p in paragraphs] + [f"<section class='{rng.choice(['discussion', 'search', 'related'])}'><p>{(last := text(30))}</p></section>"]
        got = H.extract(f"<body>{parts[0]}<main>{parts[1]}{''.join(blocks)}{parts[2]}</main>{parts[3]}</body>")
        want = " ".join([*paragraphs, last])
        kept += sum(w in got.split() for w in want.split())
        lost += len(want.split())
        noise += got.count("NOISE")
    assert kept == lost and noise == 0
