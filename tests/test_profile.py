"""Page profiles, units of pages and the fuzzy join on pages and words whose answer is known; node tables in linear time."""

import random
import re
import time

import pytest

from leafmark.operators import analysis, fuzzy, profile
from leafmark.sources.html_nodes import Nodes, html_nodes

SAID = "The committee found that the river had risen and the bridge was closed to all but the lightest carts that week. "


def longform(paragraphs=8, sentences=5, heads=3, before=""):
    parts = [f"<h{1 if i == 0 else 2}>Part {i} of the river report</h{1 if i == 0 else 2}>" if i < heads else "" for i in range(paragraphs)]
    return f"<body>{before}<article>" + "".join(f"{h}<p>{SAID * sentences}</p>" for h in parts) + "</article></body>"


PAGES = {
    # name: address, html, page type, quiet
    "long article": ("https://news.example/river-report", longform(), "article", False),
    "article without the tag": ("https://news.example/a", longform().replace("article>", "div>"), "article", False),
    "recipe": ("https://food.example/soup", "<body><h1>Soup</h1><p>Ingredients and instructions. Prep time 5 minutes.</p>" + f"<p>{SAID * 3}</p>" * 4 + "<h2>Instructions</h2>" + f"<p>{SAID * 3}</p>" * 3 + "</body>", "recipe", False),
    "research": ("https://arxiv.org/abs/1", f"<body><h1>On rivers</h1><h2>Abstract</h2><p>{SAID * 4}</p><h2>Results</h2><p>{SAID * 4}</p><p>{SAID * 4}</p><p>{SAID}</p></body>", "research", False),
    "documentation": ("https://developer.example/docs/api", f"<body><h1>Client</h1><p>{SAID * 4}</p><h2>Parameters</h2><p>{SAID * 4}</p><pre>x = 1</pre><h2>More</h2><p>{SAID * 3}</p></body>", "docs", False),
    "tutorial": ("https://blog.example/x", f"<body><h1>How to mend a bridge</h1><p>Step by step. {SAID * 4}</p><h2>Setup</h2><p>{SAID * 4}</p><h2>Then</h2><p>{SAID * 3}</p></body>", "tutorial", False),
    "shop": ("https://shop.example/product/1", "<body><h1>Cart</h1>" + "<div class=product-price>9</div>" * 4 + "<p>Add to cart. Buy now. In stock. Checkout.</p></body>", "shopping_product", True),
    "application": ("https://app.example/dashboard", "<body><div class=dashboard role=toolbar>" + "<button>Go</button>" * 30 + "<nav>x</nav></div><p>few words</p></body>", "app_dashboard", True),
    "search results": ("https://www.google.example/search?q=x", "<body><div role=search></div>" + "<div class=result><a href=#>one two</a></div>" * 12 + "</body>", "search_results", False),
    "paged document": ("https://files.example/report.pdf", f"<body><h1>Report</h1><p>{SAID * 3}</p></body>", "pdf", False),
    "short page": ("https://x.example/", "<body><p>Nothing here.</p></body>", "low_structure", True),
    "discussion": ("https://stackoverflow.com/q/1", f"<body><h1>Why</h1><p>{SAID * 5}</p><h2>Because</h2><p>{SAID * 6}</p></body>", "discussion", False),
    "conversation": ("https://talk.example/", "<body>" + "".join(f"<div class=chat-message><p>{who}: {SAID * 2}</p></div>" for who in ("User", "Assistant") * 4) + "<h2>Summary</h2><p>The final answer and the corrected response.</p><pre>code</pre></body>", "chat", False),
}


def profiles(spark, pages):
    source = spark.createDataFrame(pages, "page_id long, url string, html string")
    nodes = html_nodes(source).cache()
    units = profile.page_units(nodes)
    return profile.page_profiles(profile.evidence(nodes, source, analysis.scored(units))), units


def test_kinds_of_pages(spark):
    found, _ = profiles(spark, [(i, url, html) for i, (url, html, _, _) in enumerate(PAGES.values())] + [(99, None, None), (98, None, longform())])
    got = {r.page_id: (r.page_type, r.quiet) for r in found.collect()}
    assert 99 not in got and got[98] == ("article", False)
    assert {name: got[i] for i, name in enumerate(PAGES)} == {name: p[2:] for name, p in PAGES.items()}


def test_confidence_grows_with_structure_and_falls_with_links(spark):
    links = "<ul>" + "<li><a href=#>one two three four</a></li>" * 200 + "</ul>"
    found, _ = profiles(spark, [(1, None, longform()), (2, None, longform(paragraphs=3, sentences=2, heads=1)), (3, None, longform(paragraphs=3, sentences=2, heads=1, before=links))])
    long, short, linked = (r.confidence for r in found.orderBy("page_id").collect())
    assert 96 >= long > short > linked >= 0


def test_units_of_a_page(spark):
    html = "<body><p>before any heading</p><h1 class='post title'>Top <b>one</b></h1><p>first words</p><ul><li>a b</li><li>c <a href=#>d e</a></li></ul><h2>Sub</h2><table><tr><td><p>in a table</p></td></tr></table><pre>x</pre><h2>ok</h2></body>"
    _, units = profiles(spark, [(1, None, html)])
    got = {r.section: r for r in units.collect()}
    assert sorted(got) == [0, 1]
    assert (got[0].title, got[0].body, got[0].class_trail) == ("Top one", "first words a b c d e", "post title")
    assert (got[0].paragraphs, got[0].list_items, got[0].bold_count, got[0].links, got[0].link_words) == (1, 2, 1, 1, 2)
    assert (got[1].title, got[1].body, got[1].tables, got[1].code_blocks, got[1].paragraphs) == ("Sub", "in a table x", 1, 1, 1)


@pytest.mark.parametrize("source", ["<div>x" * 100_000, "<b>x" * 20_000 + "</i>" * 20_000, "<table><tr><td><p>w" * 20_000, "<li>" * 50_000])
def test_nodes_take_time_in_proportion(source):
    began, parser = time.process_time(), Nodes()
    parser.feed(source)
    rows = parser.done()
    assert time.process_time() - began < 10 and len(rows) > 10_000 and sum(len(r[4]) for r in rows) < 80 * len(source)


def test_words_of_nodes_equal_those_of_their_text():
    rng = random.Random(9)
    for _ in range(60):
        source = "<body>" + "".join(rng.choice(["<p>", "</p>", "<b>", "</b>", "<a>", "</a>", "<li>", "</li>", "<br>", "ab", "c-d", " ", "e's ", ". ", "<h2>", "</h2>"]) for _ in range(60))
        parser = Nodes()
        parser.feed(source)
        for _, tag, _, _, text, words, linked, *_ in parser.done():
            if tag in ("p", "li", "h2", "body"):
                assert words == len(re.findall(r"[A-Za-z0-9_'-]*[A-Za-z0-9_][A-Za-z0-9_'-]*", text)), (source, tag)


# ---------------------------------------------------------------- the fuzzy join


def plain_form(t):
    return re.sub("[^a-z0-9]+", "", re.sub("rn", "m", t.lower().translate(str.maketrans("0i1", "oll"))))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_match(a, b):
    x, y = plain_form(a), plain_form(b)
    if a == b or not x or not y or min(len(a), len(b)) < 4 or abs(len(x) - len(y)) > 2:
        return None
    if x == y:
        return "ocr-glyph-normalized", 0
    most, d = 2 if max(len(x), len(y)) >= 10 else 1, plain_distance(x, y)
    if d <= most:
        return ("edit-distance", d) if d == 1 or min(len(x), len(y)) > 4 else None
    grams = [{f"  {z}  "[i : i + 3] for i in range(len(z) + 2)} for z in (x, y)]
    if min(len(x), len(y)) > 4 and len(grams[0] & grams[1]) / max(map(len, grams)) >= fuzzy.LIKENESS:
        return "trigram", 0
    return None


def test_fuzzy_join_equals_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeilmnorst01") for _ in range(rng.randint(3, 14))) for _ in range(60)]
    words = set(base) | {"modern", "modem", "corner", "comer", "b1ll", "bill", "abcd", "abce", "ab-cd"}
    for w in base:
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(v)) if v else 0
                rng.choice([lambda: v.__setitem__(at, rng.choice("xyz")), lambda: v.insert(at, "q"), lambda: v.pop(at)])() if v else None
            words.add("".join(v))
    asked, known = sorted(words)[::3], sorted(words)
    frame = lambda w: spark.createDataFrame([(x,) for x in w] + [(None,)], "term string")
    got = {(r.term, r.other): (r.method, r.distance) for r in fuzzy.fuzzy_matches(frame(asked), frame(known)).collect()}
    want = {(a, b): m for a in asked for b in known if (m := plain_match(a, b))}
    assert got == want and {m for m, _ in want.values()} >= {"ocr-glyph-normalized", "edit-distance"} and len(want) > 100


def test_best_match_is_the_strongest(spark):
    frame = lambda *w: spark.createDataFrame([(x,) for x in w], "term string")
    best = fuzzy.best_matches(fuzzy.fuzzy_matches(frame("modern", "bill"), frame("modem", "moderm", "b1ll", "bull"))).collect()
    assert {r.term: (r.other, r.method, r.candidates) for r in best} == {"modern": ("modem", "ocr-glyph-normalized", 2), "bill": ("b1ll", "ocr-glyph-normalized", 2)}
