"""Tree operators against plain walks over random trees."""

import random

from leafmark.operators import tree
from leafmark.sources.html_nodes import html_nodes

KIND = "page_id long, pre int, post int, tag string, words int, link_words int, classes string, role string, ident string"


def random_pages(seed, pages=12, size=60):
    """Trees as rows, with parents beside them."""
    rng, rows, parents = random.Random(seed), [], {}
    for p in range(pages):
        own = [rng.randint(0, 9) for _ in range(size)]
        up = [-1] + [rng.choice([i - 1, rng.randrange(i)]) for i in range(1, size)]
        path, fixed = [0], [-1]
        for i in range(1, size):  # parents on the path to the element before, so that numbers are in page order
            while path[-1] > up[i] and len(path) > 1:
                path.pop()
            fixed.append(path[-1])
            path.append(i)
        post, words = list(range(size)), own[:]
        for i in range(size - 1, 0, -1):
            post[fixed[i]] = max(post[fixed[i]], post[i])
            words[fixed[i]] += words[i]
        for i in range(size):
            tag = "body" if i == 0 else rng.choice(["div", "div", "p", "nav", "article", "section"])
            rows.append((p, i, post[i], tag, words[i], words[i] // 3 if tag != "p" else 0, rng.choice(["", "", "x cookie-bar", "entry-content"]), rng.choice(["", "", "main", "banner"]), rng.choice(["", "", "", "content"])))
            parents[p, i] = fixed[i]
    return rows, parents


def low(r):
    return r[3] in tree.LOW_TAGS or r[7] in tree.LOW_ROLES or "cookie" in r[6]


def test_visible_nodes_and_readable_words(spark):
    rows, parents = random_pages(1)
    by = {(r[0], r[1]): r for r in rows}

    def hidden(k):
        while k[1] >= 0:
            if low(by[k]):
                return True
            k = (k[0], parents[k])
        return False

    nodes = spark.createDataFrame(rows, KIND)
    assert {(r.page_id, r.pre) for r in tree.visible(nodes).collect()} == {k for k in by if not hidden(k)}
    got = {(r.page_id, r.pre): r.readable for r in tree.with_readable_words(nodes).collect()}
    for p, i in by:
        r = by[p, i]
        gone = [by[p, j] for j in range(i + 1, r[2] + 1) if low(by[p, j])]
        outer = [g for g in gone if not any(o is not g and o[1] < g[1] <= o[2] for o in gone)]
        assert got[p, i] == (0 if hidden((p, i)) else r[4] - sum(g[4] for g in outer)), (p, i)


def test_content_root_of_known_pages(spark):
    words = lambda n: "<p>" + "word " * n + "</p>"
    pages = {
        1: (f"<body><nav>{words(200)}</nav><article>{words(80)}</article></body>", "article", 80, False),
        2: (f"<body><article>{words(5)}</article><div class='x entry-content'>{words(300)}</div></body>", "body", 305, True),
        3: (f"<body>{words(50)}</body>", "body", 50, False),
        4: (f"<body><main>{words(70)}<aside>{words(500)}</aside></main></body>", "main", 70, False),
        5: (f"<body><article><a href=#>{words(130)}</a></article><div id=content>{words(200)}</div></body>", "div", 200, True),
        6: ("<body></body>", "body", 0, False),
    }
    source = spark.createDataFrame([(i, p[0]) for i, p in pages.items()] + [(7, None)], "page_id long, html string")
    got = {r.page_id: (r.tag, r.words, r.by_score) for r in tree.content_root(html_nodes(source)).collect()}
    assert got == {i: p[1:] for i, p in pages.items()}


def test_visible_sections_equal_a_stack(spark):
    rng = random.Random(6)
    rows = [(p, pos * 3, rng.randint(1, 6), rng.random() < 0.2) for p in range(8) for pos in range(40)]
    want = set()
    for p in range(8):
        stack = []  # levels of open sections and whether they or one around them is collapsed
        for _, pos, level, collapsed in (r for r in rows if r[0] == p):
            while stack and stack[-1][0] >= level:
                stack.pop()
            gone = bool(stack) and stack[-1][1]
            if not gone:
                want.add((p, pos))
            stack.append((level, gone or collapsed))
    got = tree.visible_sections(spark.createDataFrame(rows, "page_id long, pos long, level int, collapsed boolean")).collect()
    assert {(r.page_id, r.pos) for r in got} == want


def test_nested_elements_stand_for_their_containers_once(spark):
    rows, _ = random_pages(4)
    rng = random.Random(8)
    cut = [(r[0], r[1], r[2], r[4], rng.random() < 0.5) for r in rows if rng.random() < 0.6]
    want = []
    for p in range(12):
        result = []
        for r in sorted(x for x in cut if x[0] == p):
            over = next((e for e in result if e[1] < r[1] <= e[2]), None)
            if over is None:
                result.append(r)
            elif r[3] > over[3] * tree.REPLACING and r[4]:
                result[result.index(over)] = r
        want += result
    frame = spark.createDataFrame(cut, "page_id long, pre int, post int, words int, has_role boolean")
    assert sorted(map(tuple, tree.without_nested(frame).collect())) == sorted(want)
    assert tree.without_nested(frame.limit(0)).count() == 0
