"""Main text of web pages by site template removal.

Each page becomes a tree; each element's subtree has a hash of its tags and texts. Spark counts, for each host, on how
many different pages a subtree occurs; subtrees that recur on MIN_PAGES of them are the site's template and are deleted.
Pages whose main element has the same longest block, the subtree itself aside, count once, so that copies of an article
aren't taken for a template.
Elements that are no article by their tag, or by a whole class, id or role (menus, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments), are deleted on every page. The text is that of the page's main element:
article, main, or a body of that name, whichever has most of the text, with large sibling articles; else the body.

In the main element a recurring subtree goes only if it is a container with links or few words: paragraphs that many
articles share are text. Of a header in it, headings and paragraphs stay. A class or id is a page part's name if all its
words are (NOT_ARTICLE), or are words of place or kind beside one (BESIDE), written apart, in camel case or together:
`ad-slot`, `adBox` and `cookiebar` are, `ad-hoc` and `related-work` aren't. Names alone don't decide where an article uses
them too: a section called `discussion` or `notice` (DOUBTFUL) stays in the main element if it is prose (few links, no
controls, no run of like items), and other containers whose names hold such a word go if links, controls or like items
show what they are; what holds reader comments by any class goes, unless it holds half of the page.

The templates found are few where sites repeat themselves much: up to FEW_TEMPLATES they are broadcast and no page is
shuffled; beyond, the pages' subtrees are joined with them by host and hash, and each page meets its own.

Handling of special cases: null or empty html gives the empty text; unclosed, misplaced and unknown tags are accepted,
and a quote that isn't closed before white space or the tag's end ends with the tag; an element of media or scripts that isn't
closed is read as if it were empty; an unclosed comment ends with the page; reading takes time in proportion to
the page; a null url has a host of its own (the empty name); pages without a main element or without any tag give the
text of all they have; a form that holds half of the page's words is no form; repeated rows are answered each; very long
pages are whole; columns of other names are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm.common import bounded_batches, read_table, stored, texts_of

MIN_PAGES = 10
FEW_WORDS, LINKED = 60, 0.3  # of a recurring container inside the main element
FEW_TEMPLATES = 200_000  # that are broadcast, some 20 MB

# Names of HTML elements, and of page parts in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe canvas object textarea title audio video".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option input dialog menu datalist annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()) - {"br"}
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot option optgroup body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLE = frozenset("nav navbar navigation menu submenu sidebar aside ad ads advert adverts advertisement advertisements adsense banner promo promotion sponsor sponsored cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist commentform commentarea respond replies disqus discussion breadcrumb breadcrumbs pagination pager widget toolbar login search searchbox searchform skip footer complementary contentinfo dialog".split())
BESIDE = frozenset("area bar block bottom box col column container content divider entry footer global group header holder inner item items left lg link links list main md mobile module outer page panel post primary region right row secondary section sections site slot sm story thread top unit wrap wrapper xs".split())
BESIDE_KINDS = frozenset("reader readers user users article articles blog fb facebook author post posts stories button buttons btn icon icons policy inline google video native sticky mega drop dropdown side text form forms head".split())
DOUBTFUL = frozenset("discussion search related recommended recommendations notice notices alert menu share social skip login promo promotion".split())
COMMENTS = frozenset("comment comments commentlist commentform commentarea replies disqus".split())
ONLY_OUTSIDE = frozenset("header masthead topbar".split())
MAIN_NAMES = frozenset("article articlebody articlecontent post postbody postcontent entry entrycontent story storybody maincontent main content".split())
CONTAINERS = frozenset("div section ul ol dl table figure details center header nav aside footer form".split())
NEVER = frozenset(["html", "body", "main", "article", *HEADINGS])  # no class makes these a page part
SAME_ENDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
TO_END = frozenset("script style textarea title".split())  # whose unclosed text goes on to the page's end
RAW_END = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
FEW_LINKS, PROSE = 0.2, 8  # share of linked words, and words, of prose


def tag_end(source: str, at: int) -> int:
    """The place of the > that ends the tag whose attributes begin at a place (there is one after it)."""
    begin = at
    while True:
        found = STOP.search(source, at)
        if not found:
            return source.find(">", begin)
        if not found[1]:
            return found.start()
        close = source.find(found[1], found.end())
        if close < 0 or not (close + 1 == len(source) or source[close + 1] in "/>" or source[close + 1].isspace()):
            return source.find(">", begin)  # a quote that isn't closed
        at = close + 1


@lru_cache(1 << 16)
def part_words(token: str, names: frozenset = NOT_ARTICLE) -> tuple[frozenset, bool]:
    """The names of page parts in a class, id or role, and whether it has no other words."""
    known, found, whole = names | BESIDE | BESIDE_KINDS, set(), True
    for w in WORDS.findall(HUMP.sub("-", token).lower()):
        joint = [w] if w in known else next(([w[:k], w[k:]] for k in range(2, len(w) - 1) if w[:k] in known and w[k:] in known and not names.isdisjoint((w[:k], w[k:]))), [])
        found.update(names.intersection(joint))
        whole &= bool(joint) or w.isdigit()
    return frozenset(found), whole


def is_part(token: str, names: frozenset = NOT_ARTICLE) -> bool:
    """Whether a class, id or role names a page part."""
    found, whole = part_words(token, names)
    return bool(found) and whole


class Page:
    """A page's elements as parallel lists; items holds texts, numbers of child elements, and None where a line breaks."""

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents, self.items = ["html"], [""], [-1], [[]]
        stack, opened = [0], Counter({"html": 1})
        last = source.rfind(">")
        unclosed: set[str] = set()
        begin = at = 0
        while 0 <= (lt := source.find("<", at)) < last:
            after = source[lt + 1 : lt + 2]
            found = NAME.match(source, lt)
            if not found and after not in ("!", "?"):
                at = lt + 1  # no tag
                continue
            if lt > begin:
                self._text(stack[-1], source[begin:lt])
            if not found:
                begin = at = self._past_comment(source, lt)
                continue
            end = tag_end(source, found.end())
            begin = at = end + 1 if end >= 0 else len(source)
            name, own = found[2].lower(), source[found.end() : end]
            if found[1]:
                self._close(stack, opened, name)
                continue
            if name == "br":
                self.items[stack[-1]].append(" ")
                continue
            if name in ENDS_P and opened["p"] and any(self.tags[i] == "p" for i in stack[-4:]):
                self._close(stack, opened, "p")
            if name in SAME_ENDS:
                self._close_same(stack, opened, name)
            new = len(self.tags)
            self.tags.append(name)
            self.attributes.append(own if "=" in own else "")
            self.parents.append(stack[-1])
            self.items[stack[-1]].append(new)
            self.items.append([])
            if name in VOID or own.endswith("/") and name in RAW:
                continue
            if name in RAW:
                begin = at = self._past_raw(source, name, at, unclosed)
                continue
            stack.append(new)
            opened[name] += 1
        if begin < len(source):
            self._text(stack[-1], source[begin:].partition("<!--")[0])

    @staticmethod
    def _past_comment(source: str, at: int) -> int:
        """The place after a comment or declaration."""
        if not source.startswith("<!--", at):
            end, mark = source.find(">", at), 1
        elif source.startswith(("<!-->", "<!--->"), at):
            return source.index(">", at) + 1
        else:
            end, mark = source.find("-->", at + 4), 3
        return end + mark if end >= 0 else len(source)

    @staticmethod
    def _past_raw(source: str, name: str, at: int, unclosed: set[str]) -> int:
        """The place after the end of an element that isn't read, elements of its name inside it included; unclosed: names
        of which no end comes any more."""
        depth, first = 1, -1
        if name not in unclosed:
            for m in RAW_END[name].finditer(source, at):
                if m[1]:
                    depth, first = depth - 1, m.end() if first < 0 else first
                elif name not in TO_END and not m[0].endswith("/>"):
                    depth += 1
                if depth == 0 or m[1] and name in TO_END:
                    return m.end()
            if first >= 0:
                return first
            unclosed.add(name)
        return len(source) if name in TO_END else at

    def _text(self, element: int, text: str) -> None:
        self.items[element].append(entities.unescape(text) if "&" in text else text)

    def _cut(self, stack: list[int], opened: Counter, k: int) -> None:
        opened.subtract(self.tags[i] for i in stack[k:])
        del stack[k:]

    def _close(self, stack: list[int], opened: Counter, name: str) -> None:
        if opened[name] > (name == "html"):
            self._cut(stack, opened, next(k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == name))

    def _close_same(self, stack: list[int], opened: Counter, name: str) -> None:
        kin = {"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",), "tr": ("td", "th")}.get(name, ())
        if not (opened[name] or any(opened[x] for x in kin)):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in SAME_ENDS[name]:
                return
            if tag == name or tag in kin:
                self._cut(stack, opened, k)
                if tag == name:
                    return

    def named(self, i: int) -> tuple[list[str], list[str]]:
        """The classes and itemprops of an element, and its ids and roles."""
        out: tuple[list[str], list[str]] = ([], [])
        for m in ATTRIBUTE.finditer(self.attributes[i]):
            out[m[1].lower() in ("id", "role")].extend((m[2] or m[3] or m[4] or "").split())
        return out

    def parts(self, words: list[int], linked: list[int]) -> list[int]:
        """Of each element: 2 if it is no article by its tag, name or features, 3 if a doubtful name holds prose, 1 for a
        header, 0 else."""
        n = len(self.tags)
        out, controls, items = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            controls[i] += self.tags[i] in ("input", "button", "select", "textarea")
            controls[self.parents[i]] += controls[i]
            if self.tags[i] in CONTAINERS or self.tags[i] in ("li", "article"):
                items[self.parents[i]] += 1
        for i, tag in enumerate(self.tags):
            if tag in DROPPED:
                out[i] = 0 if tag == "form" and 2 * words[i] >= words[0] else 2
            elif tag == "header":
                out[i] = 1
            elif self.attributes[i] and tag not in NEVER:
                classes, ids = self.named(i)
                wide = tag in CONTAINERS
                names = [part_words(x) for x in (classes + ids if wide else classes)]
                told = linked[i] > FEW_LINKS * words[i] or controls[i] > 0 or items[i] >= 3
                prose = words[i] >= PROSE and not told
                if any(whole and found - DOUBTFUL for found, whole in names) or wide and 2 * words[i] < words[0] and any(found & COMMENTS for found, _ in map(part_words, classes)):
                    out[i] = 2
                elif any(whole and found for found, whole in names):
                    out[i] = 3 if prose else 2 if wide or told else 0
                elif wide and told and 2 * words[i] < words[0] and any(found for found, _ in map(part_words, classes)):
                    out[i] = 2
                elif wide and any(is_part(x, ONLY_OUTSIDE) for x in classes + ids):
                    out[i] = 1
        return out

    def measured(self) -> tuple[list[int], list[int], list[int]]:
        """Of each element: the hash of its subtree, its words, and those in links."""
        n = len(self.tags)
        hashes, words, linked = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            parts = [self.tags[i]]
            for x in self.items[i]:
                if isinstance(x, int):
                    parts.append(f"\x01{hashes[x]:x}")
                    words[i] += words[x]
                    linked[i] += linked[x]
                else:
                    own = x.split()
                    words[i] += len(own)
                    parts.append(" ".join(own))
            if self.tags[i] == "a":
                linked[i] = words[i]
            hashes[i] = xxhash.xxh64_intdigest("\x02".join(parts))
        return hashes, words, linked

    def roots(self, words: list[int], parts: list[int]) -> list[int]:
        """The main elements: those of the best kind whose largest has half the words of any other kind's, and with it
        the other ones of that kind and half its size; the whole page where there is none."""
        gone, inside = [False] * len(self.tags), [0] * len(self.tags)
        kinds: dict[int, list[int]] = {3: [], 2: [], 1: []}
        for i, tag in enumerate(self.tags):
            up = self.parents[i]
            gone[i] = i > 0 and (gone[up] or parts[i] == 2)  # a doubtful name's prose counts where an article is looked for
            inside[i] = inside[up] if i else 0
            if gone[i] or words[i] == 0 or i == 0:
                continue
            names = {re.sub("[^a-z]", "", x.lower()) for x in sum(self.named(i), [])} if self.attributes[i] else set()
            kind = 3 if tag == "article" or "articlebody" in names else 2 if tag == "main" else 1 if tag in ("div", "section", "td") and names & MAIN_NAMES else 0
            if kind and inside[up] < kind:
                kinds[kind].append(i)
                inside[i] = kind
        kept = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            if not gone[i]:
                kept[i] += sum(len(x.split()) for x in self.items[i] if isinstance(x, str))
                if i:
                    kept[self.parents[i]] += kept[i]
        most = max((kept[i] for own in kinds.values() for i in own), default=0)
        for own in kinds.values():
            largest = max((kept[i] for i in own), default=0)
            if largest and 2 * largest >= most:
                return [i for i in own if 2 * kept[i] >= largest]
        return [0]

    def blocks(self, root: int, deleted) -> list[str]:
        """Texts of the blocks under root in page order; deleted(element) is 2 for what goes, and 1
        where only headings and paragraphs stay."""
        out, line = [], []

        def flush():
            text = " ".join("".join(line).split())
            if text:
                out.append(text)
            line.clear()

        todo: list = [(x, False) for x in reversed(self.items[root])]
        while todo:
            x, few = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                if not few:
                    line.append(x)
            else:
                verdict = deleted(x)
                if verdict == 2:
                    continue
                tag = self.tags[x]
                only = (few or verdict == 1) and tag not in HEADINGS and tag != "p"
                if tag in BLOCK:
                    flush()
                    todo.append((None, False))
                todo += [(y, only) for y in reversed(self.items[x])]
        flush()
        return out


def extract(source: str, template: frozenset | set = frozenset()) -> str:
    """Main text of a page; template: hashes of the subtrees that its site repeats."""
    page = Page(source)
    hashes, words, linked = page.measured()
    parts = page.parts(words, linked)
    roots = page.roots(words, parts)

    def deleted(i: int) -> int:
        if parts[i] and not (parts[i] == 3 and roots != [0]):
            return 2 if parts[i] >= 2 or roots == [0] else 1
        recurs = hashes[i] in template and (roots == [0] or page.tags[i] in CONTAINERS and (words[i] <= FEW_WORDS or linked[i] >= LINKED * words[i]))
        return 2 if recurs else 0

    return " ".join(x for root in roots for x in page.blocks(root, deleted))


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def subtrees(page: Page) -> dict[int, int]:
    """Hashes of the blocks with text, the main elements left out, and for each that of the longest block of the main
    elements outside of it (of the two longest; 0 if it holds both)."""
    hashes, words, linked = page.measured()
    roots = set(page.roots(words, page.parts(words, linked)))
    inner, leaf, last = [False] * len(page.tags), [True] * len(page.tags), list(range(len(page.tags)))
    for i, tag in enumerate(page.tags):
        inner[i] = i in roots or i > 0 and inner[page.parents[i]]
        if i and tag in BLOCK:
            leaf[page.parents[i]] = False
    for i in range(len(page.tags) - 1, 0, -1):
        last[page.parents[i]] = max(last[page.parents[i]], last[i])
    longest = nlargest(2, ((words[i], hashes[i], i) for i, tag in enumerate(page.tags) if inner[i] and leaf[i] and tag in BLOCK))
    blocks = (i for i in range(1, len(hashes)) if words[i] and i not in roots and page.tags[i] in BLOCK)
    return {hashes[i]: next((h for _, h, at in longest if not i <= at <= last[i]), 0) for i in blocks}


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, hash of the subtrees that recur on at least MIN_PAGES pages of different longest blocks of a host.

    Counting is pre-aggregated; no page's html is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hosts, own, marks = [], [], []
            for host, source in zip(b["host"].tolist(), texts_of(b["html"])):
                found = subtrees(Page(source))
                hosts += [host] * len(found)
                own += found.keys()
                marks += found.values()
            if own:
                yield pd.DataFrame({"host": hosts, "hash": np.array(own, np.uint64).view(np.int64), "mark": np.array(marks, np.uint64).view(np.int64)})

    bounded_batches(pages)
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInPandas(run, "host string, hash long, mark long")
    return rows.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= MIN_PAGES).select("host", "hash")


def template_hits(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page (a hash of host and html) and template: which of the host's templates the page holds, by a join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [subtrees(Page(source)) for source in texts_of(b["html"])]
            sizes = [len(x) for x in sets]
            if any(sizes):
                yield pd.DataFrame({"page": np.repeat(b["page"].to_numpy(), sizes), "host": [h for h, n in zip(b["host"], sizes) for _ in range(n)], "hash": np.array([h for x in sets for h in x], np.uint64).view(np.int64)})

    rows = pages.select("page", "host", "html").mapInPandas(run, "page long, host string, hash long").distinct()
    return rows.join(found, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("template"))  # bounded by a page's elements


def extract_pages(pages: DataFrame, page_key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of each page."""
    spark = pages.sparkSession
    found = stored(templates(pages, url, html), "templates")
    rows = pages.select(F.col(page_key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    schema = T.StructType([T.StructField("page_id", pages.schema[page_key].dataType), T.StructField("url", pages.schema[url].dataType), T.StructField("text", T.StringType())])
    if found.count() <= FEW_TEMPLATES:
        known: dict[str, list[int]] = {}
        for r in found.collect():
            known.setdefault(r["host"], []).append(r["hash"])
        shared = spark.sparkContext.broadcast({host: np.array(x, np.int64) for host, x in known.items()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sets: dict[str, set] = {}
            for b in batches:
                for host in set(b["host"]) - sets.keys():
                    sets[host] = set(shared.value[host].view(np.uint64).tolist()) if host in shared.value else set()
                yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [extract(x, sets[h]) for h, x in zip(b["host"], texts_of(b["html"]))]})

        return rows.mapInPandas(run, schema)

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [set(np.array(x, np.int64).view(np.uint64).tolist()) if x is not None else set() for x in b["template"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [extract(x, s) for s, x in zip(sets, texts_of(b["html"]))]})

    keyed = rows.withColumn("page", F.xxhash64("host", "html"))
    return keyed.join(template_hits(keyed, found), "page", "left").select("page_id", "url", "html", "template").mapInPandas(run_joined, schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
