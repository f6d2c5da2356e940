r"""The main text of web pages, by wrapper induction over the pages of a host.

1. A page is parsed into blocks (the text between block-level tags) and a skeleton: its tree of block-level elements by tag and class,
   in which neighbours of one kind are one node.
2. Different skeletons of a host are merged into its wrapper by simple tree matching: the largest mapping of two ordered
   trees that keeps roots, order and kinds. They are merged in groups of GROUP, the results again, until a host has one; a node that
   less than SPARSE of the merged pages have is left out, so a wrapper stays about as large as its pages.
3. A page's nodes find their slots in the wrapper by the same matching. A text that a slot holds on at least TEMPLATE of a host's
   different pages (by main text; LEAST_PAGES at least) is template; what varies is content.
4. Content of the article stays: what lies in `article` or `main`, or else in the largest element that is named as content, or
   else what varies and does not consist of links. What says that it is a menu, header, footer, sidebar, notice, advert, form or comment,
   by tag, role, class or id, goes, as do scripts, styles and hidden elements. Where template would take most of a
   marked article, the pages are copies of one article and nothing is taken.

All pages take part in all steps. Tasks hold single pages and GROUP skeletons; texts are compared by 64-bit digests, counted with
map-side sums. Wrappers are joined to pages by host: broadcast where their checked size allows, else by a shuffle join, whose hot hosts are
split by adaptive execution.

Null html and null url count as empty; pages without url share the host ''. Repeated rows each give a row. Broken pages are read as browsers
do: open elements are closed by what cannot stand in them, an unfinished tag or comment swallows the rest.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._shared import byte_parts, durable, fresh, give_back

#: A text is template where so large a share of a host's different pages hold it in one slot, and the host has so many.
TEMPLATE, LEAST_PAGES = 0.75, 4
#: Skeletons merged by one task, and the share of pages below which a node leaves the wrapper.
GROUP, SPARSE = 64, 0.1
#: Deeper elements belong to their ancestor at this depth.
DEPTH = 60
#: Levels with more pairs of unmatched siblings are aligned by their equal runs.
PAIRS = 200_000
#: Bytes of all wrappers that may be broadcast.
BROADCAST_BYTES = 16 << 20

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_UNSEEN = frozenset("audio button canvas datalist head map math noscript object option optgroup select svg template video".split())
_ENDS_P = _BLOCK - {"body", "caption", "html", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes first, and what such a search does not leave.
_CLOSES = {
    **{t: (frozenset("td th".split()), frozenset(["table"])) for t in ("td", "th")},
    "tr": (frozenset("td th tr".split()), frozenset(["table"])),
    **{t: (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])) for t in ("tbody", "thead", "tfoot")},
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    **{t: (frozenset("dt dd".split()), frozenset(["dl"])) for t in ("dt", "dd")},
    **{t: (_HEADINGS, _BLOCK - _HEADINGS) for t in _HEADINGS},
}
_P = (frozenset(["p"]), frozenset("table td th caption button object html".split()))
# Names that pages give to what is not the article, and to the article.
_ASIDE_TAGS = frozenset("aside dialog footer menu nav search".split())
_ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog directory doc-footnote form menu menubar navigation note search toolbar".split())
_COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond responses".split())
_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense advertorial banner breadcrumb breadcrumbs consent cookie cookies "
    "copyright colophon disclaimer flyout footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination paywall popup promo promos promotion promoted recommended recommendations related search share sharing sidebar signup skip social "
    "sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
_CONTENT = frozenset("article articlebody content entry main maincontent post story".split())
_QUALIFIED = frozenset("has no with without".split())

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Block(NamedTuple):
    """A text between block-level tags: its element, the text, and how many of its characters are links."""

    element: int
    text: str
    linked: int


class Page:
    """A parsed page: elements with parent, tag, kind (tag and class) and marks, and its blocks in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.kind = [-1], ["#page"], ["#page"]
        self.aside, self.article, self.content = [""], [False], [False]
        self.blocks: list[Block] = []
        self._read(html)

    def _named(self, tag: str, attributes: str) -> tuple[str, str, bool]:
        """The kind of an element, why it is no part of the article ('' if it may be, 'weak' if it is unless it holds all articles), and whether it is named as content."""
        given: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            given.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))
        names = f"{given.get('class', '')} {given.get('id', '')} {given.get('itemprop', '')}".split()
        kind = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in given.get("class", "").split()})])
        role = given.get("role", "").lower()
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "").lower()):
            return kind, "strong", False
        if role in _ASIDE_ROLES:
            return kind, "weak", False
        words: set[str] = set()
        for name in names:
            parts = [w.lower() for w in _WORDS.findall(name)]
            if _QUALIFIED.isdisjoint(parts):
                words.update(parts, ["".join(parts)])
        if not _COMMENTS.isdisjoint(words):
            return kind, "strong" if tag not in ("html", "body", "main") else "", False
        content = not _CONTENT.isdisjoint(words) or role in ("main", "article")
        if tag in ("html", "body", "main", "article") or words & _ASIDE == {"header"} and content:
            return kind, "", content
        return kind, "" if _ASIDE.isdisjoint(words) else "weak", content

    def _read(self, html: str) -> None:
        stack, opened = [0], {}  # elements, and how many of each tag are open
        buffer: list[str] = []
        linked, links, mute = 0, 0, 0
        place = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append(Block(next(e for e in reversed(stack) if self.tag[e] in _BLOCK or e == 0), text, linked))
                buffer.clear()
            linked = 0

        def said(text: str) -> None:
            nonlocal linked
            if text and not mute:
                text = references.unescape(text) if "&" in text else text
                buffer.append(text)
                if links:
                    linked += len("".join(text.split()))

        def pop() -> None:
            nonlocal links, mute
            element = stack.pop()
            tag = self.tag[element]
            opened[tag] -= 1
            if tag in _BLOCK:
                return
            links -= tag == "a"
            mute -= tag in _UNSEEN or bool(self.aside[element])

        def close(tags: frozenset[str], stops: frozenset[str]) -> None:
            """Close the innermost of these elements, if no stop stands before it."""
            if not any(opened.get(t) for t in tags):
                return
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag in tags:
                    flush()
                    while len(stack) > depth:
                        pop()
                    return
                if tag in stops:
                    return

        while m := _MARKUP.search(html, place):
            said(html[place : m.start()])
            place = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    said(" ")
                elif tag not in _VOID and opened.get(tag):
                    if tag in _BLOCK:
                        close(frozenset([tag]), frozenset())
                    else:
                        # An inline end tag closes what is open within its block only.
                        close_at = next((d for d in range(len(stack) - 1, 0, -1) if self.tag[stack[d]] == tag or self.tag[stack[d]] in _BLOCK), 0)
                        if close_at and self.tag[stack[close_at]] == tag:
                            while len(stack) > close_at:
                                pop()
                continue
            if tag in _RAW:
                end = _raw_end(tag).search(html, place)
                place = end.end() if end else len(html)
                continue
            if tag in _VOID:
                if tag == "hr":
                    close(*_P)
                    flush()
                elif tag == "br":
                    said(" ")
                continue
            if tag in _ENDS_P:
                close(*_P)
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if tag in _BLOCK:
                flush()
            parent = stack[-1]
            kind, aside, content = self._named(tag, m[3]) if m[3].strip(" /\n\t\r\f") else (tag, "", False)
            if tag in _ASIDE_TAGS or tag in _UNSEEN:
                aside = "strong"
            elif tag == "form" or (tag == "header" and not any(self.article[e] for e in stack)):
                aside = aside or "weak"
            element = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.kind.append(kind)
            self.aside.append(aside)
            self.article.append(tag in ("article", "main"))
            self.content.append(content)
            stack.append(element)
            opened[tag] = opened.get(tag, 0) + 1
            if tag not in _BLOCK:
                links += tag == "a"
                mute += tag in _UNSEEN or bool(aside)
        said(html[place:])
        flush()

    def main_blocks(self) -> tuple[list[Block], bool]:
        """Blocks that may be the article's, and whether they lie in an element that says so."""
        n = len(self.parent)
        real = [False] * n  # articles outside of strong asides
        strong = [False] * n
        for e in range(1, n):
            strong[e] = strong[self.parent[e]] or self.aside[e] == "strong"
            real[e] = self.article[e] and not strong[e]
        holds = [int(r) for r in real]
        for e in range(n - 1, 0, -1):
            holds[self.parent[e]] += holds[e]
        gone = list(strong)
        for e in range(1, n):
            gone[e] = gone[e] or gone[self.parent[e]] or (self.aside[e] == "weak" and not (holds[0] and holds[e] == holds[0]))
        left = [b for b in self.blocks if not gone[b.element]]
        inside = [False] * n
        for e in range(1, n):
            inside[e] = inside[self.parent[e]] or (real[e] and not gone[e])
        if any(inside):
            return [b for b in left if inside[b.element]], True
        if not any(self.content):
            return left, False
        size = [0] * n
        for b in left:
            size[b.element] += len(b.text)
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
        best = max((e for e in range(1, n) if self.content[e] and not gone[e]), key=lambda e: size[e], default=0)
        if not best or not size[best]:
            return left, False
        for e in range(1, n):
            inside[e] = inside[self.parent[e]] or e == best
        return [b for b in left if inside[b.element]], True

    def skeleton(self) -> tuple[Tree, list[int]]:
        """The tree of block-level elements with like neighbours joined, and each element's node in it, by preorder."""
        n = len(self.parent)
        node, level = [0] * n, [0] * n
        below: list[list[int]] = [[]]  # children of each node, in order
        kinds = [self.kind[0]]
        for e in range(1, n):
            at = node[self.parent[e]]
            depth = level[self.parent[e]]
            if self.tag[e] in _BLOCK and depth < DEPTH:
                depth += 1
                if below[at] and kinds[below[at][-1]] == self.kind[e]:
                    at = below[at][-1]
                else:
                    kinds.append(self.kind[e])
                    below.append([])
                    below[at].append(len(kinds) - 1)
                    at = len(kinds) - 1
            node[e], level[e] = at, depth
        order: list[int] = []

        def grown(i: int) -> Tree:
            order.append(i)
            return [kinds[i], 1, [grown(c) for c in below[i]]]

        tree = grown(0)
        number = {i: k for k, i in enumerate(order)}
        return tree, [number[i] for i in node]


@lru_cache(maxsize=32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


#: A tree is a list of its root's kind, the number of pages that have the root, and the trees below.
Tree = list


def _matched(left: list[Tree], right: list[Tree]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two ordered lists of trees: how many nodes map to each other, and which trees of the lists do.

    Trees that are alike at both starts or both ends map to each other in some largest mapping, so they need no table.
    """
    start = 0
    while start < min(len(left), len(right)) and _alike(left[start], right[start]):
        start += 1
    stop = 0
    while stop < min(len(left), len(right)) - start and _alike(left[-1 - stop], right[-1 - stop]):
        stop += 1
    pairs = [(i, i) for i in range(start)]
    a, b = left[start : len(left) - stop], right[start : len(right) - stop]
    if len(a) * len(b) > PAIRS:
        runs = SequenceMatcher(None, [t[0] for t in a], [t[0] for t in b], autojunk=False).get_matching_blocks()
        pairs += [(start + r.a + k, start + r.b + k) for r in runs for k in range(r.size)]
    elif a and b:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                joined = best[i - 1][j - 1] + _size_matched(x, y) if x[0] == y[0] else 0
                best[i][j] = max(best[i - 1][j], best[i][j - 1], joined)
        i, j, found = len(a), len(b), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((start + i, start + j))
        pairs += found[::-1]
    pairs += [(len(left) - k, len(right) - k) for k in range(stop, 0, -1)]
    return sum(_size_matched(left[i], right[j]) for i, j in pairs), pairs


def _alike(a: Tree, b: Tree) -> bool:
    return a[0] == b[0] and len(a[2]) == len(b[2]) and all(map(_alike, a[2], b[2]))


def _size_matched(a: Tree, b: Tree) -> int:
    return 1 + _matched(a[2], b[2])[0] if a[2] and b[2] else 1


def merged(a: Tree, b: Tree) -> Tree:
    """Both trees in one: matched nodes once, with the pages of both; others where they stand."""
    out, i, j = [], 0, 0
    for x, y in [*_matched(a[2], b[2])[1], (len(a[2]), len(b[2]))]:
        out += a[2][i:x] + b[2][j:y]
        if x < len(a[2]):
            out.append(merged(a[2][x], b[2][y]))
        i, j = x + 1, y + 1
    return [a[0], a[1] + b[1], out]


def _weighted(tree: Tree, pages: int) -> Tree:
    return [tree[0], tree[1] * pages, [_weighted(c, pages) for c in tree[2]]]


def _pruned(tree: Tree, least: float) -> Tree:
    return [tree[0], tree[1], [_pruned(c, least) for c in tree[2] if c[1] >= least]]


def slots(wrapper: Tree, skeleton: Tree) -> list[int]:
    """Each skeleton node's slot: the preorder number of the wrapper's node that it maps to, or -1."""
    sizes: dict[int, int] = {}

    def measure(t: Tree) -> int:
        sizes[id(t)] = 1 + sum(measure(c) for c in t[2])
        return sizes[id(t)]

    measure(wrapper)
    out: list[int] = []

    def walk(w: Tree | None, s: Tree, number: int) -> None:
        out.append(number)
        partner: dict[int, tuple[Tree, int]] = {}
        if w is not None:
            first, at = number + 1, 0
            for i, j in _matched(w[2], s[2])[1]:
                while at < i:
                    first, at = first + sizes[id(w[2][at])], at + 1
                partner[j] = (w[2][i], first)
        for j, child in enumerate(s[2]):
            walk(*((partner[j][0], child, partner[j][1]) if j in partner else (None, child, -1)))

    walk(wrapper, skeleton, 0)
    return out


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARSED = "host string, body long, skeleton string, nodes array<int>, texts array<long>"


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, digest of the main text, skeleton, and nodes and digests of the main blocks of every page."""
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    for whole in batches:
        for batch in byte_parts(whole, 1):
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                tree, node = page.skeleton()
                blocks = page.main_blocks()[0]
                rows.append((host, _digest("\n".join(b.text for b in blocks)), json.dumps(tree), [node[b.element] for b in blocks], [_digest(b.text) for b in blocks]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "body", "skeleton", "nodes", "texts"])
    give_back()


def _merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    """The group's trees in one, the most frequent first; nodes of few pages left out."""
    rows = rows.sort_values(["pages", "tree"], ascending=[False, True])
    whole = None
    for tree in map(json.loads, rows["tree"]):
        whole = tree if whole is None else merged(whole, tree)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "tree": [json.dumps(_pruned(whole, SPARSE * whole[1]))], "pages": [int(rows["pages"].sum())]})


def wrappers(parsed: DataFrame) -> DataFrame:
    """host, tree: one wrapper per host, merged from all its different skeletons."""
    trees = parsed.groupBy("host", "skeleton").agg(F.count("*").alias("pages"))
    weigh = F.udf(lambda tree, pages: json.dumps(_weighted(json.loads(tree), pages)), "string")
    trees = durable(trees.select("host", weigh("skeleton", "pages").alias("tree"), "pages"), "skeletons")
    while True:
        counts = trees.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 1
        if most == 1:
            return trees.select("host", "tree")
        # A place within the host says the group, so that each has GROUP trees at most; places go by the tree's digest, in bounded ranges of it.
        ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / (GROUP // 2)))
        dealt = trees.join(counts, "host").select("host", "tree", "pages", F.pmod(F.xxhash64("tree"), ranges).alias("bucket"))
        place = F.row_number().over(Window.partitionBy("host", "bucket").orderBy("tree"))
        grouped = dealt.select("host", "tree", "pages", "bucket", F.floor((place - 1) / GROUP).alias("part"))
        trees = durable(grouped.groupBy("host", "bucket", "part").applyInPandas(_merge_group, "host string, tree string, pages long"), "skeletons")


def _joined_by_host(rows: DataFrame, host: str, known: DataFrame) -> DataFrame:
    """rows with the columns of known (host and others), of which a broadcast is made where its size is checked."""
    size = known.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    right = known.withColumnRenamed("host", fresh(rows.columns, "_known_host"))
    right = F.broadcast(right) if size <= BROADCAST_BYTES else right
    return rows.join(right, rows[f"`{host}`"] == right[right.columns[known.columns.index("host")]], "left").drop(right.columns[known.columns.index("host")])


@lru_cache(maxsize=4096)
def _slots_of(wrapper: str, skeleton: str) -> list[int]:
    return slots(json.loads(wrapper), json.loads(skeleton))


def _slotted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """host, slot, text, body for every main block that has a slot."""
    for rows in batches:
        out = []
        for host, body, skeleton, nodes, texts, tree in zip(*(rows[c] for c in ("host", "body", "skeleton", "nodes", "texts", "tree")), strict=True):
            slot = _slots_of(tree, skeleton)
            out += {(host, slot[n], t, body) for n, t in zip(nodes, texts, strict=True) if slot[n] >= 0}
        yield pd.DataFrame(out, columns=["host", "slot", "text", "body"])
    _slots_of.cache_clear()


def templates(parsed: DataFrame) -> DataFrame:
    """host, tree, template: the wrapper of each host and the (slot, digest of the text) that are the same on most of its pages."""
    known = durable(wrappers(parsed), "wrappers")
    placed = _joined_by_host(parsed, "host", known).mapInPandas(_slotted, "host string, slot int, text long, body long")
    held = placed.distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n"))
    pages = parsed.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    constant = held.join(pages.where(F.col("n_pages") >= LEAST_PAGES), "host").where(F.col("n") >= TEMPLATE * F.col("n_pages"))
    each = constant.groupBy("host").agg(F.collect_set(F.concat_ws(":", "slot", "text")).alias("template"))
    return durable(known.join(each, "host", "left"), "templates")


def main_text(html: str, tree: str | None = None, template: frozenset[str] = frozenset()) -> str:
    """The article's blocks, one a line, without what the host's wrapper knows as template."""
    page = Page(html)
    blocks, named = page.main_blocks()
    if tree is not None and template:
        skeleton, node = page.skeleton()
        slot = _slots_of(tree, json.dumps(skeleton))
        varying = [b for b in blocks if f"{slot[node[b.element]]}:{_digest(b.text)}" not in template]
        if not named or 2 * sum(len(b.text) for b in varying) >= sum(len(b.text) for b in blocks):
            blocks = varying
    if not named:
        blocks = [b for b in blocks if 2 * b.linked < len("".join(b.text.split())) and not b.text.startswith(("\N{COPYRIGHT SIGN}", "Copyright "))]
    return "\n".join(b.text for b in blocks)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text in text_col (one of that name in any case is replaced); other columns stay as they are."""
    host = fresh(pages.columns, "_host")
    hosted = pages.withColumn(host, _host(F.col(f"`{url_col}`")))
    source = hosted.select(F.col(f"`{host}`").alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    known = templates(durable(source.mapInArrow(_parse, _PARSED), "parsed"))
    tree, template = fresh([*hosted.columns], "_tree"), fresh([*hosted.columns], "_template")
    joined = _joined_by_host(hosted, host, known.select("host", F.when(F.col("template").isNotNull(), F.col("tree")).alias(tree), F.col("template").alias(template)))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, trees, found in batches:
            yield pd.Series([main_text(h or "", t, frozenset(() if f is None else f)) for h, t, f in zip(htmls, trees, found, strict=True)], dtype=object)
        _slots_of.cache_clear()
        give_back()

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() != text_col.lower()]
    return joined.select(*kept, text(F.col(f"`{html_col}`").cast("string"), F.col(tree), F.col(template)).alias(text_col))
