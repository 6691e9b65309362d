"""Main text of web pages by wrapper induction.

Pages become trees of their block elements. Each page's tree is matched with that of a reference page of its host and
layout by simple tree matching, so that a node of the reference stands for the same place in all pages. A place that holds the
same text in nearly all pages of a host is template; places whose text varies hold content. Elements that name what
they are (menus, footers, forms, adverts, comments and so on) are left out, and an article element, where there is
one, bounds the content.

Matching happens page by page against one reference, so a host of any size is spread over all tasks; the counts per
place are aggregates.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from knotwork.llm.common import map_texts, stored

#: A place is template if one text fills it in this share of a host's pages, and the host has that many pages.
SHARE, PAGES = 0.8, 4
#: The same for places in an article, which hold content unless they are constant beyond doubt.
SURE_SHARE, SURE_PAGES = 0.95, 10
#: Bytes of reference trees and templates up to which they are broadcast; beyond that they are joined by host.
SMALL = 32 << 20
#: Pages of a host from which those of one layout have a template of their own.
LAYOUT = 8
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Element names of HTML by what they do.
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LANDMARKS = r"<(nav|header|main|article|aside|footer|section|table|form)\b"
BLOCKS = frozenset(
    "html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main nav header "
    "footer aside form fieldset figure figcaption blockquote pre address details summary dialog menu hgroup search center".split()
)
DROPPED = frozenset("head nav footer aside form fieldset dialog menu search".split())
CLOSES_P = BLOCKS - {"html", "head", "body"}
#: Words in class, id or role that name what is not content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar side footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay subscribe "
    "newsletter signup login search share sharing social comment comments reply replies respond discussion disqus related recommended "
    "recommendations pagination pager widget complementary contentinfo skip alert".split()
)


class Tree:
    """Nodes in page order: tag, parent, whether under an article, whether left out, own text pieces."""

    def __init__(self):
        self.tag, self.parent, self.inside, self.out, self.text = ["#"], [-1], [False], [False], [[]]

    def add(self, tag: str, parent: int, inside: bool, out: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.inside.append(inside)
        self.out.append(out)
        self.text.append([])
        return len(self.tag) - 1


def _marked(attributes: str) -> bool:
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    return any(w in MARKS for names in _NAMES.findall(attributes) for w in re.split(r"[^a-z0-9]+", names.lower()))


def parse(source: str) -> Tree:
    """The tree of block elements; inline elements are part of the text around them."""
    tree, at, here, low = Tree(), 0, 0, None

    def say(piece: str) -> None:
        last = len(tree.tag) - 1
        if here != last and not (tree.tag[last] == "#" and tree.parent[last] == here):
            if not piece.strip():
                return
            last = tree.add("#", here, tree.inside[here], tree.out[here])  # text after a child is a block of its own
        if piece:
            tree.text[last].append(piece)

    match = _PIECE.search(source)
    while match:
        say(source[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag:
            tag = tag.lower()
            if match[1]:
                if tag in BLOCKS:
                    up = here
                    while up > 0 and tree.tag[up] != tag:
                        up = tree.parent[up]
                    if up > 0:
                        here = tree.parent[up]
            elif tag in RAW:
                if not match[3].rstrip().endswith("/"):
                    low = low if low is not None else source.lower()
                    end = low.find("</" + tag, at)
                    end = len(source) if end < 0 else end
                    close = source.find(">", end)
                    at = len(source) if close < 0 else close + 1
                say(" ")
            elif tag in BLOCKS:
                here = _open(tree, here, tag, match[3])
            elif tag in VOID:
                if tag in ("br", "hr", "wbr"):
                    say(" " if tag != "wbr" else "")
            elif _marked(match[3]) and tag not in ("a", "b", "i", "em", "strong", "span"):
                here = _open(tree, here, "div", match[3])
        match = _PIECE.search(source, at)
    say(source[at:])
    return tree


def _open(tree: Tree, here: int, tag: str, attributes: str) -> int:
    if tag in CLOSES_P:
        here = _close(tree, here, {"p"}, {"article", "section", "div", "td", "body", "li", "blockquote"})
        if tag == "li":
            here = _close(tree, here, {"li"}, {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            here = _close(tree, here, {"dt", "dd"}, {"dl"})
        elif tag in ("td", "th"):
            here = _close(tree, here, {"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            here = _close(tree, here, {"tr"}, {"table", "tbody", "thead", "tfoot"})
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            here = _close(tree, here, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"article", "section", "div", "header", "body"})
    inside = tree.inside[here] or tag in ("article", "main")
    if tag in ("article", "main") and not inside_of(tree, here):
        return tree.add(tag, here, True, False)
    out = tree.out[here] or tag in DROPPED or (tag == "header" and not inside) or (tag not in ("html", "body", "article", "main") and _marked(attributes))
    return tree.add(tag, here, inside, out)


def inside_of(tree: Tree, here: int) -> bool:
    """Whether an article, or an element that drops what it holds by its tag, is open."""
    while here > 0:
        if tree.tag[here] in DROPPED or tree.tag[here] in ("article", "main"):
            return True
        here = tree.parent[here]
    return False


def _close(tree: Tree, here: int, tags: set, bounds: set) -> int:
    up = here
    while up > 0 and tree.tag[up] not in bounds:
        if tree.tag[up] in tags:
            return tree.parent[up]
        up = tree.parent[up]
    return here


def plain(pieces: list[str]) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()


def skeleton(tree: Tree) -> str:
    """Tags and parents of a tree as one string."""
    return " ".join(f"{t}:{p}" for t, p in zip(tree.tag, tree.parent))


@lru_cache(maxsize=64)
def _reference(text: str) -> tuple[tuple, tuple]:
    nodes = [x.split(":") for x in text.split(" ")]
    tags = tuple(n[0] for n in nodes)
    return tags, _children([int(n[1]) for n in nodes])


def _children(parents: list[int]) -> tuple:
    lists: list[list[int]] = [[] for _ in parents]
    for node, parent in enumerate(parents):
        if parent >= 0:
            lists[parent].append(node)
    return tuple(map(tuple, lists))


class _Shapes:
    """Numbers for subtrees of equal shape, in several trees; a child's number is less than its parent's."""

    def __init__(self):
        self.number: dict = {}
        self.tag: list[str] = []
        self.kids: list[tuple] = []
        self.size: list[int] = []

    def of(self, tags, kids) -> list[int]:
        out = [0] * len(tags)
        for node in range(len(tags) - 1, -1, -1):
            inner = tuple([out[k] for k in kids[node]])
            key = (tags[node], inner)
            found = self.number.get(key)
            if found is None:
                found = self.number[key] = len(self.tag)
                self.tag.append(tags[node])
                self.kids.append(inner)
                self.size.append(1 + sum(self.size[k] for k in inner))
            out[node] = found
        return out


def match(tags_a, kids_a, tags_b, kids_b) -> dict[int, int]:
    """Simple tree matching: nodes of a with their partners in b, for the greatest number of pairs.

    Pairs have equal tags (the roots need not), paired parents, and keep the order of siblings. Subtrees of equal shape
    are one, and pair off whole; where two child lists begin or end with equal shapes these pair off first, which loses
    nothing. Pairs of shapes are worked off from a list, so trees of any depth do, and long lists are aligned row by row.
    """
    shapes = _Shapes()
    shape_a, shape_b = shapes.of(tags_a, kids_a), shapes.of(tags_b, kids_b)
    memo: dict = {}

    def simple(x: int, y: int):
        """Weight of a pair of shapes that needs no alignment, else None."""
        if shapes.tag[x] != shapes.tag[y]:
            return 0
        if x == y:
            return shapes.size[x]
        return 1 if not shapes.kids[x] or not shapes.kids[y] else None

    def weight(x: int, y: int) -> int:
        found = simple(x, y)
        return memo[x, y][0] if found is None else found

    def middle(x: int, y: int):
        """What is left of two child lists between equal shapes at either end."""
        xs, ys = shapes.kids[x], shapes.kids[y]
        lo, hx, hy = 0, len(xs), len(ys)
        while lo < hx and lo < hy and xs[lo] == ys[lo]:
            lo += 1
        while hx > lo and hy > lo and xs[hx - 1] == ys[hy - 1]:
            hx, hy = hx - 1, hy - 1
        return lo, hx, hy

    root = (shape_a[0], shape_b[0])
    needed, stack = {root}, [root]
    while stack:
        x, y = stack.pop()
        lo, hx, hy = middle(x, y)
        for c in set(shapes.kids[x][lo:hx]):
            for d in set(shapes.kids[y][lo:hy]):
                if (c, d) not in needed and simple(c, d) is None:
                    needed.add((c, d))
                    stack.append((c, d))
    for x, y in sorted(needed):
        xs, ys = shapes.kids[x], shapes.kids[y]
        lo, hx, hy = middle(x, y)
        pairs = [(i, i) for i in range(lo)] + [(hx + i, hy + i) for i in range(len(xs) - hx)]
        total = sum(shapes.size[xs[i]] for i, _ in pairs)
        inner, found = _aligned(xs[lo:hx], ys[lo:hy], weight)
        memo[x, y] = 1 + total + inner, pairs + [(lo + i, lo + j) for i, j in found]
    found, stack = {}, [(0, 0)]
    while stack:
        a, b = stack.pop()
        found[a] = b
        key = (shape_a[a], shape_b[b])
        if key in memo:
            stack.extend((kids_a[a][i], kids_b[b][j]) for i, j in memo[key][1])
        elif key[0] == key[1]:
            stack.extend(zip(kids_a[a], kids_b[b]))
    return found


def _aligned(xs: tuple, ys: tuple, weight) -> tuple[int, list]:
    """(greatest total, pairs of places) of an alignment in order. Of a long table only the ways are kept, as bits."""
    if not xs or not ys:
        return 0, []
    names, at = np.unique(np.array(ys), return_inverse=True)
    rows: dict = {}
    last, ups, lefts = np.zeros(len(ys) + 1, np.int64), [], []
    for x in xs:
        if x not in rows:
            rows[x] = np.array([weight(x, int(y)) for y in names], np.int64)[at]
        row = np.zeros(len(ys) + 1, np.int64)
        np.maximum.accumulate(np.maximum(last[1:], last[:-1] + rows[x]), out=row[1:])
        ups.append(np.packbits(row[1:] == last[1:]))
        lefts.append(np.packbits(row[1:] == row[:-1]))
        last = row
    pairs, i, j = [], len(xs) - 1, len(ys) - 1
    while i >= 0 and j >= 0:
        if ups[i][j >> 3] >> (7 - (j & 7)) & 1:
            i -= 1
        elif lefts[i][j >> 3] >> (7 - (j & 7)) & 1:
            j -= 1
        else:
            pairs.append((i, j))
            i, j = i - 1, j - 1
    return int(last[-1]), pairs


def host(url: str = "url"):
    """The host of a URL in lower case; one empty host for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _blocks(source: str, reference: str) -> list[dict]:
    """Blocks of text in page order with the reference's node (-1: none), a hash of the text, and where they stand."""
    tree = parse(source)
    tags, kids = _reference(reference)
    pairs = match(tree.tag, _children(tree.parent), tags, kids)
    out = []
    for node, pieces in enumerate(tree.text):
        if pieces and (text := plain(pieces)):
            out.append({
                "node": pairs.get(node, -1), "hash": xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1,
                "inside": tree.inside[node], "out": tree.out[node], "text": text,
            })
    return out


def layouts(rows: DataFrame) -> DataFrame:
    """(_host, _layout, _group, _own): the layouts of each host and the template that their pages take part in.

    A layout is the set of landmark elements a page has. Layouts of many pages have a template of their own; pages of
    rare layouts and empty ones are read by that of the host's most frequent layout, but have no say in it.
    """
    counted = rows.groupBy("_host", "_layout").agg(F.count("*").alias("n"))
    main = counted.filter("_layout <> ''").groupBy("_host").agg(F.max_by("_layout", F.struct("n", "_layout")).alias("_main"))
    own = (F.col("_layout") != "") & ((F.col("n") >= LAYOUT) | (F.col("_layout") == F.col("_main")))
    named = counted.join(main, "_host", "left").withColumn("_own", F.coalesce(own, F.lit(False)))
    return named.select("_host", "_layout", F.when(F.col("_own"), F.col("_layout")).otherwise(F.coalesce("_main", F.lit(""))).alias("_group"), "_own")


def _near(df: DataFrame, size: int) -> DataFrame:
    """``df`` to be broadcast if its measured size allows it."""
    return F.broadcast(df) if size <= SMALL else df


def extract(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (page_id, url) and the main text of every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. Shares are of the pages of one layout. A host with few pages has no template; names and the article element
    decide there. Blocks in an article are template only where their place is constant in nearly all of many pages.
    """
    carry = carry or ["page_id", "url"]
    marks = F.regexp_extract_all(F.lower("html"), F.lit(LANDMARKS))
    layout = F.when(F.length(F.trim("html")) > 0, F.concat(F.lit("+"), F.array_join(F.array_sort(F.array_distinct(marks)), "+"))).otherwise(F.lit(""))
    rows = pages.select(*carry, host().alias("_host"), F.col("html"), F.xxhash64("page_id", "url").alias("_tie"), F.coalesce(layout, F.lit("")).alias("_layout"))
    known = stored(layouts(rows))
    size = known.agg(F.coalesce(F.sum(F.length("_host") + 2 * F.length("_layout") + 60), F.lit(0))).first()[0]
    rows = rows.join(_near(known, size), ["_host", "_layout"]).withColumn("_host", F.concat("_host", F.lit(" "), "_group"))
    rows = rows.select(*carry, "_host", "_own", "html", "_tie")
    first = rows.filter("_own").groupBy("_host").agg(F.min_by("html", F.struct("_tie", F.length("html"))).alias("html"))
    shapes = map_texts(first, ["_host"], lambda texts: {"shape": [skeleton(parse(t or "")) for t in texts]}, "shape string", "html")
    shapes = stored(shapes)
    size = shapes.agg(F.coalesce(F.sum(F.length("shape") + 100), F.lit(0))).first()[0]
    carry, given = [*carry, "_own"], carry
    paired = rows.join(_near(shapes, size), "_host", "left").select(*carry, "_host", "html", "shape")
    kind = "blocks array<struct<node: int, hash: bigint, inside: boolean, out: boolean, text: string>>"
    out = StructType([*paired.schema[: len(carry) + 1], *paired.sparkSession.createDataFrame([], kind).schema])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType(out[len(carry) + 1 :])).field("blocks").type

    def align(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [_blocks(h or "", s or "#:-1") for h, s in zip(part.column("html").to_pylist(), part.column("shape").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry) + 1], pa.array(found, arrow)], names=[*carry, "_host", "blocks"])

    aligned = stored(paired.mapInArrow(align, out))
    told = aligned.filter("_own")
    counts = told.groupBy("_host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= PAGES)
    places = told.select("_host", F.inline("blocks")).filter("node >= 0").groupBy("_host", "node", "hash").agg(F.count("*").alias("n"))
    fixed = places.join(counts, "_host").filter(F.col("n") >= SHARE * F.col("pages"))
    place = F.struct("node", "hash")
    sure = (F.col("pages") >= SURE_PAGES) & (F.col("n") >= SURE_SHARE * F.col("pages"))
    template = stored(fixed.groupBy("_host").agg(F.collect_set(place).alias("fixed"), F.collect_set(F.when(sure, place)).alias("sure")))
    size = template.agg(F.coalesce(F.sum(F.size("fixed") * 32 + 100), F.lit(0))).first()[0]
    known = aligned.join(_near(template, size), "_host", "left")
    here = lambda b: F.struct(b["node"].alias("node"), b["hash"].alias("hash"))
    is_fixed = lambda b: F.coalesce(F.array_contains(F.when(b["inside"], F.col("sure")).otherwise(F.col("fixed")), here(b)), F.lit(False))
    bounded = F.exists("blocks", lambda b: b["inside"] & ~b["out"])
    good = F.filter("blocks", lambda b: ~b["out"] & ~is_fixed(b) & (b["inside"] | ~F.col("_bounded")))
    text = F.array_join(F.transform(good, lambda b: b["text"]), "\n\n")
    return known.withColumn("_bounded", bounded).select(*given, text.alias("text"))
