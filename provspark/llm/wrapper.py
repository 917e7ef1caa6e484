"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching: two trees with equal
roots match as their children do, and siblings are aligned by a table of the
weights of their subtrees' matches. A host's template, which only says what is
the same place on two pages, is grown from a bounded sample of its distinct
pages; every page is then matched with it, and all texts at each node are
counted over all distinct pages. What matches none of its nodes has its path
of elements as its place. A text that fills the same place on most pages is
constant and goes, at that place only (menus, notices and footers, whatever
they are called); other places are slots. Slots under elements that are boilerplate by nature (nav, footer, aside,
forms, scripts, adverts, comments, ...) vary too and are left out by element
and class; the slots of the main container, where the page marks one, else all
the rest, are the content, block by block in page order.

Defined results: null or empty html gives empty text; pages without a host form
a host of their own; repeated pages count once in a template and each give a
row; hosts with fewer than ``MIN_PAGES`` distinct pages have no template, so
that copies under two addresses keep their text; an empty table gives no rows;
further columns pass through ``extract``, a column ``text`` is replaced, and
names that begin with ``_`` and end in host, salt, template, nodes or texts are
reserved.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import written

#: Fewest distinct pages of a host, and the share of them, that make a text template; and pages that fit a template's nodes.
MIN_PAGES, SHARE, FIT_PAGES = 5, 0.8, 32
#: Characters of templates up to which their table is broadcast; beyond, pages meet it by host and salt.
BROADCAST_CHARS, SALTS = 16_000_000, 64
#: Hosts up to which their numbers of pages are broadcast.
FEW_HOSTS = 100_000
#: Levels down to which subtrees are matched to weigh siblings, and the largest table of weights.
DEPTH, CELLS = 4, 10_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
#: One attribute, name and value; a quoted value that does not end runs to the end of the tag.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))")
#: The kinds of elements that HTML defines.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
BOILERPLATE = {"nav", "footer", "aside", "button", "select", "head", "dialog", "menu", "object"}
#: A form is boilerplate, unless it holds one of these or half of the page's paragraphs.
HEART = {"article", "main", "h1"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
#: Words that name boilerplate, and words that only say where or what kind of box such a thing is.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus submenu sidebar side footer foot header masthead "
    "cookie cookies consent notice notices banner popup modal comment comments replies disqus respond share sharing social related newsletter subscribe signup login breadcrumb "
    "breadcrumbs pagination pager widget widgets toolbar skip".split()
)
BOXES = set(
    "site page global main top bottom left right primary secondary wrapper wrap container box bar block list area section unit slot link links item items inner outer "
    "button buttons text fixed sticky overlay form panel column col posts articles stories bottom".split()
)
#: Names of heads and feet of a page, which belong to the text inside an article.
EDGES = {"header", "masthead", "head", "banner"}
#: Elements that hold text itself: what they are called says nothing.
TEXTUAL = INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "figcaption", "blockquote", "pre"}
#: A region is a menu if at least this share of its characters, over all pages, is links.
LINKED = 0.8

#: Names of a text's own head.
HEADS = re.compile(r"(?:article|post|entry|story|content|page)[_-]?(?:header|head|title|heading)", re.I)


def named_junk(name: str, inside: bool) -> bool:
    """Whether one class name, or a whole id, says boilerplate: its words name it, and all others only its box; ``inside`` an article heads stay."""
    if HEADS.fullmatch(name):
        return False
    words = [w for w in re.split(r"[-_\d]+", name.lower()) if w]
    telling = [w for w in words if w in NAMES and not (inside and w in EDGES)]
    return bool(telling) and all(w in NAMES or w in BOXES for w in words)


class Element:
    __slots__ = ("tag", "sign", "junk", "children", "parent")

    def __init__(self, tag: str, sign: str, junk: bool, parent: Element | None):
        self.tag, self.sign, self.junk, self.parent = tag, sign, junk, parent
        self.children: list[Element | str] = []


def _open(tag: str, raw: str, parent: Element) -> Element:
    sign, junk = tag, tag in BOILERPLATE or (tag == "header" and not any(e.tag in ("article", "main") for e in _up(parent)))
    if raw:
        for m in ATTRIBUTE.finditer(raw):
            key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
            if key == "class":
                sign = f"{tag}.{value}"
            if key in ("class", "id"):
                # an id names one thing, often by its heading: only the bare word counts
                names = value.split() if key == "class" else [value.strip()] if value.strip().lower() in NAMES else []
                if names and tag not in TEXTUAL and tag not in ("body", "html", "article", "main"):
                    inside = any(e.tag in ("article", "main") for e in _up(parent))
                    junk |= any(named_junk(n, inside) for n in names)
            elif key == "role":
                junk |= value.lower() in ROLES
            elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
                junk = True
    return Element(tag, sign, junk, parent)


def _up(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def parse(page: str) -> Element:
    """The DOM tree; end tags that close nothing are skipped, open paragraphs, items and cells end where HTML ends them."""
    root = at = Element("", "", False, None)
    pos, low, forms = 0, None, []
    while m := TOKEN.search(page, pos):
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            scope = at
            while scope.parent is not None and scope.tag != tag:
                scope = scope.parent
            if scope.parent is not None:
                at = scope.parent
            continue
        if tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", pos)
            pos = len(page) if end < 0 else (low.find(">", end) + 1 or len(page))
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            closes, stops = ({tag, "td", "th", "dd", "dt"} & SIBLINGS.keys() if tag in ("td", "th", "dt", "dd") else {tag, "td", "th"} if tag == "tr" else {tag}, SIBLINGS[tag]) if tag in SIBLINGS else ({"p"}, CLOSES_P - {"p"} | SIBLINGS.keys())
            scope = at
            while scope.parent is not None and scope.tag not in closes and scope.tag not in stops:
                scope = scope.parent
            if scope.parent is not None and scope.tag in closes:
                at = scope.parent
        e = _open(tag, m[3] or m[6] or "", at)
        at.children.append(e)
        if tag == "form" and not e.junk:
            forms.append(e)
        if tag not in VOID:
            at = e
    if pos < len(page):
        at.children.append(page[pos:])
    if forms:
        half = _heart(root)[1] / 2
        for form in reversed(forms):
            heart, paragraphs = _heart(form)
            form.junk = not heart and not (paragraphs and paragraphs >= half)
    return root


def _heart(top: Element) -> tuple[bool, int]:
    """Whether there is a page's heart under ``top``, and how many characters its paragraphs have; boilerplate does not count."""
    heart, characters, todo = False, 0, [(top, False)]
    while todo:
        e, inside = todo.pop()
        heart, inside = heart or e.tag in HEART, inside or e.tag == "p"
        for c in e.children:
            if not isinstance(c, str):
                if not c.junk:
                    todo.append((c, inside))
            elif inside:
                characters += len(c.strip())
    return heart, characters


def text_of(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


class Block:
    """Text of one block: the inline run between two block boundaries of an element; ``linked`` of its characters are links'."""

    __slots__ = ("text", "owner", "main", "junk", "linked")

    def __init__(self, text: str, owner: Element, main: bool, junk: bool, linked: int):
        self.text, self.owner, self.main, self.junk, self.linked = text, owner, main, junk, linked


def blocks(root: Element) -> list[Block]:
    """All blocks in page order; those under boilerplate elements are marked."""
    out: list[Block] = []
    run: list[str] = []
    links: list[str] = []

    def flush(owner: Element, main: bool, junk: bool) -> None:
        if run and (text := text_of("".join(run))):
            out.append(Block(text, owner, main, junk, min(len(text), len(text_of("".join(links))))))
        run.clear()
        links.clear()

    # an explicit stack, since pages can nest deeper than Python recurses
    stack: list[tuple[Element, Iterator, Element, bool, bool]] = [(root, iter(root.children), root, False, False)]
    while stack:
        e, rest, owner, main, junk = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if e is owner:
                flush(owner, main, junk)
        elif isinstance(child, str):
            run.append(child)
            if any(x[0].tag == "a" for x in reversed(stack) if x[0].tag in INLINE):
                links.append(child)
        elif child.tag in INLINE or child.tag in VOID:
            if child.junk:
                continue
            if child.tag == "hr":
                flush(owner, main, junk)
            elif child.tag in VOID:
                run.append(" ")
            stack.append((child, iter(child.children), owner, main, junk))
        else:
            flush(owner, main, junk)
            stack.append((child, iter(child.children), child, main or child.tag in ("article", "main"), junk or child.junk))
    return out


class Spot:
    """A block-level element of a page, or a node of a template, for matching: sign, kids, and a hash and the size of the subtree."""

    __slots__ = ("sign", "kids", "shape", "size", "pages", "number")

    def __init__(self, sign: str):
        self.sign, self.kids, self.shape, self.size, self.pages, self.number = sign, [], 0, 1, 0, -1


def measure(top: Spot) -> Spot:
    """``top`` with shapes and sizes, from the leaves up."""
    order = [top]
    for s in order:
        order += s.kids
    for s in reversed(order):
        s.size = 1 + sum(k.size for k in s.kids)
        s.shape = hash((s.sign, *(k.shape for k in s.kids)))
    return top


def outline(root: Element) -> tuple[Spot, dict[Element, Spot]]:
    """The page's block-level elements; inline elements hand theirs up."""
    top = Spot(root.sign)
    spots, todo = {root: top}, [(root, top)]
    while todo:
        e, above = todo.pop()
        inner: list[tuple[Element, Spot]] = []
        queue = deque(c for c in e.children if not isinstance(c, str))
        while queue:
            c = queue.popleft()
            if c.tag in INLINE or c.tag in VOID:
                if c.junk:
                    continue
                queue.extendleft(x for x in reversed(c.children) if not isinstance(x, str))
                continue
            spots[c] = Spot(c.sign)
            above.kids.append(spots[c])
            inner.append((c, spots[c]))
        todo += inner
    return measure(top), spots


def weight(a: Spot, b: Spot, depth: int) -> int:
    """Size of the largest top-down match of two trees that keeps order (below ``depth`` levels only equal shapes count)."""
    if a.sign != b.sign:
        return 0
    if a.shape == b.shape:
        return a.size
    return 1 + (sum(w for _, _, w in aligned(a.kids, b.kids, depth - 1)) if depth and a.kids and b.kids else 0)


def aligned(a: list[Spot], b: list[Spot], depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """Simple tree matching of two lists of siblings: pairs (i, j, weight) of greatest total weight, in order.

    Equal subtrees at both ends match; the rest is a table of weights. Where
    that table would pass ``CELLS``, siblings are paired in order by equal
    shape first and by sign between those.
    """
    n = 0
    while n < min(len(a), len(b)) and a[n].shape == b[n].shape:
        n += 1
    e = 0
    while e < min(len(a), len(b)) - n and a[-1 - e].shape == b[-1 - e].shape:
        e += 1
    pairs = [(i, i, a[i].size) for i in range(n)]
    rows, columns = range(n, len(a) - e), range(n, len(b) - e)
    if len(rows) * len(columns) > CELLS:
        pairs += _in_order(a, b, rows, columns)
    elif rows and columns:
        each = [[weight(a[i], b[j], depth) for j in columns] for i in rows]
        best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
        for i in range(len(rows) - 1, -1, -1):
            for j in range(len(columns) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + each[i][j])
        i = j = 0
        while i < len(rows) and j < len(columns):
            if each[i][j] and best[i][j] == best[i + 1][j + 1] + each[i][j]:
                pairs.append((rows[i], columns[j], each[i][j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return pairs + [(len(a) - e + k, len(b) - e + k, a[len(a) - e + k].size) for k in range(e)]


def _in_order(a: list[Spot], b: list[Spot], rows: range, columns: range) -> list[tuple[int, int, int]]:
    """Pairs of siblings in one pass: each of ``b`` takes one of the next four of ``a``, of its shape or else of its sign."""
    by_shape: dict[int, list[int]] = {}
    by_sign: dict[str, list[int]] = {}
    for i in rows:
        by_shape.setdefault(a[i].shape, []).append(i)
        by_sign.setdefault(a[i].sign, []).append(i)
    pairs, at = [], rows.start
    for j in columns:
        for places in (by_shape.get(b[j].shape, []), by_sign.get(b[j].sign, [])):
            k = bisect_left(places, at)
            if k < len(places) and places[k] - at <= 3:
                pairs.append((places[k], j, 1))
                at = places[k] + 1
                break
    return pairs


def match(template: Spot, page: Spot, grow: bool = False) -> dict[int, Spot]:
    """id(page's spot) -> the template's node it matches, from the roots down; with ``grow`` unmatched spots join the template."""
    found, todo = {id(page): template}, [(template, page)]
    while todo:
        t, s = todo.pop()
        to = {j: t.kids[i] for i, j, _ in aligned(t.kids, s.kids)} if s.kids else {}
        if grow and len(to) < len(s.kids):
            place = {id(k): i for i, k in enumerate(t.kids)}
            last, added = -1, []
            for j, kid in enumerate(s.kids):
                if j in to:
                    last = place[id(to[j])]
                else:
                    to[j] = Spot(kid.sign)
                    added.append((last, to[j]))
            for last, new in reversed(added):
                t.kids.insert(last + 1, new)
        for j, node in to.items():
            found[id(s.kids[j])] = node
            todo.append((node, s.kids[j]))
    return found


def checksum(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 | zlib.adler32(raw) >> 1


#: In place of a text's checksum: any text.
ANY = -1


def host_of(url: Column) -> Column:
    """Host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def placed(root: Element, template: Spot) -> list[tuple[Block, int]]:
    """Each block with its place: the number of the template's node that holds it, or a number below 0 that stands for its path of elements."""
    page, spots = outline(root)
    to = match(template, page)
    paths: dict[Element, int] = {}

    def path(e: Element) -> int:
        new = []
        while e is not None and e not in paths:
            new.append(e)
            e = e.parent
        for x in reversed(new):
            paths[x] = checksum(f"{paths.get(x.parent, 0)} {x.sign}")
        return paths[new[0] if new else e]

    return [(b, node.number if (node := to.get(id(spots[b.owner]))) is not None else ~path(b.owner)) for b in blocks(root)]


def induced(pages: list[str]) -> str:
    """The template of distinct pages, as JSON: a node is [parent's number, sign], in page order; nodes of a single page are left out."""
    top = Spot("")
    for page in pages:
        for node in set(match(top, outline(parse(page))[0], True).values()):
            node.pages += 1
        measure(top)
    out, todo = [], [(top, -1)]
    while todo:
        node, parent = todo.pop()
        out.append((parent, node.sign))
        todo += [(k, len(out) - 1) for k in reversed(node.kids) if k.pages > 1]
    return json.dumps(out, separators=(",", ":"))


@lru_cache(maxsize=1024)
def loaded(template: str) -> Spot:
    """The nodes of a template."""
    nodes: list[Spot] = []
    for parent, sign in json.loads(template):
        node = Spot(sign)
        node.number = len(nodes)
        if parent >= 0:
            nodes[parent].kids.append(node)
        nodes.append(node)
    return measure(nodes[0])


def templates(pages: DataFrame) -> DataFrame:
    """(_host, _template) of hosts with at least ``MIN_PAGES`` distinct pages, from ``FIT_PAGES`` of them (by hash).

    The sample fixes the nodes alone; which texts are constant, at them and
    elsewhere, is counted on all pages (``constants``).
    """
    keyed = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("hash"), "html")
    chosen = keyed.select("host", "hash").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy("hash"))).where(F.col("rank") <= FIT_PAGES)
    busy = chosen.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    sample = keyed.join(chosen.join(busy, "host").select("host", "hash"), ["host", "hash"]).groupBy("host", "hash").agg(F.first("html").alias("html"))

    def induce(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_host": x["host"].iloc[:1], "_template": [induced(x.sort_values("hash")["html"].tolist())]})

    return sample.groupBy("host").applyInPandas(induce, "_host string, _template string")


def beside(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with the columns of ``hosts`` (_host, _template, ...), null where a host is not among them."""
    hosted = pages.withColumn("_page_host", host_of(F.col("url")))
    size = hosts.agg(F.sum(F.length("_template"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        return hosted.join(F.broadcast(hosts), hosted["_page_host"] == hosts["_host"], "left")
    # a busy host's pages are dealt over SALTS tasks
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hosted = hosted.withColumn("_page_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    return hosted.join(salted, (hosted["_page_host"] == salted["_host"]) & (hosted["_page_salt"] == salted["_salt"]), "left")


def constants(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(_host, _template, _nodes, _texts): the place and checksum of every constant text, counted on all distinct pages of the host.

    A place that is a menu, whatever its links say (``LINKED``), has the
    checksum ``ANY``; what a page marks as its main part is never one. A path
    outside the template's nodes is a menu only if most pages have it.
    """
    keyed = pages.where("html <> ''").select("url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("hash"))
    copies = keyed.groupBy("host", "hash").agg(F.count("*").alias("copies"))
    totals = written(copies.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES), "totals")
    totals = F.broadcast(totals) if totals.count() <= FEW_HOSTS else totals
    weighed = keyed.join(copies.where("copies > 1"), ["host", "hash"], "left").select("url", "html", F.coalesce("copies", F.lit(1)).alias("copies"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seen: Counter[tuple] = Counter()
            links: Counter[tuple] = Counter()
            for host, template, page, copies in zip(x["_host"], x["_template"], x["html"], x["copies"], strict=True):
                # what is boilerplate by nature goes anyway
                held = [(b, place) for b, place in placed(parse(page), loaded(template)) if not b.junk]
                seen.update({(host, place, checksum(b.text), copies) for b, place in held})
                seen.update({(host, place, ANY, copies) for _, place in held if place < 0})
                for b, place in held:
                    if not b.main:
                        # over 0: more links than a menu needs
                        links[host, place, ANY, copies] += b.linked - LINKED * len(b.text)
            rows = [(*k, float(n), 0.0) for k, n in seen.items()] + [(*k, 0.0, float(n)) for k, n in links.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["host", "node", "text", "copies", "n", "links"])

    matched = beside(weighed, hosts).where("_template IS NOT NULL").select("_host", "_template", "html", "copies")
    counted = matched.mapInPandas(count, "host string, node long, text long, copies long, n double, links double")
    # a page that occurs c times counts a c-th each time
    share = lambda c: F.sum(F.col(c) / F.col("copies"))
    often = counted.groupBy("host", "node", "text").agg((share("n") + 1e-6).alias("n"), share("links").alias("links"))
    # what no host's share can reach does not meet the hosts' totals
    often = often.where((F.col("n") >= SHARE * MIN_PAGES) | (F.col("links") > 0)).join(totals, "host")
    most, menu = F.col("n") >= SHARE * F.col("pages"), F.col("text") == ANY
    fixed = often.where((~menu & most) | (menu & (F.col("links") > 0) & (most | (F.col("node") >= 0)))).groupBy("host").agg(F.collect_list("node").alias("_nodes"), F.collect_list("text").alias("_texts"))
    return hosts.join(fixed, hosts["_host"] == fixed["host"]).drop("host")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the main text of each page in ``text``."""
    fixed = written(constants(pages, written(templates(pages), "templates")), "constants")

    @F.pandas_udf("string")
    def content(htmls: pd.Series, template: pd.Series, nodes: pd.Series, texts: pd.Series) -> pd.Series:
        def one(page: str | None, template: str | None, nodes: list[int] | None, texts: list[int] | None) -> str:
            if not page:
                return ""
            root = parse(page)
            if template is None:
                found = blocks(root)
            else:
                constant = set(zip(nodes, texts, strict=True))
                found = [b for b, place in placed(root, loaded(template)) if (place, checksum(b.text)) not in constant and (b.main or (place, ANY) not in constant)]
            found = [b for b in found if not b.junk]
            main = [b for b in found if b.main] or found
            return "\n".join(b.text for b in main)

        return pd.Series([one(*x) for x in zip(htmls, template, nodes, texts, strict=True)], dtype=object)

    hosted = beside(pages, fixed)
    return hosted.withColumn("text", content("html", "_template", "_nodes", "_texts")).select(*[c for c in pages.columns if c != "text"], "text")


def op10_query(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
