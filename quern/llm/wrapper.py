"""HTML extraction by wrapper induction over pages of one host.

Pages become trees of generalised nodes: a run of siblings with one tag and class is one node, so a
page of a thousand paragraphs is as small as one of three. In a page with more than MOST_NODES such
nodes all siblings with one tag and class are one node, and if that does not do, fewer levels are
aligned; no part of a page is left out. Every page of a host is aligned with the host's reference page
(of its pages with any tag one with the median number of tags) by simple tree matching. A node is template where most
different pages of the host agree on its text, and only on pages that have that very text; a node
whose text varies is a slot. The content root is the deepest node, article or main at the most, that
holds all of the varying text outside menus, notices and the like, or is or holds an article or main
with most of it and no heading or paragraph beside it; the main text is what lies in a page's counterpart of that root,
without template nodes and without what its role excludes. A page that no other of its host resembles
falls back on its own tags: article, then main, then the body. A root that template would leave no
text but headings, or an article or main that would lose most of its text, is kept whole.

Votes are sums by host and node, so a host with a third of all pages needs no task of its own. Pages
whose main text by their own tags is equal but for headings vote once, so that an article that stands
on most pages of a host, under whatever menus, is no template. Alignment looks DEPTH levels deep; deeper nodes count to their ancestor there.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stage

DEPTH, MOST_NODES = 24, 400
#: A page is aligned so many levels deep at least, however many nodes that makes.
LEAST_DEPTH = 6
#: A node is template if so many different pages hold it and more than half of them agree.
VOTES = 3
#: Bytes of reference pages that are sent to every task; more are joined by host.
SENT = 32 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html body".split())
DROPPED = frozenset("script style noscript template head title nav aside form footer button select textarea option input iframe object svg canvas audio video map dialog menu search".split())
ALIGNED = BLOCKS | DROPPED
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Beside an article, what is no part of it by its tags but reads as its title or lead.
BESIDE = HEADINGS | frozenset("header p".split())
WORD = re.compile(r"[a-z]+")
OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

#: Words that only place or shape what the other words of a class name, as in site-footer or ad-box.
HELPING = frozenset("area bar block box button buttons container form inner item items link links list main page post posts section site slot unit wrap wrapper x".split())
#: Words of a class that names a state or an absence, as in no-sidebar.
STATES = frozenset("has hidden hide is no non not show with without".split())

_P, _P_SCOPE = frozenset(("p",)), frozenset(("button", "td", "th", "caption", "object"))
#: Elements that end an open one of their kind, and what such a search does not leave.
_SIBLINGS = {t: (frozenset(own.split()), frozenset(stop.split())) for own, stop in (("li", "ul ol menu"), ("dd dt", "dl"), ("td th", "table"), ("tr", "table"), ("tbody thead tfoot", "table"), ("option", "select")) for t in own.split()}


class Node:
    """An element. `out`: BY_TAG or BY_NAME if it is no part of a main text, else 0."""

    __slots__ = ("tag", "kind", "out", "parts", "parent")

    def __init__(self, tag: str, kind: str, out: int, parent: Node | None):
        self.tag, self.kind, self.out, self.parts, self.parent = tag, kind, out, [], parent


BY_TAG, BY_NAME = 1, 2


@lru_cache(maxsize=4096)
def _names_out(token: str) -> bool:
    """Whether a class or id as a whole names what is no main text: all its words do, or help to."""
    words = set(WORD.findall(token.lower()))
    return bool(words & OUT) and words <= OUT | HELPING and not words & STATES


def _role(tag: str, attrs: dict[str, str | None], inside: bool) -> int:
    """BY_TAG if an element is no part of a main text by its tag or role, BY_NAME if by its class or id.

    Ids of headings are links to them, and so are those of sections within an article."""
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
        return BY_TAG
    if tag == "header" and not inside:
        return BY_TAG
    if tag in ("html", "body", "article", "main"):
        return 0
    names = (attrs.get("class") or "").split()
    if tag not in HEADINGS and not (tag == "section" and inside):
        names += (attrs.get("id") or "").split()
    return BY_NAME if any(map(_names_out, names)) else 0


class _Builder(HTMLParser):
    """Builds the tree. `open` counts the open elements by tag, so that no search climbs in vain."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", "#root", 0, None)
        self.open: Counter[str] = Counter()
        self.named: list[Node] = []  # out by name
        self.article = False  # whether an article lies in nothing that is out

    def updatepos(self, i, j):
        """Lines and columns, which the library's parser counts, are not asked for."""
        return j

    def _close(self, node: Node) -> None:
        """Closes the open elements up to node, and node itself."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def _up_to(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        for t in tags:
            if self.open[t]:
                break
        else:
            return
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self._close(node)
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if self.open["p"] and tag in CLOSES_P:
            self._up_to(_P, _P_SCOPE)
        if tag in _SIBLINGS:
            self._up_to(*_SIBLINGS[tag])
        elif tag in ("html", "body") and self.open[tag]:
            return
        inside = self.open["article"] > 0 or self.open["main"] > 0
        if attrs:
            got = dict(attrs)
            names = got.get("class")
            node = Node(tag, f"{tag}.{' '.join(sorted(names.split())) if names else ''}", _role(tag, got, inside), self.at)
        else:
            node = Node(tag, tag + ".", BY_TAG if tag in DROPPED or (tag == "header" and not inside) else 0, self.at)
        self.at.parts.append(node)
        if node.out == BY_NAME:
            self.named.append(node)
        elif tag == "article" and not self.article:
            self.article = not any(a.out for a in _above(node))
        if tag not in VOID:
            self.open[tag] += 1
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body") or not self.open[tag]:
            return
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self._close(node)
                return
            if node.tag in ("td", "th", "table", "article", "main") and tag not in BLOCKS:
                return  # a stray end tag of markup does not close what holds it
            node = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _above(node: Node):
    while (node := node.parent) is not None:
        yield node


def _held(node: Node) -> tuple[int, bool]:
    """Characters below a node outside headings and what is out, and whether an article, main or h1 is there."""
    chars, main, todo = 0, False, [node]
    while todo:
        x = todo.pop()
        for part in x.parts:
            if isinstance(part, str):
                chars += len(part.strip())
            elif not part.out:
                main = main or part.tag in ("article", "main", "h1")
                if part.tag not in HEADINGS:
                    todo.append(part)
    return chars, main


def _readmit(root: Node, named: list[Node]) -> None:
    """Takes back what is out by name but holds the page's article, or nearly all of its text.

    Inner elements are judged first; those with an article, main or h1 before the others, which must not
    outweigh a text that has one, as long comments do."""
    rest, other = _held(root)
    for must in (True, False):
        for node in reversed(named):
            own, main = _held(node) if node.out else (0, False)
            if own and (main and own >= rest if must else own > 4 * rest and not (other and rest)) and not any(a.out == BY_TAG for a in _above(node)):
                node.out = 0
                rest, other = _held(root)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    if builder.named and not builder.article:
        _readmit(builder.root, builder.named)
    return builder.root


def blocks(nodes: list[Node], template: set[int], without: frozenset[str] = frozenset(), known: dict[int, list[str]] | None = None) -> list[str]:
    """Texts of the blocks below some nodes, in page order, without what is out or template or of some tags.

    known: block elements whose texts are there already, for the same template and tags."""
    found, now = [], []
    known = known or {}

    def flush():
        if now:
            if text := " ".join("".join(now).split()):
                found.append(text)
            now.clear()

    for root in nodes:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif type(x) is str:
                now.append(x)
            elif id(x) in known and not x.out:
                flush()
                found.extend(known[id(x)])
            elif x is root or not (x.out or id(x) in template or x.tag in without):
                if x.tag in ("br", "hr"):
                    now.append(" ")
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(x.parts[::-1])
        flush()
    return found


class Shape:
    """A page as generalised nodes: kind, members (the siblings of the run), children, number in preorder.

    Siblings of one kind are one node if they follow each other, if their parents are one node, or if `merged`."""

    __slots__ = ("kind", "tag", "members", "children", "number", "size")

    def __init__(self, kind: str, members: list[Node], depth: int, merged: bool, count: list[int]):
        self.kind, self.tag, self.members, self.children = kind, members[0].tag, members, []
        self.number = count[0]
        count[0] += 1
        if depth:
            runs: list[tuple[str, list[Node]]] = []
            known: dict[str, tuple[str, list[Node]]] = {}
            last = None
            for m in members:
                for part in m.parts:
                    if isinstance(part, Node) and part.tag in ALIGNED:
                        if last is None or last[0] != part.kind:
                            last = known.get(part.kind) if merged or len(members) > 1 else None
                            if last is None:
                                last = known[part.kind] = part.kind, []
                                runs.append(last)
                        last[1].append(part)
            self.children = [Shape(kind, own, depth - 1, merged, count) for kind, own in runs]
        self.size = 1 + sum(c.size for c in self.children)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def shape(root: Node) -> Shape:
    """The finest shape that has at most MOST_NODES nodes, else the coarsest."""
    found = Shape("#root", [root], DEPTH, False, [0])
    depth = DEPTH
    while found.size > MOST_NODES and depth >= LEAST_DEPTH:
        found = Shape("#root", [root], depth, True, [0])
        depth //= 2
    return found


@lru_cache(maxsize=512)
def reference_shape(html: str) -> Shape:
    """Shape of a reference page; rows of one host are often near each other."""
    return shape(tree(html))


def matched(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Simple tree matching: the pairs of the largest order-preserving match of two trees with equal roots."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def weigh(x: Shape, y: Shape) -> tuple[int, list]:
        if x.kind != y.kind:
            return 0, []
        if (key := (x.number, y.number)) in memo:
            return memo[key]
        m, n = len(x.children), len(y.children)
        w = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            c, above, row = x.children[i], w[i], w[i + 1]
            for j in range(n):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                if c.kind == y.children[j].kind:
                    best = max(best, above[j] + weigh(c, y.children[j])[0])
                row[j + 1] = best
        pairs, i, j = [], m, n
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x.children[i], y.children[j]))
        memo[key] = w[m][n] + 1, pairs[::-1]
        return memo[key]

    weigh(a, b)
    found, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        found.append((x, y))
        todo.extend(weigh(x, y)[1])
    return found


def _text(s: Shape) -> str:
    return "\n".join(blocks([m for m in s.members if not m.out], set()))


def _nested_texts(shapes: list[Shape]) -> dict[int, str]:
    """_text of shapes of one page by number: inner ones first, whose blocks the outer ones take over."""
    known: dict[int, list[str]] = {}
    found = {}
    for s in sorted(shapes, key=lambda s: -s.number):
        own = []
        for m in s.members:
            if not m.out:
                own += (part := blocks([m], set(), known=known))
                if m.tag in BLOCKS:
                    known[id(m)] = part
        found[s.number] = "\n".join(own)
    return found


def _out(s: Shape) -> bool:
    return all(m.out for m in s.members)


def _hash(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def named(root: Node) -> list[Node]:
    """A page's main elements by its own tags: articles, else main, else the body."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    todo = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.out:
            continue
        if x.tag in found:
            found[x.tag].append(x)
            if x.tag == "article":
                continue
        todo.extend(reversed(x.parts))
    return found["article"] or found["main"] or found["body"] or [root]


def _substance(root: Node) -> str:
    """Main text by a page's own tags without headings; with them if there is nothing else."""
    own = named(root)
    return "\n".join(blocks(own, set(), HEADINGS) or blocks(own, set()))


def _votes(batches):
    """(host, hash of the page's substance, node of the reference, own text's hash, length outside excluded nodes)."""
    for batch in batches:
        rows = []
        for host, html, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = tree(html or "")
            page = _hash(_substance(root))
            pairs = [(x, y) for x, y in matched(reference_shape(ref or ""), shape(root)) if not _out(y)]
            own = _nested_texts([y for _, y in pairs])
            for x, y in pairs:
                text = own[y.number]
                rows.append((host, page, x.number, _hash(text), len(text)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "page", "node", "same", "chars"])


def _kept(own: list[Node], template: set[int], whole: list[str]) -> list[str]:
    """Blocks of a content root without template, unless that takes what the root is there for; whole: all its blocks."""
    if not template:
        return whole
    found = blocks(own, template)
    lost = len(found) < len(whole) and not blocks(own, template, HEADINGS)
    if all(m.tag in ("article", "main") for m in own):
        lost = lost or 2 * sum(map(len, found)) < sum(map(len, whole))
    return whole if lost else found


def content_of(html: str, ref: str | None, wrapper: list[dict] | None) -> list[str]:
    """Blocks of a page's main text, by its host's wrapper (node, votes, agree, same, agreed, chars) if there is one."""
    root = tree(html)
    own: list[Node] = []
    template: set[int] = set()
    if ref is not None and wrapper:
        votes = {w["node"]: w for w in wrapper}
        pairs = {x.number: (x, y) for x, y in matched(reference_shape(ref), shape(root))}
        constant = lambda n: n in votes and votes[n]["votes"] >= VOTES and 2 * votes[n]["agree"] > votes[n]["votes"]
        x = pairs[0][0]

        def varying(s: Shape) -> int:
            """Characters in other texts than the agreed one."""
            if s.number not in votes:
                return 0
            return votes[s.number]["chars"] - (votes[s.number]["agreed"] if constant(s.number) else 0)

        def goes_on(s: Shape, c: Shape) -> bool:
            """Whether a child of a node holds what its content is, so that nothing beside it belongs there."""
            beside = [b for b in s.children if b is not c and varying(b)]
            if any(b.tag in ("article", "main") for b in c.walk() if b.number in votes):
                return not any(b.tag in BESIDE for b in beside)
            # text of s outside its aligned children, but for the line ends between them, is in no child either
            loose = votes[s.number]["chars"] - sum(votes[b.number]["chars"] for b in s.children if b.number in votes)
            return not beside and loose <= votes[s.number]["votes"] * len(s.children)

        total, best = varying(x), 0
        while total and x.tag not in ("article", "main") and (below := [c for c in x.children if 5 * varying(c) > 4 * total and goes_on(x, c)]):
            x, total = below[0], varying(below[0])
            if x.tag in ("p", "ul", "ol", "table", "tbody", "blockquote", "pre"):
                break  # a single block type is inside the content, not its root
            best = x.number
        if best in pairs:
            own = [m for m in pairs[best][1].members if not m.out]
        for n, (_, y) in pairs.items():
            if constant(n) and not _out(y) and _hash(_text(y)) == votes[n]["same"]:
                template.update(id(m) for m in y.members)
    whole = [] if not own or any(m.tag in ("body", "html", "#root") for m in own) else blocks(own, set())
    if not whole:
        own = named(root)
        whole = blocks(own, set())
    return _kept(own, template, whole)


def _extract(batches):
    for batch in batches:
        ids, urls, pages, refs, wrappers = (c.to_pylist() for c in batch.columns)
        text = ["\n\n".join(content_of(h or "", r, w)) for h, r, w in zip(pages, refs, wrappers, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(text), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: str):
    """Lower-case host of a URL; '' if there is none or the URL is null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def references(pages: DataFrame) -> DataFrame:
    """host, ref: the html of a typical page of each host. Of the pages with any tag it has the median number of
    tags, and the smallest page_id among those."""
    tags = F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))
    own = pages.where("page_id is not null and html is not null").withColumn("tags", tags).where("tags > 0")
    counts = own.groupBy("host", "tags").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("page_id"))
    order = Window.partitionBy("host").orderBy("tags").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("host")))
    middle = stage(upto.where("2 * upto >= all").groupBy("host").agg(F.min(F.struct("tags", "page_id")).alias("m")).select("host", "m.*"), "middles")
    few = middle.count() <= SENT // 128
    return own.join(F.broadcast(middle) if few else middle, ["host", "tags", "page_id"]).groupBy("host").agg(F.min("html").alias("ref"))


def _sent(refs: DataFrame) -> DataFrame:
    """refs (with ref), sent to every task if all references together are small; else the join moves the pages."""
    size = refs.agg(F.sum(F.octet_length("ref"))).first()[0] or 0
    return F.broadcast(refs) if size <= SENT else refs


def wrappers(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """host, ref, wrapper: for each node of the reference, how many different pages hold it, how many agree and on what."""
    voted = pages.join(_sent(refs), "host").select("host", "html", "ref").mapInArrow(_votes, "host string, page binary, node int, same binary, chars long")
    once = voted.groupBy("host", "page", "node").agg(F.min(F.struct("same", "chars")).alias("one")).select("host", "node", "one.*")
    texts_ = once.groupBy("host", "node", "same").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    nodes = texts_.groupBy("host", "node").agg(F.sum("n").alias("votes"), F.max(F.struct("n", "same", "chars")).alias("most"), F.sum("chars").alias("chars"))
    node = F.struct("node", "votes", F.col("most.n").alias("agree"), F.col("most.same").alias("same"), F.col("most.chars").alias("agreed"), "chars")
    whole = nodes.groupBy("host").agg(F.collect_list(node).alias("wrapper"))  # as many as the reference's shape has
    return refs.join(whole, "host", "left")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty html gives ''. Pages without a host are judged by their own tags together with
    other such pages. Rows may repeat; a null page_id is never a reference. Other columns are not looked at.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of("url"))
    known = stage(wrappers(own, stage(references(own), "references")), "wrappers")
    full = own.join(_sent(known), "host", "left").select("page_id", "url", "html", "ref", "wrapper")
    return full.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
