"""HTML extraction by wrapper induction: same-host pages are aligned by simple tree matching.

Every page is parsed to a DOM tree.  Its block elements make a page tree, in which runs of siblings with
the same tag and class are one node, so a tree's size does not follow the page's length.  The trees of a
host are aligned by simple tree matching (Yang, 1991) and merged into the host's wrapper, whose nodes count
pages and keep the few commonest digests of their text (a mergeable heavy-hitter summary).  A node whose
text is the same on most pages is template; a varying slot is content.  Wrappers of a task's pages are
merged before the shuffle, so a host with any share of the pages sends one small row per task.

A page is then aligned with its host's wrapper.  Its scope is ``main``, else ``article``, else the body;
constant nodes go, but for the parts of an article that varies as a whole, and so do elements that are page
furniture by tag, class, id or role, and outside articles lists of links.  Single blocks are also told by exact counts: one whose text at most pages with its path of
labels have there, at any place among its siblings, is template.  Constant means: on three pages of different
articles at least and on half of the pages; pages that agree in title, heading and longest pieces of text are
one article, so copies do not make each other template.  On hosts with a wrapper the class words of furniture
that an article could use itself (notice, form, tags, legal ...) count outside articles only; on hosts of
fewer than three pages there is no wrapper, and all words count everywhere.

Null and empty html give an empty text; so does a page of furniture only.  Pages without a usable url form
one host of their own.  Unclosed tags, stray ends and markup inside scripts are handled as browsers do in
the common cases.  Repeated pages and ties change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import shared

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("head nav header footer aside form script style textarea title noscript iframe xmp noframes noembed button select option input template menu dialog svg canvas object embed audio video map label fieldset".split())
#: Words in class, id or role that tell page furniture.
_FURNITURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|adbox|adunit|banner\w*|promo\w*|sponsor\w*|sidebar\w*|side-bar|aside|rail|menu\w*|nav\w*|navigation|breadcrumbs?|header|page-header|site-header|masthead|topbar|footer|site-footer|footnotes-nav|cookies?\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|popup\w*|pop-up|modal\w*|overlay|paywall|newsletter\w*|subscribe\w*|subscription|signup|sign-up|share\w*|sharing|social\w*|related\w*|recommend\w*|read-more|more-stories|trending|popular|comments?\w*|commentlist|respond|replies|reply\w*|disqus\w*|discussion|feedback|reactions?|widgets?\w*|login|toolbar|pagination|pager|search\w*|skip-link|complementary|contentinfo|legal|disclaimer|copyright|tag-list|tags|form)(?:$|[\s_-])",
    re.I,
)
#: Of these, the ones that an article does not use for its own parts.
_ALWAYS_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|adbox|adunit|promo\w*|sponsor\w*|sidebar\w*|side-bar|aside|menu\w*|nav\w*|navigation|breadcrumbs?|masthead|topbar|site-header|footer|site-footer|cookies?\w*|consent|gdpr|popup\w*|pop-up|modal\w*|overlay|paywall|newsletter\w*|subscribe\w*|subscription|signup|sign-up|share\w*|sharing|social\w*|related\w*|recommend\w*|read-more|more-stories|comments?\w*|commentlist|respond|replies|reply\w*|disqus\w*|widgets?\w*|login|toolbar|pagination|pager|skip-link|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "names", "kids", "parent", "inside", "plain")

    def __init__(self, tag: str, names: str, parent: Node | None, plain: bool = False):
        self.tag, self.names, self.parent, self.kids = tag, names, parent, []
        #: Of a host without a wrapper: class words alone must do.
        self.plain: bool = plain or parent is not None and parent.plain
        #: Inside an article, where a header holds its title.
        self.inside: bool = tag == "article" or parent is not None and parent.inside

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def parse(source: str, plain: bool = False) -> Node:
    """A DOM tree; kids are nodes and strings."""
    root = top = Node("#root", "", None, plain)
    at, n = 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        if m is None:
            top.kids.append(source[at:])
            break
        if m.start() > at:
            top.kids.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                top.kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            walk = top
            while walk is not root and walk.tag != tag:
                if tag in INLINE and walk.tag not in INLINE:
                    walk = root  # a stray inline end closes no block
                    break
                walk = walk.parent
            if walk is not root:
                top = walk.parent
            continue
        if tag in _CLOSES_P:
            walk = top
            while walk is not root and (walk.tag in INLINE or walk.tag == "p"):
                if walk.tag == "p":
                    top = walk.parent
                    break
                walk = walk.parent
        if tag in _SELF:
            walk, stop = top, _SCOPE.get(tag, ())
            while walk is not root and walk.tag not in stop:
                if walk.tag in _SELF[tag]:
                    top = walk.parent
                walk = walk.parent
        found = " ".join(x[1] or x[2] or x[3] for x in _NAMES.findall(m[3])) if "=" in m[3] else ""
        if m[3] and _HIDDEN.search(m[3]):
            found += " hidden-element"
        node = Node(tag, " ".join(found.lower().split()), top)
        top.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else n
            node.kids.append(source[at:stop])
            at = (source.find(">", stop) + 1 or n) if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            top = node
    return root


_TITLES = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story|content)[_-]+(?:header|head|title|heading)(?:$|[\s_-])")


def is_furniture(node: Node) -> bool:
    if node.tag == "header" and node.inside or node.names and _TITLES.search(node.names):
        return False
    if node.tag in FURNITURE:
        return True
    if not node.names or node.tag in ("html", "body", "main", "article"):
        return False
    words = _ALWAYS_FURNITURE if node.inside and not node.plain else _FURNITURE_WORDS
    return "hidden-element" in node.names or bool(words.search(node.names))


def _pieces(node: Node, gone: set[int], out: list[str]) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(kid)
        elif id(kid) in gone or is_furniture(kid):
            out.append("" if kid.tag in INLINE else " ")
        elif kid.tag in INLINE:
            _pieces(kid, gone, out)
        else:
            out.append(" ")
            _pieces(kid, gone, out)
            out.append(" ")


def _joined(pieces: list[str]) -> str:
    text = "".join(pieces)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def text_of(node: Node, gone: set[int] = frozenset()) -> str:
    """The node's text: blocks joined by one space, without furniture and the nodes in ``gone``."""
    out: list[str] = []
    _pieces(node, gone, out)
    return _joined(out)


# ---- Page trees and wrappers: [label, pages, digests, kids, first digests, last digests, articles] ----

#: Digests of a node have [pages, articles]; articles are a set of marks, one of 63 bits for each article.
KEPT = 4
LABEL, PAGES, TEXTS, KIDS, FIRST, LAST, ARTICLES = range(7)


def article_mark(root: Node) -> int:
    """One bit for the page's article: by title, first heading and the three longest pieces of text."""
    title = heading = ""
    pieces: list[str] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "title" and not title:
            title = "".join(k for k in node.kids if isinstance(k, str))
        elif node.tag == "h1" and not heading:
            heading = text_of(node)
        if node.tag not in RAW:
            for k in node.kids:
                if not isinstance(k, str):
                    stack.append(k)
                elif len(pieces) < 3 or len(k) > len(pieces[-1]):
                    pieces = sorted([*pieces, k.strip()], key=lambda x: (-len(x), x))[:3]
    return 1 << xxh3_64_intdigest("\0".join((title.strip(), heading, *pieces)).encode(errors="replace")) % 63


def _blocks(node: Node) -> list[Node]:
    return [k for k in node.kids if isinstance(k, Node) and k.tag not in INLINE and k.tag not in VOID and not is_furniture(k)]


def _digest(nodes: list[Node]) -> int | None:
    text = " ".join(text_of(x) for x in nodes).strip()
    return xxh3_64_intdigest(text.encode(errors="replace")) if text else None


def page_tree(nodes: list[Node], mark: int, at: dict[int, list[Node]] | None = None) -> list:
    """The tree of a run of equal siblings; ``at`` gets the DOM nodes of every tree node, by its identity."""
    kids: list[list] = []
    runs: list[list[Node]] = []
    for node in nodes:
        own: list[list[Node]] = []
        for k in _blocks(node):
            if own and own[-1][0].label == k.label:
                own[-1].append(k)
            else:
                own.append([k])
        if len(nodes) == 1:
            runs = own
        else:  # a run's members share one list of kinds of kids
            for r in own:
                same = next((x for x in runs if x[0].label == r[0].label), None)
                if same is None:
                    runs.append(r)
                else:
                    same.extend(r)
    for r in runs:
        kids.append(page_tree(r, mark, at))
    d = _digest(nodes)
    ends = [{f"{e}": [1, mark]} if len(nodes) > 1 and (e := _digest([x])) is not None else {} for x in (nodes[0], nodes[-1])]
    out = [nodes[0].label, 1, {str(d): [1, mark]} if d is not None else {}, kids, *ends, mark]
    if at is not None:
        at[id(out)] = nodes
    return out


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the largest order-keeping match, and the matched kids."""
    if a[LABEL] != b[LABEL]:
        return 0, []
    x, y = a[KIDS], b[KIDS]
    if [k[LABEL] for k in x] == [k[LABEL] for k in y]:
        return 1 + sum(matching(p, q)[0] for p, q in zip(x, y)), [(i, i) for i in range(len(x))]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    w = [[matching(p, q)[0] for q in y] for p in x]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w[i - 1][j - 1])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif m[i][j] == m[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + m[len(x)][len(y)], pairs[::-1]


def _common(a: dict, b: dict) -> dict:
    """Merged heavy hitters: at most KEPT digests; what goes beyond takes the same from all (Misra and Gries)."""
    out = dict(a)
    for k, (n, marks) in b.items():
        m, seen = out.get(k, (0, 0))
        out[k] = [m + n, seen | marks]
    if len(out) > KEPT:
        less = sorted((n for n, _ in out.values()), reverse=True)[KEPT]
        out = {k: [n - less, marks] for k, (n, marks) in out.items() if n > less}
    return out


#: Kids of a wrapper node; kinds that few pages have give way beyond it, and are told by the counts of their texts.
MOST_KIDS = 64


def merged(a: list, b: list) -> list:
    """The wrapper of two wrappers: matched nodes merged, others kept in order."""
    _, pairs = matching(a, b)
    kids, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[KIDS]), len(b[KIDS]))]:
        kids += a[KIDS][i:p] + b[KIDS][j:q]
        if p < len(a[KIDS]):
            kids.append(merged(a[KIDS][p], b[KIDS][q]))
        i, j = p + 1, q + 1
    if len(kids) > MOST_KIDS:
        kept = sorted(range(len(kids)), key=lambda i: (-kids[i][PAGES], i))[:MOST_KIDS]
        kids = [kids[i] for i in sorted(kept)]
    return [a[LABEL], a[PAGES] + b[PAGES], _common(a[TEXTS], b[TEXTS]), kids, _common(a[FIRST], b[FIRST]), _common(a[LAST], b[LAST]), a[ARTICLES] | b[ARTICLES]]


def block_keys(body: Node) -> list[tuple[Node, int, int | None]]:
    """(node, path, key) of every block of a page: its labels from the body on, and these with its text; no key without text."""
    found: list[tuple[Node, int, int | None]] = []
    out: list[str] = []

    def walk(node: Node, path: int) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                out.append(kid)
            elif is_furniture(kid):
                out.append("" if kid.tag in INLINE else " ")
            elif kid.tag in INLINE:
                walk(kid, path)
            else:
                start, own = len(out), xxh3_64_intdigest(kid.label.encode(errors="replace"), seed=path)
                out.append(" ")
                walk(kid, own)
                text = _joined(out[start:])
                out.append(" ")
                found.append((kid, own, xxh3_64_intdigest(text.encode(errors="replace"), seed=own) if text else None))

    walk(body, 0)
    return found


def body_of(root: Node) -> Node:
    stack = [root]
    while stack:
        node = stack.pop(0)
        if node.tag == "body":
            return node
        stack += [k for k in node.kids if isinstance(k, Node) and k.tag in ("html", "body")]
    return root


def tree_of(root: Node, at: dict | None = None) -> list:
    out = page_tree([body_of(root)], article_mark(root), at)
    out[LABEL] = "body"
    return out


#: Pages from which a host has a wrapper, and the share of pages that makes a text template.
LEAST, SHARE = 3, 0.5


def _is_constant(counts: dict, node: list, digest: int | None) -> bool:
    pages, marks = counts.get(str(digest), (0, 0))
    return digest is not None and pages >= max(LEAST, SHARE * node[PAGES]) and marks.bit_count() >= max(LEAST, SHARE * node[ARTICLES].bit_count())


def constant_nodes(root: Node, wrapper: list | None) -> set[int]:
    """DOM nodes of a page that hold their template's constant text."""
    gone: set[int] = set()
    if wrapper is None or wrapper[PAGES] < LEAST:
        return gone
    at: dict[int, list[Node]] = {}

    def walk(tree: list, wrap: list) -> None:
        for p, q in matching(tree, wrap)[1]:
            own, other = tree[KIDS][p], wrap[KIDS][q]
            nodes = at[id(own)]
            if _is_constant(other[TEXTS], other, _digest(nodes)):
                gone.update(id(x) for x in nodes)
                continue
            if len(nodes) > 1:
                for x, counts in ((nodes[0], other[FIRST]), (nodes[-1], other[LAST])):
                    if _is_constant(counts, other, _digest([x])):
                        gone.add(id(x))
            walk(own, other)

    walk(tree_of(root, at), wrapper)
    return gone


def _scopes(body: Node) -> list[Node]:
    """main, else the outermost articles, else the body."""
    found: dict[str, list[Node]] = {"main": [], "article": []}

    def walk(node: Node, inside: frozenset) -> None:
        for k in node.kids:
            if isinstance(k, Node) and not is_furniture(k):
                kind = "main" if k.tag == "main" or "main" in k.names.split() else k.tag if k.tag == "article" else None
                if kind and kind not in inside:
                    found[kind].append(k)
                walk(k, inside | {kind} if kind else inside)

    walk(body, frozenset())
    return found["main"] or found["article"] or [body]


def _blocks_below(node: Node):
    for k in node.kids:
        if isinstance(k, Node):
            yield k
            yield from _blocks_below(k)


def _link_lists(node: Node, gone: set[int]) -> None:
    """Blocks whose text is links for the most part, three at least."""
    for k in _blocks(node):
        links: list[str] = []

        def collect(x: Node, inside: bool) -> None:
            for y in x.kids:
                if isinstance(y, str):
                    if inside:
                        links.append(y)
                else:
                    collect(y, inside or y.tag == "a")

        count = sum(1 for _ in _anchors(k))
        if count >= 3 and (k.plain or not k.inside):  # an article's list of links is its own
            collect(k, False)
            whole = text_of(k)
            if len(_joined(links)) >= 0.8 * len(whole):
                gone.add(id(k))
                continue
        _link_lists(k, gone)


def _anchors(node: Node):
    for k in node.kids:
        if isinstance(k, Node):
            if k.tag == "a":
                yield k
            yield from _anchors(k)


def main_text(source: str, wrapper: list | None = None, fixed: frozenset | set = frozenset()) -> str:
    """The main text of one page, by its host's wrapper and the keys of its host's constant blocks, if there are any."""
    if not source:
        return ""
    root = parse(source, plain=wrapper is None or wrapper[PAGES] < LEAST)
    body = body_of(root)
    scopes = _scopes(body)
    gone = constant_nodes(root, wrapper)
    if fixed:
        gone |= {id(node) for node, _, key in block_keys(body) if key in fixed}
    # An article that is constant as a whole is template; the parts of one that varies are its own.
    scopes = [s for s in scopes if not (s.inside and id(s) in gone)]
    gone -= {id(node) for s in scopes if s.inside for node in _blocks_below(s)}
    for s in scopes:
        _link_lists(s, gone)
    return " ".join(x for s in scopes if (x := text_of(s, gone)))


# ---- Spark ----------------------------------------------------------------

HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
#: Hosts whose wrappers a task holds before it hands them on.
HELD = 2000
#: Counts of blocks held by a task before it hands them on.
FLUSH = 200_000


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower().removeprefix("www.").removeprefix("m.") if m else ""


def _merge_rows(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], pa.string())], names=["host", "wrapper"])


def _add(held: dict[str, list], host: str, tree: list) -> None:
    held[host] = merged(held[host], tree) if host in held else tree


def counted(pages: DataFrame) -> DataFrame:
    """What both tables below are made of, from one parse of each page: (host, wrapper as JSON), or (host, path, key, n, marks) of blocks.

    A task merges the wrappers and adds the counts of its pages; a key is null where the path's pages are counted.
    """

    def count(batches):
        trees: dict[str, list] = {}
        blocks: dict[tuple, list[int]] = {}

        def out():
            host, path, key = zip(*blocks) if blocks else ((), (), ())
            n, marks = zip(*blocks.values()) if blocks else ((), ())
            none = len(trees)
            columns = [
                pa.array([*trees, *host], pa.string()), pa.array([*(json.dumps(w, separators=(",", ":")) for w in trees.values()), *[None] * len(host)], pa.string()),
                *(pa.array([*[None] * none, *c], pa.uint64()).view(pa.int64()) for c in (path, key)), *(pa.array([*[None] * none, *c], pa.int64()) for c in (n, marks)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper", "path", "key", "n", "marks"])

        for batch in batches:
            for url, source in zip(batch.column(0).to_pylist(), shared.utf8_rows(batch.column(1))):
                if len(source):
                    host, root = host_of(url), parse(str(source, "utf-8"))
                    body, mark = body_of(root), article_mark(root)
                    tree = page_tree([body], mark)
                    tree[LABEL] = "body"
                    _add(trees, host, tree)
                    found = block_keys(body)
                    for path, key in {(path, key) for _, path, key in found} | {(path, None) for _, path, _ in found}:
                        seen = blocks.setdefault((host, path, key), [0, 0])
                        seen[0] += 1
                        seen[1] |= mark
                if len(blocks) >= FLUSH or len(trees) >= HELD:
                    yield out()
                    trees, blocks = {}, {}
        yield out()

    return pages.select("url", "html").transform(shared.in_arrow, count, "host string, wrapper string, path long, key long, n long, marks long")


def wrappers(parts: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) for every host, from all its pages."""

    def merge(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for host, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host not in held and held:  # sorted by host: the one before is complete
                    yield _merge_rows(held)
                    held = {}
                _add(held, host, json.loads(w))
        yield _merge_rows(held)

    part = parts.where("wrapper is not null").select("host", "wrapper").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(16)))
    for keys in (["host", "salt"], ["host"]):
        part = part.repartition(*keys).sortWithinPartitions("host", "wrapper").select("host", "wrapper").transform(shared.in_arrow, merge, "host string, wrapper string")
        if keys != ["host"]:
            part = part.withColumn("salt", F.lit(0))
    return part


def constant_blocks(parts: DataFrame) -> DataFrame:
    """(host, fixed): keys of the blocks that are constant among the host's pages with their path."""
    counts = parts.where("wrapper is null").groupBy("host", "path", "key").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("marks")).alias("articles"))
    base = shared.work_dir(parts.sparkSession, "html_blocks")
    counts = shared.saved(counts.where(F.col("n") >= LEAST), base)
    whole = counts.where("key is null").select("host", "path", F.col("n").alias("pages"), F.col("articles").alias("of"))
    common = counts.where("key is not null").join(whole, ["host", "path"]).where(f"n >= {SHARE} * pages and articles >= {LEAST} and articles >= {SHARE} * of")
    return common.groupBy("host").agg(F.collect_set("key").alias("fixed"))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text for every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    path = shared.work_dir(spark, "html_wrappers")
    parts = shared.saved(counted(pages), shared.work_dir(spark, "html_parts"))
    table = shared.saved(wrappers(parts).join(constant_blocks(parts), "host", "left"), path)
    schema = "page_id long, url string, text string"

    def known_of(wrapper, fixed):
        return (json.loads(wrapper) if wrapper else None, {k % 2**64 for k in fixed or ()})

    def rows(batch, found):
        text = [main_text(str(source, "utf-8"), *known) for source, known in zip(shared.utf8_rows(batch.column(2)), found)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    if shared.bytes_of(spark, path) <= shared.BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r[0]: r[1:] for r in table.collect()})

        def run(batches):
            mine: dict[str, tuple] = {}
            for batch in batches:
                hosts = [host_of(u) for u in batch.column(1).to_pylist()]
                for h in set(hosts) - mine.keys():
                    mine[h] = known_of(*known.value.get(h, (None, None)))
                yield rows(batch, [mine[h] for h in hosts])

        return pages.transform(shared.in_arrow, run, schema)

    def run_joined(batches):
        for batch in batches:
            yield rows(batch, [known_of(*x) for x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())])

    host = F.pandas_udf(lambda s: s.map(host_of), "string")
    joined = pages.withColumn("h", host("url")).join(table.withColumnRenamed("host", "h").hint("merge"), "h", "left")
    return joined.select("page_id", "url", "html", "wrapper", "fixed").transform(shared.in_arrow, run_joined, schema)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
