"""Main text of web pages with site template removal (operator 2).

1. A tolerant parser makes a tree of each page (unclosed and misnested elements are closed as browsers
   do in the common cases). Elements that are not article text by their tag, role, or class and id are
   dropped: menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles, comments. A
   class or id tells only if all of its words do (`related-posts`, but not `related-work`), and within an article only of
   elements that hold others (a div, not a heading or a paragraph). A form that holds most of the page's text and
   paragraphs or headings is a wrapper, not a form.
2. Every other element subtree with text is hashed (tags and normalised text, bottom up). Spark counts
   for each host the different pages that hold a subtree; pages with the same text count as one, so
   copies of an article are not a template. An element that is all of its parent's text is not counted beside it. A subtree on at least `least` pages and `share` of the host's pages is
   deleted wherever it stands on that host, within an article only if it is on half of the host's pages, and
   never if it holds most of the page's text. A host's recurring subtrees are few, as each is on a share of its pages: at most
   one over `share` times the subtrees of a mean page. They meet the host's pages as one array, by a broadcast if all are counted
   to be at most BROADCAST_BYTES, else by a join to which the pages go once.
3. The text is that of all articles that are left, in page order (an article within an article is part of it), after
   first headings (h1) before them; without articles that of main, else of the body. Block elements make blocks.

Articles of equal size have no order but that of the page. Null or empty html gives an empty text. A page whose URL has no host is not compared with others.
Repeated rows count once and are returned each time; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._spark import BROADCAST_BYTES, cut, map_texts

# Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
# Choices of this operator: elements, roles and class or id words that are not article text.
DROPPED = frozenset("nav footer aside form button select dialog menu head object canvas audio video input".split()) | RAW
#: Dropped outside of articles, where they are of forms and fallbacks.
OUTSIDE = frozenset("label noscript".split())
#: Elements of text: within an article their class does not tell.
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr blockquote pre figcaption caption a abbr b i em strong small span sub sup mark q cite code time u s label math noscript".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond toolbar pagination pager skip search widget".split()
)
HEADERS = frozenset("header topbar".split())
#: Words that may stand beside those in a class or id without giving it a meaning of its own.
BESIDE = frozenset(
    "site page main global top bottom left right inner outer box block area section container wrapper wrap list item items link links post posts article articles story stories content body bar unit slot panel inline sticky fixed user reader readers form count icon icons button buttons title text div primary secondary".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "comment", "size", "hash")

    def __init__(self, tag: str, parent, drop: bool = False, comment: bool = False):
        self.tag, self.parent, self.drop, self.comment = tag, parent, drop, comment
        self.children: list = []  # nodes and strings
        self.size, self.hash = 0, 0


def _telling(name: str) -> set[str]:
    """The words by which a class or an id says that its element is not article text, or a header."""
    words = {w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()}
    return (words & (WORDS | HEADERS)) if words <= WORDS | HEADERS | BESIDE else set()


def _words(attributes: str) -> tuple[set[str], bool]:
    """Telling words of class, id and role, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[5]:
            hidden = True
            continue
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for x in value.split():
                words |= _telling(x)
            continue
        value = value.lower()
        if name == "role":
            words.update("role:" + x for x in value.split())
        elif name == "itemprop" and value == "articlebody":
            words.add("articlebody")
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return words, hidden


def parse(page: str) -> Node:
    root = Node("#root", None)
    node, at, end = root, 0, len(page)
    article = 0  # open articles
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            stop = tag not in BLOCKS
            seek = node
            while seek.parent is not None and seek.tag != tag and not (stop and seek.tag in BLOCKS):
                seek = seek.parent
            if seek.tag == tag and seek.parent is not None:
                while node is not seek:
                    article -= node.tag == "article"
                    node = node.parent
                article -= node.tag == "article"
                node = node.parent
            continue
        if tag in VOID:
            node.children.append(Node(tag, node) if tag == "hr" else " ")
            continue
        if tag in BLOCKS:
            seek = node
            while seek.parent is not None and seek.tag != "p" and (seek.tag not in BLOCKS):
                seek = seek.parent
            if seek.tag == "p":
                node = seek.parent
        if tag in _CLOSES:
            seek = node
            while seek.parent is not None and seek.tag not in _CLOSES[tag] and seek.tag not in _STOPS[tag]:
                seek = seek.parent
            if seek.tag in _CLOSES[tag] and seek.parent is not None:
                while node is not seek:
                    article -= node.tag == "article"
                    node = node.parent
                node = node.parent
        words, hidden = _words(m[3]) if m[3].strip(" /\n") else (set(), False)
        comment = bool(words & {"comment", "comments", "commentlist", "reply", "replies"})
        tells = not (article and tag in PLAIN)
        bad = tag in DROPPED or tag in OUTSIDE and not article or hidden or tells and bool(words & WORDS) or any("role:" + r in words for r in ROLES)
        comment = comment and tells
        bad = bad or (tag == "header" or bool(words & HEADERS)) and not article
        if tag in ("html", "body", "main") or tag == "article" and not comment or "articlebody" in words:
            bad = hidden
        own = Node("main" if "role:main" in words else "article" if "articlebody" in words else tag, node, bad, comment)
        node.children.append(own)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if m[3].rstrip().endswith("/") and tag in ("path", "use"):
            continue
        node = own
        article += own.tag == "article"
    return root


def _measure(node: Node, wrappers: bool = False) -> None:
    """Fills in sizes and hashes of the text that is not dropped; with `wrappers`, elements around an article or main are kept."""
    node.size = 0
    stack = [(node, iter(node.children), xxhash.xxh64(node.tag.encode()), [False])]
    while stack:
        own, rest, state, found = stack[-1]
        for child in rest:
            if isinstance(child, str):
                text = " ".join(entities.unescape(child).split())
                if text:
                    own.size += len(text)
                    state.update(text.encode("utf-8", "surrogatepass"))
            else:
                child.size = 0
                stack.append((child, iter(child.children), xxhash.xxh64(child.tag.encode()), [False]))
                break
        else:
            stack.pop()
            holds = found[0] or own.tag in ("article", "main") and not own.comment and own.size > 0
            if wrappers and own.drop and found[0] and own.tag not in RAW and not own.comment:
                own.drop = False  # a wrapper of the article
            if own.drop:
                own.size = 0
            own.hash = state.intdigest() - (1 << 63)
            if stack:
                top = stack[-1]
                top[3][0] = top[3][0] or holds and not own.drop
                top[0].size += own.size
                if not own.drop:
                    top[2].update(own.hash.to_bytes(8, "little", signed=True))


def _nodes(node: Node):
    stack = [node]
    while stack:
        own = stack.pop()
        if own.drop:
            continue
        yield own
        stack.extend(c for c in reversed(own.children) if not isinstance(c, str))


def _contents(root: Node) -> list[Node]:
    """The outermost articles and the first headings before them, else the largest main, else the largest body, else all."""
    articles: list[Node] = []
    headings: list[Node] = []
    best: dict[str, Node] = {}
    stack = [root]
    while stack:
        own = stack.pop()
        if own.drop:
            continue
        if own.tag == "article" and own.size:
            articles.append(own)
            continue
        if own.tag == "h1" and not articles:
            headings.append(own)
        if own.tag in ("main", "body") and own.size > (best[own.tag].size if own.tag in best else 0):
            best[own.tag] = own
        stack.extend(c for c in reversed(own.children) if not isinstance(c, str))
    return [*headings, *articles] if articles else [best.get("main") or best.get("body") or root]


def _text(top: Node) -> str:
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        now.clear()
        if text:
            blocks.append(text)

    stack: list = [("in", top)]
    while stack:
        what, own = stack.pop()
        if what == "text":
            now.append(own)
        elif what == "out":
            flush()
        else:
            if own is not top and own.drop:
                now.append(" ")
                continue
            block = own.tag in BLOCKS
            if block:
                flush()
                stack.append(("out", own))
            elif own.tag in ("td", "th"):
                now.append(" ")
            stack.extend(("text", c) if isinstance(c, str) else ("in", c) for c in reversed(own.children))
    flush()
    return "\n\n".join(blocks)


def _unwrap(root: Node) -> None:
    """Forms around most of what would be left of the page, with paragraphs or headings, are no forms."""
    forms, stack = [], [root]
    while stack:
        own = stack.pop()
        if own.drop and own.tag != "form":
            continue
        if own.drop:
            forms.append(own)
        stack.extend(c for c in own.children if not isinstance(c, str))
    if not forms:
        return
    for f in forms:
        f.drop = False
    _measure(root)
    for f in forms:
        inside = list(_nodes(f))
        f.drop = not (2 * f.size > root.size and any(n.tag in ("p", "h1", "h2", "h3", "article", "main") for n in inside))


def tree(page: str) -> Node:
    root = parse(page)
    _unwrap(root)
    _measure(root)
    if not any(n.tag in ("article", "main") and n.size for n in _nodes(root)):
        _measure(root, wrappers=True)  # else nothing would be left of a page within, say, a sidebar
    return root


def recurring(root: Node):
    """Hashes of the subtrees that may be parts of a template."""
    stack = [(c, -1) for c in root.children if not isinstance(c, str)]
    while stack:
        own, above = stack.pop()
        if own.drop or not own.size:
            continue
        counted = own.size <= root.size / 2
        if counted and own.size != above:
            yield own.hash
        stack.extend((c, own.size if counted else -1) for c in own.children if not isinstance(c, str))


def main_text(page: str | None, everywhere: frozenset = frozenset(), outside: frozenset = frozenset()) -> str:
    """The main text of a page without the subtrees with hashes in `everywhere`, nor, outside of articles, those in `outside`."""
    if not page:
        return ""
    root = tree(page)
    if everywhere or outside:
        most = root.size / 2
        stack = [(c, False) for c in root.children if not isinstance(c, str)]
        while stack:
            own, inside = stack.pop()
            if own.drop:
                continue
            own.drop = own.size <= most and (own.hash in everywhere or not inside and own.hash in outside)
            inside = inside or own.tag == "article"
            stack.extend((c, inside) for c in own.children if not isinstance(c, str))
        _measure(root)
    return "\n\n".join(filter(None, map(_text, _contents(root))))


def _subtrees(batches):
    """host, the hash of the page's text, the hash of a subtree: once for each subtree of a page, and once without one for the page."""
    for batch in batches:
        hosts, pages, hashes = [], [], []
        for host, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True):
            root = tree(page)
            found = [None, *set(recurring(root))]
            hosts += [host] * len(found)
            pages += [root.hash] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, pages, hashes)], names=["host", "page", "subtree"])


def _extract(batches):
    for batch in batches:
        texts = []
        for page, everywhere, outside in zip(*(batch.column(c).to_pylist() for c in ("html", "everywhere", "outside")), strict=True):
            texts.append(main_text(page, frozenset(everywhere or ()), frozenset(outside or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.large_string()).cast(pa.string())], names=["page_id", "url", "text"])


def template(pages: DataFrame, least: int = 4, share: float = 0.1) -> DataFrame:
    """host, everywhere, outside: the hashes of the subtrees of each host's template, for pages (host, html), the host as a hash or null.

    everywhere: those on half of the host's pages or more; outside: the others, which go only outside of articles.
    """
    found = map_texts(pages.where("host is not null and length(html) > 0").select("host", "html"), _subtrees, "host long, page long, subtree long").distinct()
    counts = cut(found.groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("n") >= least) | F.col("subtree").isNull()))
    sizes = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    held = counts.where("subtree is not null").join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    most = 2 * F.col("n") >= F.col("pages")
    return cut(held.groupBy("host").agg(F.collect_list(F.when(most, F.col("subtree"))).alias("everywhere"), F.collect_list(F.when(~most, F.col("subtree"))).alias("outside")))


def extract(pages: DataFrame, least: int = 4, share: float = 0.1) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = pages.select("page_id", "url", "html", F.when(F.length(host) > 0, F.xxhash64(host)).alias("host"))
    gone = template(own, least, share)
    size = gone.agg(F.sum(8 * (F.size("everywhere") + F.size("outside")) + 32)).first()[0] or 0
    joined = own.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = map_texts(joined.select("page_id", "url", "html", "everywhere", "outside"), _extract, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
