"""HTML extraction by removal of site templates.

Every page is parsed to a tree and every element's subtree is hashed: its tag,
its own text and its children's hashes; attributes and numbers, which vary
from page to page, are left out. Subtrees that hold links and nothing else,
menus, are hashed a second time as frames, without the links' texts and with
equal neighbours as one, so that a menu recurs though its entries differ. In
Spark the subtrees are counted by host over pages with different contents, and
a subtree or frame that stands in at least ``MIN_PAGES`` of them and in
``SHARE`` of the host's (``LARGE_SHARE`` of a host with over ``LARGE`` pages) is
part of the site's template. By these shares a host has a bounded number of
template subtrees, whatever its size: an average page's subtrees over the share.

In a second pass a page loses its host's template first: subtrees wherever
they stand, frames outside its article. Of what is left the article elements
are taken, or else the main ones, or else all; and what never recurs goes by
its kind or role, or as a last resort by words of its class: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import by_bytes, cut, join_by_group, map_batches

MIN_PAGES = 5
SHARE = 0.3
LARGE = 1000
LARGE_SHARE = 0.1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(/?)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that show nothing, and so part no words.
_UNSEEN = frozenset("script style template noscript title head".split())
#: A start tag closes these if they are open, up to a table or list that holds them.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table select html body article section div".split())
#: Block elements, at whose start an open paragraph ends.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that are never main text, by kind, by role and by words of their class or id.
_NEVER = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video map dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_COMMENTS = frozenset("comment comments respond disqus".split())
_HEADERS = frozenset("header masthead topbar banner".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer"
    " cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended pagination pager toolbar widget".split()
)


class Node:
    __slots__ = ("attributes", "children", "frame", "gone", "hash", "holds", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children, self.gone, self.hash, self.frame = tag, attributes, [], False, 0, 0
        self.holds = False  # an article or main element, so no class makes it a sidebar


def parse(page: str) -> Node:
    """A tree of elements and strings; markup that is left open ends with what holds it."""
    root = Node("#page")
    open_ = [root]
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut_tag = rest.rfind("<")  # a tag that the page's end cuts off is no text
            open_[-1].children.append(html.unescape(rest[:cut_tag] if cut_tag >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut_tag:]) else rest))
            break
        if m.start() > at:
            open_[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        _imply_ends(open_, tag)
        node = Node(tag, m[3])
        open_[-1].children.append(node)
        if tag in ("article", "main") and not any(n.tag == "article" for n in open_):
            for holder in open_:
                holder.holds = True
        if tag in _RAW:
            close = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            node.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in _VOID and not (m[4] and tag in ("svg", "path", "circle", "rect", "use")):
            open_.append(node)
    return root


def _imply_ends(open_: list[Node], tag: str) -> None:
    closing = _CLOSES.get(tag)
    if closing is None and tag not in _ENDS_P:
        return
    for k in range(len(open_) - 1, 0, -1):
        here = open_[k].tag
        if closing and here in closing or tag in _ENDS_P and here == "p":
            del open_[k:]
            return
        if here in _SCOPE or (closing is None and here in ("li", "td", "th", "dd")):
            return


def _classed(node: Node, inside: bool) -> bool:
    """Whether a node is dropped for its kind, role, class or id; ``inside`` an article headers stay."""
    if node.tag in _NEVER or node.tag == "header" and not inside:
        return True
    if not node.attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and node.tag not in ("html", "body"):
            words = set(re.split(r"[^a-z]+", value))
            if words & _COMMENTS and node.tag != "main":
                return True
            if node.tag not in ("article", "main") and not node.holds and (words & _WORDS or not inside and words & _HEADERS):
                return True
    return False


#: Elements that are no menu even if they hold links only.
_NO_FRAME = frozenset("#page html head body article main p h1 h2 h3 h4 h5 h6 blockquote pre table".split())
_WORDLESS = re.compile(r"[\W_]*")
_NUMBER = re.compile(r"\d+")


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


_LINK = _signed("a link")


def _frame(node: Node) -> int:
    """The frame of a subtree that holds links and no other words, with equal neighbours as one; 0 for any other."""
    if node.tag == "a":
        return _LINK
    if node.tag in _NO_FRAME:
        return 0
    parts: list[int] = []
    for c in node.children:
        if isinstance(c, Node):
            if not c.frame:
                return 0
            if parts[-1:] != [c.frame]:
                parts.append(c.frame)
        elif not _WORDLESS.fullmatch(c):
            return 0
    return _signed(f"{node.tag}\x1c{parts}")


def hashes(root: Node) -> list[int]:
    """Signed 64-bit hashes of all subtrees that are no mere inline markup, and of menus' frames; set in the nodes too."""
    out: list[int] = []
    stack: list[tuple[Node, int]] = [(root, 0)]
    links: list[int] = []  # how many links were closed before an element was opened
    closed = 0
    while stack:
        node, state = stack.pop()
        if state == 0:
            stack.append((node, 1))
            links.append(closed)
            stack += [(c, 0) for c in node.children if isinstance(c, Node)]
            continue
        held = closed - links.pop()
        closed += node.tag == "a"
        body = "\x1f".join([f"\x1e{c.hash}" if isinstance(c, Node) else _NUMBER.sub("0", " ".join(c.split())) for c in node.children])
        node.hash, node.frame = _signed(f"{node.tag}\x1d{body}"), _frame(node)
        if node.tag not in _INLINE and node is not root and body.strip("\x1f "):
            out.append(node.hash)
            if node.frame and held > 1:
                out.append(node.frame)
    return out


def _mark(root: Node, template: frozenset[int], rules: bool = True) -> list[Node]:
    """Mark what goes; the article elements that stay (or main elements), in page order.

    Without ``rules`` only the template goes.
    """
    articles, mains = [], []
    stack = [(root, False, False)]
    while stack:
        node, inside, within = stack.pop()
        node.gone = node.tag not in ("#page", "html", "body") and (node.hash in template or not inside and not node.holds and node.frame in template) or rules and _classed(node, inside)
        if node.gone:
            continue
        if node.tag == "article" and not inside:
            articles.append(node)
        elif node.tag == "main" and not within:
            mains.append(node)
        stack += [(c, inside or node.tag == "article", within or node.tag == "main") for c in reversed(node.children) if isinstance(c, Node)]
    return (articles or mains) if rules else []


def _blocks(node: Node) -> Iterator[str]:
    """Pieces of text with a line feed's stand-in, U+001F, at the borders of blocks."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif x.gone:
            if x.tag not in _INLINE and x.tag not in _UNSEEN:
                yield "\x1f"
        else:
            block = x.tag not in _INLINE
            if block:
                yield "\x1f"
                stack.append("\x1f")
            stack += reversed(x.children)


def main_text(page: str | None, template: frozenset[int] = frozenset(), rules: bool = True) -> str:
    """The main text of a page: its blocks in order, joined by one space. Without ``rules`` only the template and what shows nothing go."""
    root = parse(page or "")
    if template:
        hashes(root)
    roots = _mark(root, template, rules) or [root]
    if not rules:
        for node in _nodes(root):
            node.gone |= node.tag in _UNSEEN
    blocks = "\x1f".join("".join(_blocks(r)) for r in roots).split("\x1f")
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def _nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in node.children if isinstance(c, Node)]


_HASHED = "host string, content bigint, hashes array<bigint>"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, 1):
            found = [sorted(set(hashes(parse(p.as_py() or "")))) for p in part.column(1)]
            content = [_signed(",".join(map(str, f))) for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "content", "hashes"])


def templates(pages: DataFrame, host: str = "_host", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``_host, _pages, _template``: each host's pages and the hashes of its template subtrees.

    Pages with equal contents count once, so copies of a page make no template.
    """
    hashed = pages.filter(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col("html").cast("string")).transform(map_batches, _hashed, _HASHED)
    hashed = cut(hashed)
    unique = hashed.groupBy("host", "content").agg(F.first("hashes").alias("hashes"), F.count("*").alias("n"))
    unique = cut(unique)
    sizes = unique.groupBy("host").agg(F.count("*").alias("different"), F.sum("n").alias("_pages"))
    counts = unique.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("times")).filter(F.col("times") >= min_pages)
    needed = F.when(F.col("different") > LARGE, F.greatest(F.lit(share * LARGE), F.lit(min(share, LARGE_SHARE)) * F.col("different"))).otherwise(share * F.col("different"))
    often = counts.join(sizes, "host").filter(F.col("times") >= needed)
    sets = often.groupBy("host").agg(F.collect_list("h").alias("_template"))
    return sizes.join(sets, "host", "left").select(F.col("host").alias("_host"), F.col("_pages"), F.coalesce("_template", F.array().cast("array<bigint>")).alias("_template"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars``.

    The host is the authority of the url, in lower case.

    Defined results: null and empty pages have an empty text; pages with a
    null url or one without a host have no site template; broken markup is
    read as far as it goes; repeated rows give repeated rows; an empty table
    gives an empty result; further columns are not read.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.when(host != "", host).alias("_host"))
    sites = cut(templates(own, "_host", min_pages, share))
    total = max(1, sites.agg(F.coalesce(F.sum("_pages"), F.lit(0))).head()[0])
    joined = join_by_group(own.filter("_host IS NOT NULL"), sites, "_host", "_pages", total, 8 * F.size("_template"))
    rest = own.filter("_host IS NULL").withColumn("_template", F.array().cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}  # the hosts met last

        def template(host: str | None, hashes_: pa.ListScalar) -> frozenset[int]:
            if host is None:
                return frozenset()
            if host not in known:
                if len(known) >= 256:
                    known.clear()
                known[host] = frozenset(hashes_.as_py() or ())
            return known[host]

        for batch in batches:
            for part in by_bytes(batch, 2):
                hosts = part.column(4).to_pylist()
                texts = [main_text(p.as_py(), template(h, t)) for p, t, h in zip(part.column(2), part.column(3), hosts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = ["page_id", "url", "html", "_template", "_host"]
    return joined.select(*columns).unionByName(rest.select(*columns)).transform(map_batches, run, "page_id bigint, url string, text string, n_chars bigint")
