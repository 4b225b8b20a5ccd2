"""Main text of a page by composite text density.

A page becomes a list of nodes by one pass over its tags. For every node C characters, T tags, LC characters
and LT tags of links are counted, and its density is

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_body / C_body * C + e),

characters per tag adjusted for links. The node whose children's densities have the largest sum is where
the text is; the smallest density on the way from the body to it is the threshold, and every other subtree
that reaches the threshold adds its own node of the largest sum.

What a page says not to be text by its tag, role, or a class or id goes before: menus, headers and footers of
the page, sidebars, notices, adverts, forms, scripts, styles, reader comments. A class or id says so only as a whole:
``ad-slot`` does, ``search-algorithms`` is about something. Headings, paragraphs and other elements that hold text
itself go for no name but an advert's. A form, or a part with such a name, that holds most of the page's text without
links is around the main text and stays.

The work is linear in the page: each node is opened and closed once, and what an end tag ends is found by the open
elements of its name, not by climbing.
"""

from __future__ import annotations

import math
import re
from html import unescape

# a tag (quoted values may hold >), a comment, a declaration or an instruction
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_split = lambda names: frozenset(names.split())
VOID = _split("area base br col embed hr img input link meta param source track wbr")
RAW = _split("script style textarea title noscript iframe noembed noframes xmp")
INLINE = _split(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rt rp s samp "
    "small span strike strong sub sup time tt u var img wbr "
    "math mi mo mn ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mtable "
    "mtr mtd mlabeledtr mstyle mpadded mphantom menclose mfenced merror semantics annotation annotation-xml"
)
#: elements that an opening tag of theirs ends, up to one of the limits
ENDS = {
    "li": (_split("li"), _split("ul ol menu")),
    "dt": (_split("dt dd"), _split("dl")),
    "dd": (_split("dt dd"), _split("dl")),
    "tr": (_split("tr td th"), _split("table")),
    "td": (_split("td th"), _split("tr table")),
    "th": (_split("td th"), _split("tr table")),
    "option": (_split("option"), _split("select")),
    "body": (_split("head"), _split("html")),
}
#: containers that </p> and an opening block tag do not look beyond for an open p
LIMITS = _split(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form "
    "header html li main nav ol section table tbody td tfoot th thead tr ul button object"
)
DROPPED = _split(
    "head script style noscript template textarea title iframe object embed applet svg canvas audio video select "
    "button form input fieldset datalist nav footer aside menu dialog noembed noframes "
    "annotation annotation-xml"
)
ROLES = _split("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note status")
#: words that, with others of these and FILLING, make up a class or id that says what a subtree is
WORDS = _split(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "promotion banner banners sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login comment comments respond disqus reply replies share sharing social related recommended widget widgets "
    "toolbar pagination pager disclaimer copyright form search"
)
#: words that say where or how such a part stands
FILLING = _split(
    "a all area areas article articles bar bars bottom box boxes btn button buttons block blocks col column container "
    "content custom desktop field fixed float floating global google group head heading icon icons inline inner input item items "
    "js left link links list lists main mobile module mobile outer page panel post posts primary right row rows secondary "
    "section sections site slot slots small social sticky sub text thread title top trail twitter facebook ui unit units user users "
    "view wide wrap wrapper zone"
)
#: elements that hold text itself
TEXTUAL = _split("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody table caption pre blockquote figure figcaption")
ADVERTS = _split("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors")
#: words that mean a page's part only outside the text itself
OUTER = _split("header")
TEXT = _split("article main")
#: elements and roles that may also stand around the text
AROUND = _split("form fieldset header")
AROUND_ROLES = _split("form search")
#: words of parts that may be longer than the text they belong to
BESIDE = _split(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "promotion comment comments respond disqus reply replies cookie cookies consent gdpr popup modal overlay disclaimer "
    "related recommended footer newsletter subscribe"
)
#: elements out of which no article is taken
SHUT = _split("nav aside footer dialog template")
#: what a node is dropped for: always, unless it holds most of the text, and unless it also has no text beside it
ALWAYS, UNLESS_MOST, UNLESS_ALL = 1, 2, 3


class Node:
    __slots__ = (
        "article", "chars", "children", "depth", "dropped", "inner", "limit", "link", "link_chars", "link_tags", "own", "parent",
        "scope", "shut", "tag", "tags",
    )

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.own = 0  # is it dropped for what it says of itself?
        self.depth = 0 if parent is None else parent.depth + 1
        # depth of the nearest element, itself included, that is not inline, and that limits paragraphs
        self.scope = parent.scope if parent is not None and tag in INLINE else self.depth
        self.limit = self.depth if parent is None or tag in LIMITS else parent.limit
        self.dropped = parent is not None and parent.dropped
        self.link = tag == "a" or (parent is not None and parent.link)
        self.inner = tag in TEXT or (parent is not None and parent.inner)
        self.shut = tag in SHUT or (parent is not None and parent.shut)
        # the nearest article or main element, itself included
        self.article: Node | None = self if tag in TEXT else parent.article if parent is not None else None
        if parent is not None:
            parent.children.append(self)


def _says(name: str, inner: bool) -> bool:
    """Is this class or id one of a part that is not the text?"""
    words = {w.lower() for w in _PART.findall(name)}
    words = {w for w in words if len(w) > 1 and not w.isdigit()}
    telling = words & WORDS or (words & OUTER if not inner else set())
    return bool(telling) and words <= WORDS | FILLING | OUTER


def _unwanted(tag: str, attrs: str, inner: bool) -> int:
    """0 for a node that is not dropped, else what it is dropped for."""
    around = tag in AROUND and (tag not in OUTER or not inner)
    if tag in DROPPED and not around:
        return ALWAYS
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return UNLESS_MOST if around else 0
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return ALWAYS
    role = found.get("role", "").lower()
    if role in ROLES and role not in AROUND_ROLES:
        return ALWAYS
    if "display:none" in found.get("style", "").lower().replace(" ", ""):
        return ALWAYS
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    words = [{w.lower() for w in _PART.findall(name)} for name in names]
    if tag in TEXTUAL:
        return UNLESS_ALL if any(w and w <= ADVERTS for w in words) else 0
    if tag in TEXT:
        unwanted = any(w and w <= ADVERTS | {"comment", "comments", "reply", "replies", "related"} for w in words)
    else:
        unwanted = any(_says(name, inner) for name in names)
    if not (unwanted or around or role in AROUND_ROLES):
        return 0
    beside = any(w & BESIDE and (tag in TEXT or _says(name, inner)) for name, w in zip(names, words, strict=True))
    return UNLESS_ALL if beside else UNLESS_MOST


def parse(page: str) -> tuple[Node, list[tuple[Node, str | None]]]:
    """The root, and the page's runs in order: (node, text), with None for the edge of a block."""
    root = Node("", None)
    at = root
    runs: list[tuple[Node, str | None]] = []
    place, end = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            runs.append((at, piece))

    open_: dict[str, list[Node]] = {}  # the open elements of each name, the innermost last
    endless: set[str] = set()  # raw elements without an end in the rest of the page

    def innermost(name: str) -> Node | None:
        nodes = open_.get(name)
        return nodes[-1] if nodes else None

    def closed(to: Node) -> None:
        nonlocal at
        while at is not to.parent:
            open_[at.tag].pop()
            at = at.parent

    while place < end:
        token = _TOKEN.search(page, place)
        if token is None:
            text(page[place:])
            break
        text(page[place : token.start()])
        place = token.end()
        if token["data"] is not None:
            text(token["data"].replace("&", "&amp;"))
            continue
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        attrs = token["attrs"] or token["attrs2"] or ""
        block = tag not in INLINE and tag != "br"
        if token["close"] or token["close2"]:
            node = innermost(tag)
            # the end of an inline element or a paragraph does not end what holds it
            if node is not None and node.depth > (at.limit if tag == "p" else 0 if block else at.scope):
                if block:
                    runs.append((at, None))
                closed(node)
            continue
        if block:
            runs.append((at, None))
            node = innermost("p")
            if node is not None and node.depth > at.limit:
                closed(node)
        if tag in ENDS:
            ended, limits = ENDS[tag]
            least = max((node.depth for node in map(innermost, limits) if node is not None), default=0)
            for node in [n for n in map(innermost, ended) if n is not None]:
                while node is not None and node.depth > least:
                    if node.depth <= at.depth:
                        closed(node)
                    node = innermost(node.tag)
        if tag == "br":
            runs.append((at, " "))
        if tag == "a" and at.link:  # links do not nest
            node = innermost("a")
            if node is not None and node.depth > at.scope:
                closed(node)
        node = Node(tag, at)
        node.own = _unwanted(tag, attrs, at.inner)
        node.dropped = node.dropped or node.own
        if tag in VOID or attrs.endswith("/"):
            if tag in VOID or tag in ("svg", "path"):
                continue
        if tag in RAW:
            stop = None
            if tag not in endless:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, place)
                if stop is None:
                    endless.add(tag)
            place = stop.end() if stop else (end if tag in ("script", "style") else place)
            continue
        at = node
        open_.setdefault(tag, []).append(node)
    runs.append((at, None))
    return root, runs


def _density(node: Node, body_chars: int, body_links: int) -> float:
    if not node.chars:
        return 0.0
    tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
    plain = max(1, node.chars - node.link_chars)
    base = math.log(node.chars / plain * node.link_chars + body_links / max(1, body_chars) * node.chars + math.e)
    ratio = node.chars / links * tags / link_tags
    # the base is 1 where nothing is linked: then no adjustment
    adjust = math.log(ratio) / math.log(base) if base > 1.0000001 else 1.0 + math.log(max(ratio, 1.0))
    return node.chars / tags * max(adjust, 0.0)


def main_text(page: str) -> str:
    """The blocks of the main text, white space in a block as one space, joined by a line feed; empty if none."""
    root, runs = parse(page)
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    # a form or the like around the text itself is no part to drop
    for node in order:
        if node.tag in TEXT and node.dropped and not node.own and not node.shut:
            _restore(node)
    _keep_most(order, runs)
    pieces: list[tuple[Node, str | None]] = []
    for node, piece in runs:
        if node.dropped:
            continue
        if piece is None:
            pieces.append((node, None))
            continue
        piece = unescape(piece)
        pieces.append((node, piece))
        size = len("".join(piece.split()))
        node.chars += size
        if node.link:
            node.link_chars += size
    live = [node for node in order if not node.dropped]
    for node in reversed(live):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((n for n in live if n.tag == "body"), root)
    if body.chars < root.chars:
        body = root  # text outside the body
    density = {id(n): _density(n, body.chars, body.link_chars) for n in live}
    # sums over blocks: a paragraph is no better for being bold
    live_blocks = [n for n in live if n.tag not in INLINE]
    total = {id(n): sum(density[id(c)] for c in n.children if not c.dropped and c.tag not in INLINE) for n in live_blocks}
    # the node of the largest sum in each subtree
    best: dict[int, Node] = {}
    for node in reversed(live_blocks):
        top = node
        for child in node.children:
            if id(child) in best and total[id(best[id(child)])] > total[id(top)]:
                top = best[id(child)]
        best[id(node)] = top
    chosen = best[id(body)]
    limit, up = density[id(chosen)], chosen
    while up is not None and up is not body:
        up = up.parent
        if up is not None:
            limit = min(limit, density[id(up)])
    marked = {id(n) for n in live if n.tag == "h1"}  # the headline may stand before the text's container
    todo = [body]
    while todo:
        node = todo.pop()
        if density[id(node)] >= limit and node.chars:
            marked.add(id(_article(best[id(node)])))
            todo.extend(c for c in node.children if id(c) in best)
    inside: dict[int, bool] = {}
    for node in live:  # parents come first
        inside[id(node)] = id(node) in marked or (node.parent is not None and inside.get(id(node.parent), False))
    blocks: list[str] = []
    block: list[str] = []
    for node, piece in pieces:
        if piece is None:
            blocks.append(" ".join("".join(block).split()))
            block = []
        elif inside[id(node)]:
            block.append(piece)
    return "\n".join(b for b in blocks if b)


def _article(node: Node) -> Node:
    """The article or main element around a node, else the node."""
    return node if node.article is None or node.article.dropped else node.article


def _keep_most(order: list[Node], runs: list[tuple[Node, str | None]]) -> None:
    """Restore what is dropped for its name or as a form but holds most of the characters outside links;
    what is dropped inside of it stays dropped."""
    if not any(node.own > ALWAYS and node.dropped for node in order):
        return
    gone: set[int] = set()
    for node in order:  # parents come first
        if node.own == ALWAYS or id(node.parent) in gone:
            gone.add(id(node))
    plain = dict.fromkeys(map(id, order), 0)
    for node, piece in runs:
        if piece is not None and not node.link and id(node) not in gone:
            plain[id(node)] += len("".join(unescape(piece).split()))
    beside = sum(plain[id(node)] for node in order if not node.dropped)
    titled = {id(node) for node in order if node.tag == "h1" and id(node) not in gone}
    for node in reversed(order):
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
            if id(node) in titled:
                titled.add(id(node.parent))
    total = plain[id(order[0])]
    for node in order:
        if 2 * plain[id(node)] <= total or node.own <= ALWAYS or node.parent.dropped:
            continue
        if node.own == UNLESS_MOST or not beside or id(node) in titled:
            node.own = 0
            _restore(node)


def _restore(node: Node) -> None:
    todo = [node]
    while todo:
        one = todo.pop()
        if not one.own:
            one.dropped = False
            todo.extend(one.children)
    up = node.parent
    while up is not None and up.dropped:  # above one that stays, all stay
        up.dropped = False
        up = up.parent
