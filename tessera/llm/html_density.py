"""Main text of web pages by composite text density.

For every node of the DOM: C characters, T tags, LC characters in links, LT links below it. Its composite density is

    (C / T) * log_b( (C / LC) * (T / LT) ),   b = ln( C / (C - LC) * LC + LC_body / C_body * C + e )

(a denominator of 0 counts as 1, and a base of 1 as e): characters per tag, the less the more of them are links. A node's density sum is that
of its children. The subtree with the largest sum is the main content; the least density on its path to the body is the
threshold, and every other subtree below the body that reaches it, with a sum in proportion, is content too.

The densities are those of every node of the page; <article>, <main> and other names play no part in them. Names are a
last filter: elements that are no part of an article by their tag, class, id or role (menus, page headers, footers,
sidebars, notices, adverts, form controls, comments) are neither chosen nor part of what is chosen; a class must be one
of ``NAMED`` as a whole token, and an id counts only outside of articles and sections. Where what they leave has less than
``OUTSIDE`` of the page's largest density sum, the elements around that subtree stay in all the same: a page may well be
wrapped in one of those names. If a page has one <article> that is text for the most part, and the densest subtree lies
apart from it, as long comments without a name do, the densest subtree of the article is taken, and nothing from outside
of it but headings beside it. Scripts, styles and other elements whose content is no text are not read at all.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: HTML element names, and names that pages give to parts outside of the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title svg audio video canvas xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside button select dialog menu".split())
#: Dropped outside of an article, and in a form.
OF_FORMS = frozenset("fieldset label noscript object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
BOUNDS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"])}
NAMED = re.compile(
    r"(?:ads?|adv|adverts?|advertisements?|advertising|adsense|adslot|adbox|banner|sponsor(?:ed|s)?|promo(?:tion|ted)?s?|nav|navbar|navigation|menu|submenu|topmenu|breadcrumbs?|crumbs|side-?bar|aside|rail|foot|footer|masthead|topbar|toolbar|site-?header|page-?header|cookies?|consent|gdpr|(?:cookies?|consent|gdpr)-(?:notice|banner|bar|popup|message|consent)|notices?|notification|alert|popup|modal|overlay|comments?|comment-?list|replies|reply|respond|disqus|discussion|feedback|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|sign-?up|login|search|search-?box|pager|pagination|widgets?|skip-?link|copyright|disclaimer|legal)"
)
#: Elements whose id names a part of the text, as "discussion" or "legal" may.
TITLED = frozenset("section h1 h2 h3 h4 h5 h6 p a span li dt dd figure table".split())
#: Names of notices, adverts, comments and menus that count in an article too; others count there for parts that are links
#: for the most part.
PLAIN = re.compile(r"(?:ads?|adv|adverts?|advertisements?|advertising|adsense|adslot|adbox|banner|sponsor(?:ed|s)?|promo(?:tion|ted)?s?|nav|navbar|navigation|menu|submenu|topmenu|breadcrumbs?|side-?bar|footer|cookies?|consent|gdpr|(?:cookies?|consent|gdpr)-(?:notice|banner|bar|popup|message|consent)|notices?|notification|popup|comments?|comment-?list|disqus|share|sharing|social|newsletter|subscribe|subscription|signup|sign-?up|login|pager|pagination|skip-?link)")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: What is left of a tag: up to the first > outside of quotes.
REST_OF_TAG = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")
#: Tags with an unclosed quote after which quotes in tags are no longer paired: each such tag reads the rest of the page.
ODD_QUOTES = 8
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Share of the largest density sum that further subtrees must reach.
PART = 0.1
#: Characters outside of links that a page's only <article> needs to count as its text.
ARTICLE_CHARS = 80
#: Share of the page's largest density sum that must lie outside of elements with names of no article.
OUTSIDE = 0.2


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "doubtful", "chars", "tags", "link_chars", "links", "density", "total", "kept", "kept_total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, doubtful: bool = False):
        self.tag, self.parent, self.dropped, self.doubtful = tag, parent, dropped, doubtful
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = self.kept = 0
        self.density = self.total = self.kept_total = 0.0


def unwanted(tag: str, attributes: str, in_article: bool, in_form: bool) -> tuple[bool, bool]:
    """Whether an element is no part of the text, and whether that holds only if it is links for the most part."""
    if tag in DROPPED or (tag == "header" and not in_article) or (tag in OF_FORMS and (in_form or not in_article)):
        return True, False
    if len(attributes) < 5 or tag in ("body", "html", "article", "main"):
        return False, False
    doubtful = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False
        if name == "role" and value.lower() in ROLES:
            return True, False
        if name == "class" or (name == "id" and not in_article and tag not in TITLED):
            names = [x for x in CAMEL.sub("-", value).lower().replace("_", "-").split() if NAMED.fullmatch(x)]
            if names and (not in_article or (tag not in TITLED and any(map(PLAIN.fullmatch, names)))):
                return True, False
            doubtful = doubtful or bool(names)
    return doubtful, doubtful


def parse(page: str) -> Node:
    root = top = Node("body", None, False)
    open_tags: dict[str, int] = {}
    at = odd = 0
    last = page.rfind(">") + 1  # no tag ends after that
    while at < len(page):
        m = TAG.search(page, at, last)
        text = page[at : m.start()] if m else UNCLOSED.split(page[at:], maxsplit=1)[0]
        if text:
            top.children.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if at == last and UNCLOSED.match(m[0]) and not m[0].endswith(("-->", "]]>")):
                break
            continue
        close = REST_OF_TAG.match(page, at, last) if odd < ODD_QUOTES else None
        odd += not close
        attributes, at = page[at : (end := close.end() if close else page.find(">", at) + 1)], end
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                while True:
                    name, top = top.tag, top.parent
                    open_tags[name] -= 1
                    if name == tag:
                        break
            elif tag == "p":
                top.children.append(Node("p", top, False))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if not attributes.endswith("/>") else None
            at = end.end() if end else at if attributes.endswith("/>") else len(page)
            continue
        for name, closers in CLOSED_BY.items():
            if tag in closers and open_tags.get(name):
                node, bounds = top, BOUNDS.get(name, ())
                while node is not root and node.tag != name and node.tag not in bounds and not (name == "p" and node.tag in BLOCK):
                    node = node.parent
                if node.tag == name:
                    while True:
                        name_, top = top.tag, top.parent
                        open_tags[name_] -= 1
                        if name_ == name:
                            break
        if tag in ("body", "html"):
            continue
        node = Node(tag, top, *unwanted(tag, attributes, bool(open_tags.get("article") or open_tags.get("main")), bool(open_tags.get("form"))))
        top.children.append(node)
        if tag not in VOID and not (attributes.endswith("/>") and tag not in BLOCK):
            top = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def nodes(root: Node, dropped: bool = False) -> list[Node]:
    """All nodes, each before its children; unless ``dropped``, those at and below a dropped one are left out."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and (dropped or not c.dropped))
    return out


def around(node: Node | None) -> Iterator[Node]:
    """A node and its ancestors."""
    while node is not None:
        yield node
        node = node.parent


def measure(order: list[Node]) -> None:
    """Densities and density sums of nodes that come before their children; ``kept`` and ``kept_total`` leave out what a name drops."""
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                node.chars += n
                node.kept += n
            else:
                node.chars += c.chars
                node.kept += 0 if c.dropped else c.kept
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.links += c.links + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
        if node.doubtful and 2 * node.link_chars <= node.chars:
            node.dropped = False
    body = order[0]
    share = body.link_chars / (body.chars or 1)
    for node in order:
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars, node.links
        if c:
            base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
            inner = c / (lc or 1) * (t / (lt or 1))
            node.density = c / t * (math.log(max(inner, 1e-9)) / math.log(base) if base > 1 + 1e-12 else math.log(max(inner, 1e-9)))
    for node in order[1:]:
        node.parent.total += max(0.0, node.density)
        node.parent.kept_total += 0.0 if node.dropped else max(0.0, node.density)


def largest(order: list[Node], total: Callable[[Node], float]) -> Node:
    """The node with the largest density sum; the page itself only if nothing in it has half as much."""
    root, below = order[0], order[1:]
    best = max(below, key=total, default=root)
    return best if 2 * total(best) >= total(root) > 0 else root


def only_article(order: list[Node]) -> Node | None:
    """The one <article> of a page, nested ones not counted, if it holds text that is no link for the most part."""
    found, within = [], set()
    for node in order:  # parents come first
        if node.parent is not None and (node.parent.tag == "article" or id(node.parent) in within):
            within.add(id(node))
        elif node.tag == "article":
            found.append(node)
    if len(found) == 1 and found[0].kept - found[0].link_chars >= ARTICLE_CHARS and 2 * found[0].link_chars <= found[0].chars:
        return found[0]
    return None


def content(root: Node) -> list[Node]:
    """Roots of the subtrees that are the article, in page order."""
    every = nodes(root, dropped=True)
    measure(every)
    best = largest(every, lambda n: n.total)
    if best.total <= 0:
        return [root] if root.chars else []
    outside = largest(nodes(root), lambda n: n.kept_total)
    if outside.kept_total >= OUTSIDE * best.total and outside.kept:
        best = outside
    else:
        for node in around(best):
            node.dropped = False
    order = nodes(root)
    article, apart, within = only_article(order), False, set()
    if article is not None and not any(node is article for node in around(best)) and not any(node is best for node in around(article)):
        inside = nodes(article)
        best, apart, within = largest(inside, lambda n: n.kept_total), True, {id(node) for node in inside}
    threshold = min(node.density for node in around(best))
    # up to a parent that adds little, and not for the most part links, but the headline
    while (up := best.parent) is not None and up is not root and up.kept <= 1.3 * best.kept + 200 and 2 * (up.link_chars - best.link_chars) <= up.chars - best.chars:
        best = up
    chosen, above = {id(best)}, {id(node) for node in around(best.parent)}
    for node in order[1:]:
        if id(node) in above:
            continue
        if apart and id(node) not in within:
            if node.tag in ("h1", "h2", "h3") and node.parent is article.parent and node.link_chars * 2 < node.chars + 1:
                chosen.add(id(node))
        elif node.total >= PART * best.total and node.density >= threshold and node.tag not in ("ul", "ol", "table"):
            chosen.add(id(node))
        elif node.tag in ("h1", "p", "blockquote", "pre", "h2", "h3") and node.parent is best.parent and node.link_chars * 2 < node.chars + 1:
            chosen.add(id(node))
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            out.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    return out


def blocks(node: Node) -> list[str]:
    out: list[list[str]] = [[]]
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.dropped or x is node:
            if x.tag == "br":
                out[-1].append(" ")
                continue
            block = x.tag in BLOCK
            if block:
                out.append([])
                stack.append(None)
            stack.extend(reversed(x.children))
    found = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in out if b)
    return [b for b in found if b]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(b for node in content(parse(page)) for b in blocks(node))


@pandas_udf(StringType())
def main_texts(page: pd.Series) -> pd.Series:
    return page.map(main_text)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    A null or empty page, and one without an article, has an empty text. White space inside a block becomes one blank,
    ``<br>`` too; blocks are joined by a line break. Pages of any length are read whole, broken markup included.
    Repeated rows come back as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    out = pages.select("page_id", "url", main_texts(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
