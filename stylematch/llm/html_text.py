"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/<>]*+))")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas nav menu aside footer button input select textarea option "
    "label dialog title head noembed noframes audio video map".split())
CLOSES_P = BLOCKS - frozenset("body html tbody td tfoot th thead tr caption".split())
#: An open element that ends where one of the others starts, unless a container stands between them.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
ENDS = {tag: [name for name, enders in ENDED_BY.items() if tag in enders] for tag in frozenset().union(*ENDED_BY.values())}
STOPS = frozenset("ul ol dl table select div article section main aside nav body".split())
PAGE_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion outbrain taboola comment comments "
    "disqus respond replies reply-list sidebar side-bar widget widgets menu navbar navigation breadcrumb breadcrumbs pagination pager footer "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices popup pop-up modal overlay lightbox newsletter subscribe subscription "
    "signup sign-up login share sharing social related recommended recommendations skip-link screen-reader sr-only foot legal colophon "
    "copyright".split())
#: Words that are joined to such a name without changing what it names, as in commentlist.
HOLDERS = ("list", "area", "section", "box", "form", "wrap", "wrapper", "container", "block", "bar", "thread", "holder", "panel")
TITLES = frozenset("lead lede standfirst summary subtitle subheading intro dek teaser-text abstract".split())
CELLS = frozenset("td th".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BONUS = {"article": 30.0, "main": 25.0, "section": 5.0, "div": 2.0}
MAIN_WORDS = frozenset("article content main post entry story text body".split())
#: First and last parts of names that tell what an element has, not what it is.
HAS = frozenset("has have with no not without is are show shows hide hides can supports".split())
STATES = frozenset("enabled disabled on off open opened closed collapsed expanded active inactive visible allowed ready".split())


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "named", "lead", "hint", "score", "half", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, hint: float = 0.0):
        self.tag, self.parent, self.drop, self.hint = tag, parent, drop, hint
        self.children: list = []
        #: Dropped for a name alone, which ``_restore`` may take back.
        self.named = False
        #: A paragraph whose name says that it opens the article.
        self.lead = False
        self.score = self.half = 0.0
        self.chars = self.link_chars = 0


def _furniture(word: str) -> bool:
    """Whether a name, or the name before a word such as list or box, is one of page furniture."""
    return word in PAGE_NOISE or any(word.endswith(h) and word[:-len(h)] in PAGE_NOISE for h in HOLDERS)


def _noisy(tag: str, attributes: str) -> tuple[bool, bool, float]:
    """Whether an element is page furniture, whether only its name says so, and a bonus for names of content."""
    if tag in DROPPED:
        return True, False, 0.0
    hint, named = BONUS.get(tag, 0.0), False
    if not attributes or tag in ("body", "html", "article", "main"):
        return tag == "form", tag == "form", hint
    main = False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, 0.0
        if name == "role":
            if value in NOISE_ROLES:
                return True, False, 0.0
            hint += 25.0 * (value in ("main", "article"))
        if name in ("class", "id"):
            for word in value.split():
                parts = [word, *re.split(r"[-_]+|\d+", word)]
                if any(_furniture(p) for p in parts):
                    named = named or not (len(parts) > 2 and (parts[1] in HAS or parts[-1] in STATES))
                elif any(p in MAIN_WORDS for p in parts):
                    main, hint = True, hint + 8.0
    named = tag == "form" or named and not main
    return named, named, hint


class _Tags:
    """Finds the ends of tags, each character being passed a bounded number of times whatever the page holds.

    A tag ends at the first ``>`` outside quotes. One that has none before the page ends is text; all later tags that
    come upon the same opening quote have none either, so it is remembered.
    """

    def __init__(self, page: str):
        self.page = page
        self.hopeless: set[int] = set()
        self.seen = (0, -1)

    def _special(self, start: int) -> int:
        """The first ``>`` or quote from ``start`` on, or the length of the page."""
        if not self.seen[0] <= start <= self.seen[1]:
            found = SPECIAL.search(self.page, start)
            self.seen = (start, found.start() if found else len(self.page))
        return self.seen[1]

    def end(self, start: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``start``, or -1."""
        passed, at = [], start
        while at >= 0:
            at = self._special(at)
            if at == len(self.page) or at in self.hopeless:
                break
            if self.page[at] == ">":
                return at
            passed.append(at)
            closing = self.page.find(self.page[at], at + 1)
            at = closing + 1 if closing >= 0 else -1
        self.hopeless.update(passed)
        return -1


class _Open:
    """The elements that are open, innermost last, with the places of each tag and of the containers among them."""

    def __init__(self):
        self.chain: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.stops: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.chain))
        if node.tag in STOPS:
            self.stops.append(len(self.chain))
        self.chain.append(node)

    def end(self, tag: str, through: bool = False) -> None:
        """End the innermost element of a tag and all inside it; a container in between protects it unless ``through``."""
        places = self.places.get(tag)
        if not places or not through and self.stops and self.stops[-1] > places[-1]:
            return
        for node in reversed(self.chain[places[-1]:]):
            self.places[node.tag].pop()
            if node.tag in STOPS:
                self.stops.pop()
            self.chain.pop()


def parse(page: str) -> Node:
    """A lenient tree: unclosed elements end with their parents, paragraphs end where blocks start, stray ends are ignored.

    Unclosed tags, quotes and elements cost no more than others: the time is linear in the page.
    """
    root = Node("html", None)
    opened, tags, end, start = _Open(), _Tags(page), 0, 0

    def add(what: str | Node) -> None:
        if what:
            (opened.chain[-1] if opened.chain else root).children.append(what)

    while token := OPENING.search(page, start):
        comment, declared, closing, name = token.groups()
        if comment:
            close = page.find("-->", token.end())
            close = len(page) if close < 0 else close + 2
        elif declared:
            close = page.find(">", token.end())
            if close < 0:
                # no tag can end either
                break
        else:
            close = tags.end(token.end())
            if close < 0:
                start = token.end()
                continue
        add(html.unescape(page[end:token.start()]))
        start = end = min(close + 1, len(page))
        if name is None:
            continue
        tag = name.lower()
        if closing:
            opened.end(tag, tag in STOPS or tag in BLOCKS)
            continue
        if tag in CLOSES_P:
            opened.end("p")
        for open_tag in ENDS.get(tag, ()):
            opened.end(open_tag)
        if tag == "body" or tag == "html":
            continue
        if tag == "br":
            add(" ")
            continue
        attributes = page[token.end():close]
        drop, named, hint = _noisy(tag, attributes)
        parent = opened.chain[-1] if opened.chain else root
        if tag in VOID:
            if tag == "hr":
                add(Node(tag, parent))
            continue
        node = Node(tag, parent, drop, hint)
        node.named = named
        node.lead = tag == "p" and any(word in TITLES for word in re.split(r"[^a-z]+", attributes.lower()))
        root.named = root.named or named
        add(node)
        if tag in RAW:
            raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, end)
            close = page.find(">", raw.end()) if raw else -1
            start = end = close + 1 if close >= 0 else len(page)
            continue
        if not attributes.endswith("/"):
            opened.push(node)
    add(html.unescape(page[end:]))
    return root


def _blocks(root: Node, out: list[tuple[Node, str]]) -> None:
    """Add the blocks of text below a node, with the block element they stand in, to ``out`` in page order."""
    inside: list[str] = []
    stack = [(root, root, iter(root.children), False)]
    while stack:
        here, block, children, within = stack[-1]
        for child in children:
            if isinstance(child, str):
                inside.append(child)
                continue
            if child.drop:
                if child.tag in BLOCKS:
                    _flush(inside, out, block)
                continue
            if child.tag == "header":
                _flush(inside, out, block)
                child.children = _headings(child, within)
            if child.tag in BLOCKS:
                _flush(inside, out, block)
                stack.append((child, child, iter(child.children), within or child.tag == "article"))
            else:
                stack.append((child, block, iter(child.children), within))
            break
        else:
            if here.tag in BLOCKS:
                _flush(inside, out, block)
            stack.pop()


def _headings(node: Node, article: bool) -> list[Node]:
    """The headings below a header element: they belong to the article it stands in, the rest does not.

    In the header of an article element, paragraphs that are sentences or named as its lead belong to it as well.
    """
    found, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str) or child.drop:
            continue
        if child.tag in HEADINGS or article and child.tag == "p" and _lead(child):
            found.append(child)
        else:
            stack.extend(reversed(child.children))
    return found


def _lead(node: Node) -> bool:
    """Whether a paragraph of a header is text: named as a lead, or 40 characters and more that end as sentences do."""
    if node.lead:
        return True
    if node.chars < 40 or 2 * node.link_chars >= node.chars:
        return False
    last = next((c for c in reversed(node.children) if not isinstance(c, str) or c.strip()), "")
    return isinstance(last, str) and last.rstrip().endswith((".", "!", "?", "…", ".”", ".\""))


def _flush(inside: list[str], out: list[tuple[Node, str]], block: Node) -> None:
    text = " ".join("".join(inside).split())
    inside.clear()
    if text:
        out.append((block, text))


def _content(node: Node) -> bool:
    return node.tag in ("article", "main", "h1") or node.hint > BONUS.get(node.tag, 0.0)


def _restore(root: Node) -> None:
    """Take back the drop of named elements that hold the article.

    Such an element contains a main element, or most characters that the page has in paragraphs outside links; then it
    also contains an h1, or no text outside it stands in an element that is or is named content.
    """
    order, stack = [], [(root, False, False, False)]
    inside: dict[int, list] = {}
    while stack:
        node, linked, paragraph, content = stack.pop()
        linked, paragraph = linked or node.tag == "a", paragraph or node.tag in PARAGRAPHS and node.tag not in HEADINGS
        order.append((node, content))
        inside[id(node)] = [sum(len(c.strip()) for c in node.children if isinstance(c, str)) * (paragraph and not linked), node.tag == "main", node.tag == "h1"]
        content = content or _content(node)
        stack.extend((c, linked, paragraph, content) for c in node.children if not isinstance(c, str) and (c.named or not c.drop))
    for node, _ in reversed(order):
        if node.parent is not None:
            own, up = inside[id(node)], inside[id(node.parent)]
            up[0], up[1], up[2] = up[0] + own[0], up[1] or own[1], up[2] or own[2]
    least = inside[id(root)][0] / 2
    in_sight = _content_in_sight(root, False)
    for node, content in order:
        if not node.named or node is root or not (inside[id(node)][1] or inside[id(node)][0] > least):
            continue
        if inside[id(node)][1] or inside[id(node)][2] or not in_sight:
            node.drop = False
            in_sight = in_sight or _content_in_sight(node, content)


def _content_in_sight(top: Node, content: bool) -> bool:
    """Whether text below a node that is not dropped stands in an element that is or is named content, the page's header aside."""
    stack = [(top, content)]
    while stack:
        node, content = stack.pop()
        content = content or _content(node)
        if content and any(isinstance(c, str) and c.strip() for c in node.children):
            return True
        stack.extend((c, content) for c in node.children if not isinstance(c, str) and not c.drop and not (c.tag == "header" and node.parent is None))
    return False


def _measure(root: Node) -> list[Node]:
    """Characters of text, and of text in links, below each node that is not dropped; the nodes, parents first."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        for child in node.children:
            if isinstance(child, str):
                n = len(child.strip())
                node.chars += n
                node.link_chars += n * linked
            elif not child.drop:
                stack.append((child, linked))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    return order


def _beside(child: Node | str, parent: Node) -> bool:
    """Whether what stands beside the best container belongs to it: all but links, and the header of the whole page."""
    if isinstance(child, str) or child.drop or not child.chars or child.tag == "header" and parent.parent is None:
        return False
    return child.tag in HEADINGS or child.tag == "header" or 2 * child.link_chars < child.chars


def _score(blocks: list[tuple[Node, str]], order: list[Node]) -> list[Node]:
    """The ancestors of the blocks, with their scores: points in full, then half, then less by half at each step up."""
    scored: dict[int, Node] = {}
    for node, text in blocks:
        first = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        above = first
        while above is not None and id(above) not in scored:
            scored[id(above)] = above
            above = above.parent
        first.score += 1.0 + text.count(",") + min(3.0, len(text) / 100)
    # ``score`` holds a node's own points until its turn, ``half`` what has come up from below
    for node in reversed(order):
        if id(node) in scored:
            if node.parent is not None:
                node.parent.half += node.score / 2 + node.half / 1.5
            node.score += node.half + node.hint
    return list(scored.values())


def _beside_article(article: Node) -> list[Node]:
    """What belongs to an article element beside it: the siblings of it and of its ancestors up to the content around it.

    That is the nearest main element or element named as content, or else the element it stands in. Right below the
    body only other articles and an h1 are taken.
    """
    top, chosen = article.parent, []
    while top.parent is not None and not _content(top):
        top = top.parent
    if top.parent is None:
        top = article.parent
    node = article
    while True:
        parent = node.parent
        for child in parent.children:
            if child is not node and _beside(child, parent) and (parent.parent is not None or child.tag in ("article", "h1")):
                chosen.append(child)
        if parent is top:
            return chosen
        node = parent


def main_text(page: str | None) -> str:
    """The blocks of the best container and of its siblings, joined by line feeds.

    Every paragraph gives points to its ancestors, 1 + commas + a point per 100 characters (3 at most), in full to the
    parent, half to the grandparent, less above. A node's score, with a bonus for elements and names that hold
    articles, is multiplied by one minus its share of text in links. Without any paragraph the whole page counts. A best node inside
    an article or main element stands for that element; beside an article, what ``_beside_article`` names is kept, and beside any
    other node but a main element all that is not half links. Of the cells of a layout table those of links go.
    """
    if not page:
        return ""
    root = parse(page)
    if root.named:
        _restore(root)
    order = _measure(root)
    blocks: list[tuple[Node, str]] = []
    _blocks(root, blocks)
    scored = _score(blocks, order)
    if not scored:
        return ""

    def value(node: Node) -> float:
        return node.score * (1 - node.link_chars / max(1, node.chars))

    best = max(scored, key=value)
    above = best
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    best = above or best
    layout = best.tag in ("table", "tbody", "tr")
    while best.parent is not None and best.parent.chars == best.chars and best.tag not in ("article", "main"):
        best = best.parent
    chosen = [best]
    if best.tag == "article":
        chosen += _beside_article(best)
    elif best.parent is not None and best.tag != "main":
        chosen += [child for child in best.parent.children if child is not best and _beside(child, best.parent)]
    within, stack = set(), list(chosen)
    while stack:
        node = stack.pop()
        if layout and node.tag in CELLS and 0 < node.chars <= 2 * node.link_chars:
            continue
        within.add(id(node))
        stack.extend(child for child in node.children if not isinstance(child, str))
    if best.parent is not None and best.tag not in ("article", "main"):
        loose = [(len(c.strip()), 0) if isinstance(c, str) else (c.chars, c.link_chars) for c in best.parent.children if isinstance(c, str) or not c.drop and c.tag not in BLOCKS]
        if 2 * sum(links for _, links in loose) < sum(chars for chars, _ in loose):
            within.add(id(best.parent))
    return "\n".join(text for node, text in blocks if id(node) in within)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 500):
            part = batch.slice(start, 500)
            texts = [main_text(page.as_py()) for page in part.column(2)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the article of its whole HTML, see ``main_text``.

    A null or empty page has an empty text. Null and repeated ids and urls pass through. An empty table gives an empty
    result; other columns are not read. One pass without a shuffle; one page is held at a time, and the tree is walked
    without recursion and in time linear in the page, however malformed or deep it is.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
