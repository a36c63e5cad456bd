"""The main text of HTML pages by tree scoring.

Every paragraph gives points for its length and commas, less for its share of link
text, to its ancestors, less with each level. The container with the most points and its
siblings that read like it are kept, without menus, forms, adverts, notices and
readers' comments. A class or id made of an everyday word (discussion, side, menu) leaves
out nothing that reads as text: only links, or words without a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements whose content is never part of the text.
LEFT_OUT = frozenset("script style title textarea iframe noembed noframes head noscript template nav footer aside form button select datalist object svg canvas video audio menu dialog annotation annotation-xml".split())
#: An opening tag closes open elements of these names, up to one of the second set.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
HOLDERS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of a class or id that name other things than the text; the second list holds beginnings. A label made of
#: such words and the third list's alone names other things; with any word beside them (side-effects) it only casts doubt.
NOT_TEXT = frozenset("ad ads adv adbox adslot banner nav menu masthead footer side rail widget consent gdpr notice notices notification alert modal overlay signup login respond replies discussion share related recommended pagination pager toolbar form search copyright skip outbrain taboola trending popular paywall toc tags".split())
NOT_TEXT_STARTS = ("sponsor", "promo", "cookie", "subscri", "navigation", "popup", "social", "sharing", "recommend")
BESIDE = frozenset("area articles bar block body bottom box btn button buttons by card cards center column container content count field group head heading header holder icon icons inline inner item items js label large left link links list main mini module more now page panel post posts reader readers right row section site slot small stories sticky text this to tool tools top unit us user users view widgets with wrap wrapper you your zone".split())
#: Words of NOT_TEXT that articles use too: alone, or with words of structure, they leave out only what does not read as text.
EVERYDAY = frozenset("side menu rail widget discussion related recommended search form copyright popular trending toc tags paywall".split())
STRUCTURE = frozenset("area article block body container content heading inner main page section text wrap wrapper".split())
#: What ends a sentence, and how long text without it must be to read as text.
STOPS, SENTENCE, PROSE = (".", "!", "?", "\u2026", "\u3002", ":", '."', ".\u201d"), 15, 60
#: Beginnings that cast no doubt, but for the words in the second list.
UNMISTAKABLE = ("comment", "sidebar", "advert", "newsletter", "breadcrumb", "navbar", "navmenu", "disqus", "sitefooter", "siteheader", "sitenav")
MISTAKABLE = ("commentar", "advertent")
#: What the points that come through a doubtful element count, and through how many ancestors a paragraph's points go.
DOUBT, LEVELS = 0.3, 6
TEXT = frozenset("article content main post entry story body text page".split())
NEGATED = frozenset("with has no without is".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([a-zA-Z-]+)""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"""[>"']""")
RIGHTS = re.compile(r"\xa9|copyright|all rights reserved|cookie", re.I)
COMMAS = re.compile("[,،、，;]")
WANTED = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden", "itemprop"))


class Node:
    """An element at block level; ``parts`` holds text pieces as (text, in a link) and nodes, in page order."""

    __slots__ = ("name", "label", "parent", "parts", "other", "doubt", "weak", "positive", "points", "size", "linked", "links", "marks", "holds")

    def __init__(self, name: str, parent: Node | None, label: str = ""):
        self.name, self.label, self.parent = name, label, parent
        self.parts: list = []
        self.other = self.doubt = self.weak = self.positive = False
        self.points = 0.0
        self.size = self.linked = self.links = self.marks = 0
        self.holds = False


def attributes(source: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(source):
        name = (m[1] or m[3]).lower()
        if name in WANTED and name not in found:
            found[name] = unescape((m[2] or "").strip("\"'"))
    return found


def is_everyday(words: list[str]) -> bool:
    """Whether a label is an everyday word of NOT_TEXT, alone or with words of structure."""
    return any(w in EVERYDAY for w in words) and all(w in EVERYDAY or w in STRUCTURE or w.isdigit() for w in words)


def names_other(words: list[str]) -> bool | None:
    """Whether a label's words name something else than text; None where they may."""
    if any(w.startswith(UNMISTAKABLE) and not w.startswith(MISTAKABLE) for w in [*words, "".join(words)]):
        return True
    hit = [w in NOT_TEXT or w.startswith(NOT_TEXT_STARTS) for w in words]
    if not any(hit):
        return True if "".join(words).startswith(NOT_TEXT_STARTS) and all(w in BESIDE for w in words[1:]) else False
    return True if all(h or w in BESIDE or w.isdigit() for h, w in zip(hit, words, strict=True)) else None


def kind_of(name: str, has: dict[str, str], in_text: bool) -> tuple[bool, bool, bool, bool]:
    """(names something else than text, may do so, does so unless it reads as text, names text) by role, visibility, class and id."""
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", has.get("style", ""), re.I):
        return True, False, False, False
    if has.get("role", "").lower() in ROLES:
        return True, False, False, False
    other = doubt = weak = positive = False
    # Where nothing marks the article, such a name on a mere box still says more than its text.
    may_read = in_text or name not in ("div", "ul", "ol", "table", "td")
    for label in f"{has.get('class', '')} {has.get('id', '')}".split():
        words = [w.lower() for w in WORDS.findall(label)]
        if words and words[0] in NEGATED:
            continue
        positive |= any(w in TEXT for w in words)
        if may_read and is_everyday(words):
            weak = True
            continue
        named = names_other(words)
        other |= named is True
        doubt |= named is None
        other |= words in (["header"], ["page", "header"], ["top", "header"], ["site", "header"]) and not in_text
    return other, doubt and not other, weak and not other, positive or "articlebody" in has.get("itemprop", "").lower()


def tag_end(html: str, at: int) -> int:
    """Where the tag that is open at ``at`` ends (its >), outside quotes; the first > if a quote is never closed; -1 without any."""
    first = html.find(">", at)
    if first < 0:
        return -1
    while True:
        m = QUOTE.search(html, at)
        if m is None:
            return first
        if m[0] == ">":
            return m.start()
        at = html.find(m[0], m.end()) + 1
        if not at:
            return first


def parse(html: str, left_out: frozenset[str]) -> Node:
    """The tree of block-level elements with their text; ``left_out`` elements have none."""
    root = Node("#root", None)
    stack: list[tuple[str, Node, bool]] = [("#root", root, False)]  # name, its block, whether text is dropped
    open_at: dict[str, list[int]] = {}  # heights of the open elements by name, so no tag looks through the stack
    blocks = [0]  # heights of the open block-level elements
    holders = 0  # open articles and mains
    link_depth = 0  # stack height at which a link opened, 0 outside links
    at, n = 0, len(html)

    def text(piece: str) -> None:
        _, node, dropped = stack[-1]
        if piece and not dropped:
            node.parts.append((unescape(piece) if "&" in piece else piece, link_depth > 0))

    def cut(height: int) -> None:
        nonlocal link_depth, holders
        while len(stack) > height:
            gone = stack.pop()[0]
            open_at[gone].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            holders -= gone in HOLDERS
        if link_depth > height:
            link_depth = 0

    def highest(names: tuple[str, ...]) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            text(html[at:])
            break
        c = html[lt + 1]
        if c == "!" or c == "?":
            text(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            else:
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        closing = c == "/"
        m = NAME.match(html, lt + 1 + closing)
        if m is None:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        end = tag_end(html, m.end())
        text(html[at:lt])
        if end < 0:
            break  # cut off inside a tag
        at = end + 1
        name = m[0].lower()
        if closing:
            if name == "a":
                link_depth = 0
            height = highest((name,))
            # An inline end tag does not close blocks.
            if height and (name in BLOCK or blocks[-1] <= height):
                cut(height)
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in BLOCK:
            height = blocks[-1]
            if stack[height][0] == "p" or name in HEADINGS and stack[height][0] in HEADINGS:
                cut(height)
            if name in CLOSES:
                names, stops = CLOSES[name]
                # A row closes its cells and the row before.
                while highest(names) > highest(stops):
                    cut(highest(names))
        _, above, dropped = stack[-1]
        source = html[m.end() : end]
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])|</{name}$", re.I | re.A).search(html, at)
            if name not in left_out and not dropped and name in BLOCK:
                text(html[at : close.start() if close else n])
            if close is None:
                break
            at = html.find(">", close.start()) + 1 or n
            continue
        has = attributes(source) if "=" in source or "hidden" in source else {}
        other, doubt, weak, positive = kind_of(name, has, holders > 0) if has else (False, False, False, False)
        if name == "header" and not holders:
            dropped = True
        dropped = dropped or name in left_out
        if name in BLOCK:
            node = Node(name, above, has.get("class", ""))
            node.positive, node.doubt, node.weak = positive, doubt, weak
            node.other = other and name not in ("html", "body")
            above.parts.append(node)
            if name == "hr":
                continue
        else:
            node = above
            dropped = dropped or other
            if name == "a":
                if not source.rstrip().endswith("/"):
                    link_depth = len(stack)
                    above.links += 1
        open_at.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        holders += name in HOLDERS
        stack.append((name, node, dropped))
    return root


def pieces(node: Node) -> Iterator[list[tuple[str, bool]]]:
    """The node's own paragraphs: runs of text between its block-level children."""
    run: list[tuple[str, bool]] = []
    for part in node.parts:
        if isinstance(part, Node):
            if run:
                yield run
            run = []
        else:
            run.append(part)
    if run:
        yield run


def flat(run: list[tuple[str, bool]]) -> str:
    return " ".join("".join(t for t, _ in run).split())


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        found.append(node)
        waiting += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return found


def judge_weak(every: list[Node]) -> None:
    """Nodes with an everyday name are other things if they do not read as text: links for the most part, or without a sentence."""
    if not any(node.weak for node in every):
        return
    sizes: dict[int, list] = {}  # characters, those in links, whether something reads as a sentence
    for node in reversed(every):
        own = sizes.setdefault(id(node), [0, 0, False])
        for run in pieces(node):
            line = flat(run)
            linked = min(len(line), sum(len(t) for t, link in run if link))
            own[0] += len(line)
            own[1] += linked
            said = len(line) >= PROSE or len(line) >= SENTENCE and line.endswith(STOPS)
            own[2] |= said and 2 * linked < len(line) and not (len(line) < 3 * PROSE and RIGHTS.search(line))
        if node.weak:
            reads = own[2] and 2 * own[1] < own[0]
            node.other, node.doubt = node.other or not reads, node.doubt or reads
        if node.parent is not None:
            above = sizes.setdefault(id(node.parent), [0, 0, False])
            above[0], above[1], above[2] = above[0] + own[0], above[1] + own[1], above[2] or own[2]


def score(root: Node) -> list[Node]:
    """Fill in sizes and points; returns the nodes that count, without those that name something else and hold no article of their own."""
    every = nodes_of(root)
    judge_weak(every)
    for node in reversed(every):
        node.holds = node.holds or (node.name in HOLDERS or node.name == "h1") and not node.other
        if node.parent is not None and node.holds and not node.other:
            node.parent.holds = True
    alive = {id(root)}
    kept = []
    for node in every:
        if node is root or id(node.parent) in alive and not (node.other and not (node.holds and node.name not in HOLDERS)):
            alive.add(id(node))
            kept.append(node)
    for node in kept:
        node.parts = [p for p in node.parts if not isinstance(p, Node) or id(p) in alive]
    for node in kept:
        for run in pieces(node):
            size = len(flat(run))
            if not size:
                continue
            linked = min(size, sum(len(t) for t, link in run if link))
            node.size += size
            node.linked += linked
            node.marks += sum(t.count(".") + len(COMMAS.findall(t)) for t, link in run if link)
            points = (min(1.0, size / 25) + len(COMMAS.findall("".join(t for t, _ in run))) + min(size / 100, 3)) * (1 - linked / size)
            if node.name in HEADINGS:
                points *= 0.2
            # A paragraph counts for what holds it, text straight in a container for the container.
            above = node.parent if node.name in ("p", "pre", "blockquote", "li", "dd", "td", *HEADINGS) and node.parent is not None else node
            level = 0
            while above is not None and level < LEVELS:
                points *= DOUBT if above.doubt else 1
                above.points += points / (1, 2, *range(6, 3 * LEVELS, 3))[level]
                above, level = above.parent, level + 1
    for node in reversed(kept):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.links += node.links
            node.parent.marks += node.marks
    for node in kept:
        if node.size:
            node.points *= (1 - node.linked / node.size) * (1.3 if node.name in HOLDERS else 1.15 if node.positive else 1)
    return kept


def is_list_of_links(node: Node) -> bool:
    """Whether a list or container is links for the most part, and these do not read as text: they are short and without stops and commas."""
    if node.links < 2 or not node.size:
        return False
    if node.doubt and node.linked > 0.5 * node.size:
        return True
    return node.name in ("ul", "ol", "dl", "div", "section") and node.linked > 0.7 * node.size and node.linked < 40 * node.links and 2 * node.marks < node.links


def is_twin(part: Node, top: Node) -> bool:
    """Whether a sibling is of the same kind as the best container and says something: long, or sentences."""
    if (part.name, part.label) != (top.name, top.label) or part.doubt or part.linked >= 0.25 * part.size:
        return False
    said = text_of([part])
    return not RIGHTS.search(said) and (part.size > 80 or said.endswith((".", "!", "?", "\u2026", "\u3002", '."', ".\u201d")))


def chosen(kept: list[Node]) -> list[Node]:
    """The best container, or the article or main element around it, and the siblings that go with it."""
    best = max(kept, key=lambda x: x.points)
    if best.points <= 0:
        return []
    around = best
    while around is not None:
        if around.name == "article":
            break
        around = around.parent
    if around is None:
        around = best
        while around is not None and around.name != "main":
            around = around.parent
    top = around or best
    if top.parent is None:
        return [top]
    found = []
    for part in top.parent.parts:
        if part is top:
            found.append(part)
        elif isinstance(part, Node) and part.size:
            density = part.linked / part.size
            if part.name == top.name == "article" and density < 0.5 or is_twin(part, top):
                found.append(part)
                continue
            like = part.points >= 0.2 * top.points and density < 0.3 and part.name not in ("ul", "ol")
            reads = part.name == "p" and density < 0.25 and part.size > 80
            title = part.name in ("h1", "h2") and density < 0.3
            if like or reads or title:
                found.append(part)
    return found


def text_of(nodes: list[Node]) -> str:
    """The blocks of the nodes in page order, one on each line."""
    lines: list[str] = []
    waiting: list[Node | str] = list(reversed(nodes))
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            lines.append(node)
            continue
        if is_list_of_links(node):
            continue
        inner: list[Node | str] = []
        run: list[tuple[str, bool]] = []
        for part in node.parts:
            if isinstance(part, Node):
                if line := flat(run):
                    inner.append(line)
                run = []
                inner.append(part)
            else:
                run.append(part)
        if line := flat(run):
            inner.append(line)
        waiting += reversed(inner)
    return "\n".join(lines)


def main_text(html: str | None) -> str:
    """The page's main text: a block on each line, white space in a block as one space; empty if there is none."""
    if not html:
        return ""
    found = text_of(chosen(score(parse(html, LEFT_OUT))))
    if not found:
        # A page whose body is one form has its text there.
        found = text_of(chosen(score(parse(html, LEFT_OUT - {"form", "aside"}))))
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text and n_chars (code points).

    The whole page is parsed, however long, deep or broken it is, in time linear in its
    length; null and empty pages, and those without text, have an empty one. Of equally
    good containers the first is taken. Ids and urls may be null or repeated, and each
    row gives its own. Other columns are ignored.

    A paragraph's points go to LEVELS ancestors. What a class or id names is left out
    where the name is unmistakable (comments, share-buttons); a name that may be text
    (side-effects, form-of-government) only discounts points, and so does one of an
    everyday word (discussion, search-section, side) whose element reads as text: a
    sentence, or a long paragraph, and links for less than half. Outside article and main
    a div or list of such a name is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
