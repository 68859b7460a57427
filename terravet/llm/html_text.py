"""Main text of HTML pages by composite text density.

Every node of the tree gets a composite text density: characters per tag, raised for
text outside links and lowered for text inside them.  The sum of the densities of its
children is the density sum of a node; the subtree of the largest sum holds the main
text.  The least density on the path from body to it is the threshold: the densest part
of every other subtree that reaches the threshold is main text as well.  With a chosen
subtree goes the running text (headings, paragraphs, lists) that stands beside it in its
containers below the body.  A chosen subtree inside an article element that is not mostly
links is widened to that element; inside a main element the search stays there.  Menus, page headers, footers,
asides, forms, adverts, notices and comments (by element, role and class name), scripts
and styles take no part.  A form or a class name does not drop a subtree with most of the
text of the page outside links, unless an article or main element keeps a share of it, and
drops nothing where no text would be left.  The same holds for a subtree with the largest
density sum, or with more text than all that the names leave.

Defined results: null or empty html gives an empty text; broken markup is read as far as
it goes, with missing end tags implied, and a comment or tag cut off by the end is left out
(a comment mark inside a script is none); very long pages are read whole; white space inside a block is one space, blocks
are joined in page order by one space; nothing is cut.  Repeated rows give equal results; an empty table gives an empty result; a
column of the table named ``text`` is replaced by the result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, read

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
DROPPED = frozenset("""script style noscript template head title nav footer aside button select option textarea input
iframe svg canvas object audio video dialog menu label fieldset""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu".split())
DROPPED_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored comment
comments commentlist disqus respond replies discussion sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead cookie cookies
consent gdpr notice notices alert notification notifications paywall widget outbrain taboola popup modal newsletter subscribe share sharing social related recommended toolbar pager
pagination login search skip""".split())
ARTICLE_NAMES = frozenset("comment comments ad ads sponsored related".split())
KEPT_ALWAYS = frozenset("html body main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"},
             "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("html body article aside main section div table td th ul ol dl blockquote form header footer nav".split())
CLOSES_P = BLOCKS - {"br", "title", "head", "html", "body", "option", "optgroup", "select", "textarea", "caption",
                     "tbody", "thead", "tfoot", "tr", "td", "th", "legend"}
PART = re.compile(r"[-_]+|[0-9][0-9x]*")
#: A subtree is not dropped for its name if articles keep less than this share of its text.
KEPT_SHARE = 1 / 3
#: Elements of running text: they belong to the main text that they stand beside.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol dl table figure b i em strong span a br hr".split())
#: A comment, or an element whose content is no markup.
OPENER = re.compile(r"<!--|<(script|style|textarea|title)\b", re.IGNORECASE)
CUT_TAG = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/!?")


class Tree(HTMLParser):
    """Nodes in page order; text pieces with the node they belong to, None between blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.drop, self.in_link, self.in_article = ["#"], [0], [False], [False], [False]
        self.named: list[int] = []  # what only a form or a name would drop
        self.pieces: list[tuple[int, str | None]] = []
        self.stack = [0]
        self.open: dict[str, int] = {}

    def _end_from(self, at: int) -> None:
        for node in self.stack[at:]:
            self.open[self.tags[node]] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE)
        if tag in CLOSED_BY:
            scope = {"ul", "ol", "dl", "table"} | ({tag} if tag not in CLOSED_BY[tag] else set())
            while self._close(CLOSED_BY[tag], scope):
                pass
        if tag in BLOCKS:
            self.pieces.append((self.stack[-1], None))
        node = self._node(tag, attrs)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def _node(self, tag, attrs) -> int:
        above = self.stack[-1]
        article = self.in_article[above]
        self.tags.append(tag)
        self.parent.append(above)
        self.in_link.append(self.in_link[above] or tag == "a")
        self.drop.append(self.drop[above] or self._boilerplate(tag, attrs, article))
        if self._named(tag, attrs, article):
            self.named.append(len(self.tags) - 1)
        self.in_article.append(article or tag in ("article", "main"))
        return len(self.tags) - 1

    @staticmethod
    def _boilerplate(tag, attrs, article) -> bool:
        if tag in DROPPED or (tag == "header" and not article):
            return True
        if tag in KEPT_ALWAYS or not attrs:
            return False
        for name, value in attrs:
            if name == "hidden":
                return True
            value = (value or "").lower()
            if name == "aria-hidden" and value == "true" or name == "role" and value in DROPPED_ROLES:
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
        return False

    @staticmethod
    def _named(tag, attrs, article) -> bool:
        """A form, or a whole class name or id that is in the list or put together of names in it."""
        if tag == "form":
            return True
        if tag in KEPT_ALWAYS:
            return False
        for name, value in attrs:
            if name == "role" and (value or "").lower() == "form":
                return True
            if name in ("class", "id"):
                for word in (value or "").lower().split():
                    parts = {p for p in PART.split(word) if p}
                    if tag == "article":
                        if parts and parts <= ARTICLE_NAMES:
                            return True
                    elif parts and parts <= DROPPED_NAMES or not article and word == "header":
                        return True
        return False

    def _close(self, tags, scope) -> bool:
        """Ends the nearest open element of ``tags`` unless an element of ``scope`` is nearer."""
        if not any(map(self.open.get, tags)):
            return False
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[at]]
            if tag in tags:
                self.pieces.append((self.stack[-1], None))
                self._end_from(at)
                return True
            if tag in scope:
                return False
        return False

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.pieces.append((self.stack[-1], None))
        if tag in ("body", "html") or not self.open.get(tag):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[at]] == tag:
                self._end_from(at)
                return

    def handle_data(self, data):
        self.pieces.append((self.stack[-1], data))


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, weighted by the logarithm of their distance from link text."""
    if not chars:
        return 0.0
    tags, linked, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    plain = max(chars - link_chars, 1)
    base = log(chars / plain * linked + body_share * chars + e)
    return chars / tags * log(max(chars / linked * tags / link_tags, 1.0)) / log(base)


def without_open_end(html: str) -> str:
    """``html`` without a comment or tag that its end cuts off; scripts and the like hold no comments."""
    at = 0
    while opened := OPENER.search(html, at):
        name = opened.group(1)
        closing = re.compile(f"</{name}" if name else "-->", re.IGNORECASE).search(html, opened.end())
        if closing is None:
            if name is None:
                return html[:opened.start()]
            break
        at = closing.end()
    at = html.rfind("<")
    if at >= 0 and html.find(">", at) < 0 and html[at + 1:at + 2] in CUT_TAG:
        html = html[:at]
    return html


def measured(tree: Tree, drop: list[bool]) -> tuple[list[int], int, list[float], list[float], list[int], list[bool]]:
    """End of each subtree, body, densities, density sums, the node of the largest sum in each subtree, and which are mostly links."""
    n, parent = len(tree.tags), tree.parent
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.pieces:
        if text and not drop[node]:
            size = len(text) - sum(map(text.count, " \n\t\r"))
            chars[node] += size
            if tree.in_link[node]:
                links[node] += size
    # Children come after their parent, so one pass from the end sums all subtrees.
    last = list(range(1, n + 1))
    for i in range(n - 1, 0, -1):
        up = parent[i]
        last[up] = max(last[up], last[i])
        if not drop[i]:
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + tree.in_link[i]
    body = next((i for i in range(n) if tree.tags[i] == "body"), 0)
    if not chars[body]:
        body = 0
    share = links[body] / max(chars[body], 1)
    density = [0.0 if drop[i] else composite_density(chars[i], tags[i], links[i], link_tags[i], share) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[parent[i]] += density[i]
    # Largest density sum in each subtree, the first in page order among equals.
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = parent[i]
        if sums[best[i]] >= sums[best[up]] and best[up] != up or sums[best[i]] > sums[best[up]]:
            best[up] = best[i]
    return last, body, density, sums, best, [2 * k > c for k, c in zip(links, chars)]


def plain_sums(tree: Tree, drop: list[bool]) -> list[int]:
    """Characters outside links of each subtree, without what is dropped."""
    sums = [0] * len(tree.tags)
    for node, text in tree.pieces:
        if text and not drop[node] and not tree.in_link[node]:
            sums[node] += len(text) - sum(map(text.count, " \n\t\r"))
    for i in range(len(sums) - 1, 0, -1):
        sums[tree.parent[i]] += sums[i]
    return sums


def spread(tree: Tree, roots: set[int]) -> list[bool]:
    """What is dropped if the subtrees of ``roots`` are dropped as well."""
    drop = list(tree.drop)
    for i in range(1, len(drop)):
        drop[i] = drop[i] or drop[tree.parent[i]] or i in roots
    return drop


def dropped(tree: Tree) -> list[bool]:
    """Nodes that take no part; names drop no subtree that holds the main part of the page."""
    if not tree.named:
        return tree.drop
    whole = plain_sums(tree, tree.drop)
    drop = spread(tree, set(tree.named))
    left = plain_sums(tree, drop)
    article = max((left[i] for i, tag in enumerate(tree.tags) if tag in ("article", "main") and not drop[i]), default=0)
    last, body, _, _, best, _ = measured(tree, tree.drop)
    most = max(left[0] + 1, max(whole[i] for i in tree.named))
    main = {i for i in tree.named if article < KEPT_SHARE * whole[i]
            and (2 * whole[i] > whole[0] or whole[i] >= most or i <= best[body] < last[i])}
    if main:
        drop = spread(tree, set(tree.named) - main)
        left = plain_sums(tree, drop)
    return drop if left[0] else tree.drop


def main_text(html: str) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(without_open_end(html).replace("<![", "<!"))
    tree.close()
    n, parent, drop = len(tree.tags), tree.parent, dropped(tree)
    last, body, density, sums, best, linked = measured(tree, drop)
    top = best[body] if sums[best[body]] > 0 else body
    threshold, at = density[top], top
    while at != body and at:
        at = parent[at]
        threshold = min(threshold, density[at])
    chosen, met = bytearray(n), set()

    def inside(node: int, tag: str) -> int:
        """The outermost element of a kind around a node, 0 if there is none."""
        found = 0
        while node:
            if tree.tags[node] == tag and not drop[node]:
                found = node
            node = parent[node]
        return found

    def choose(node: int) -> None:
        chosen[node:last[node]] = b"\1" * (last[node] - node)

    def choose_main(node: int) -> None:
        """The subtree, or the article around it; and the text that its containers below the body hold beside it."""
        article = inside(node, "article")
        if article and not linked[article]:
            choose(article)
            return
        choose(node)
        # A container that was met before is done, and so are those around it.
        while parent[node] not in (0, body) and parent[node] not in met:
            node = parent[node]
            met.add(node)
            chosen[node] = 1
            child = node + 1
            while child < last[node]:
                if tree.tags[child] in TEXT_TAGS and not drop[child] and not linked[child]:
                    choose(child)
                child = last[child]

    choose_main(top)
    scope = inside(top, "main") or body
    i = scope
    while i < last[scope]:
        if drop[i] or chosen[i]:
            i += 1
        elif i == scope or density[i] >= threshold:
            if i != scope and chosen.find(1, i, last[i]) < 0:
                choose_main(best[i] if sums[best[i]] > 0 else i)
            i += 1
        else:
            i = last[i]  # a subtree under the threshold holds no main text
    out, block = [], []
    for node, text in tree.pieces:
        if text is None:
            if block:
                out += "".join(block).split()
                block = []
        elif chosen[node] and not drop[node]:
            block.append(text)
    return " ".join([*out, *"".join(block).split()])


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but the html) and ``text``, the main text of the page."""
    keep = [c for c in pages.columns if c != html] if keep is None else keep

    def make():
        def work(texts: list[str]) -> dict[str, pa.Array]:
            return {"text": pa.array([main_text(t) for t in texts], pa.string())}
        return work

    return per_text(pages, keep, html, "text string", make)


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    made = extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return made.withColumn("n_chars", F.char_length("text").cast("long"))
