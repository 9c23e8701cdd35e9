"""The main content of a page, as Markdown or text: a tree of blocks, scored by their text, and the best subtree without its chrome.

A block is worth the letters it holds itself (with its inline elements, not its inner blocks), less what is linked, times one minus its link
density; short ones without a sentence are worth nothing. What a block is called (tag, class, id) multiplies that up or down. A block's total is its own
worth and a share of its children's totals, so of nested blocks the innermost that holds most of the text wins. Blocks beside the winner that are worth
a fifth of it, and a heading just before it, come along; inside, what is called chrome or consists of links goes.

Edge cases: null and empty pages have no content (empty), nor have pages without a block worth LEAST, unless they call one an article or their main part. Unclosed elements end with their
parent, a paragraph ends where a block begins. A tie goes to the block that begins first. Pages of any length are read whole; one page is one row's
work.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import html

#: Elements that end an open paragraph, elements that hold blocks, and elements whose text is never content.
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
BLOCKS = ENDS_PARAGRAPH - {"hr"} | {"body", "html", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "figcaption"}
UNREAD = {"script", "style", "noscript", "template", "head", "select", "button", "textarea", "svg", "iframe"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CHROME = {"nav", "footer", "header", "aside", "form", "menu"}
#: What names say of a block.
GOOD = re.compile(r"article|content|entry|hentry|main|post|story|text|body|blog", re.IGNORECASE)
BAD = re.compile(r"\bads?\b|\bad-|advert|banner|breadcrumb|comment|cookie|footer|masthead|menu|nav|popup|promo|related|share|sidebar|social|sponsor|subscribe|widget", re.IGNORECASE)
#: What a parent gets of a child's total, letters under which a block without a sentence is worth nothing, and the least worth of content.
SHARE, SHORT, LEAST = 0.7, 25, 25.0


@dataclass
class Block:
    tag: str
    name: str
    start: int
    parent: Block | None
    end: int = 0
    letters: int = 0
    linked: int = 0
    sentences: int = 0
    children: list[Block] = field(default_factory=list)
    total: float = 0.0
    all_letters: int = 0
    all_linked: int = 0

    def called(self) -> float:
        """What tag, class and id say."""
        if self.tag in CHROME:
            return 0.05
        bad, good = bool(BAD.search(self.name)), bool(GOOD.search(self.name)) or self.tag in ("article", "main")
        return 0.2 if bad and not good else 1.5 if good and not bad else 1.0

    def worth(self) -> float:
        if self.tag in HEADINGS or self.letters < SHORT and not self.sentences or not self.letters:
            return 0.0
        plain = self.letters - self.linked
        return plain * plain / self.letters

    def add_up(self) -> None:
        """Totals of a block whose children have theirs."""
        self.total = (self.worth() + SHARE * sum(c.total for c in self.children)) * self.called()
        self.all_letters = self.letters + sum(c.all_letters for c in self.children)
        self.all_linked = self.linked + sum(c.all_linked for c in self.children)

    def is_chrome(self) -> bool:
        """Whether a block inside the content isn't part of it."""
        if self.tag in CHROME:
            return True
        mostly_links = self.all_letters > 0 and self.all_linked > 0.6 * self.all_letters
        return self.called() < 1 or mostly_links and self.tag not in ("p", *HEADINGS)


class _Tree(html._Reader):
    """Blocks and the tags and texts between them, in order."""

    def __init__(self):
        super().__init__()
        self.events: list[tuple[str, str, dict | None]] = []
        self.blocks: list[Block] = []
        self.root = self.at = Block("html", "", 0, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and "p" in self.open:
            self.handle_endtag("p")
        if tag in ("li", "dt", "dd", "td", "th", "tr") and self.open and self.open[-1] == tag:
            self.handle_endtag(tag)
        super().handle_starttag(tag, attrs)

    def begin(self, tag, attrs):
        if tag in BLOCKS:
            block = Block(tag, f"{attrs.get('class', '')} {attrs.get('id', '')}", len(self.events), self.at)
            self.at.children.append(block)
            self.blocks.append(block)
            self.at = block
        self.events.append(("begin", tag, attrs))

    def end(self, tag):
        self.events.append(("end", tag, None))
        if tag in BLOCKS and self.at.parent is not None:
            self.at.end, self.at = len(self.events), self.at.parent

    def handle_data(self, data):
        if UNREAD.intersection(self.open):
            return
        self.events.append(("data", data, None))
        letters = len("".join(data.split()))
        self.at.letters += letters
        self.at.linked += letters * ("a" in self.open)
        self.at.sentences += len(re.findall(r"[.!?…。！？](?:\s|$)", data))


def content(page: str | None) -> list[tuple[str, str, dict | None]]:
    """Tags and texts of the main content, in order."""
    tree = _Tree().read(page)
    for block in reversed(tree.blocks):
        block.end = block.end or len(tree.events)
        block.add_up()
    best = max(tree.blocks, key=lambda b: b.total, default=None)
    tree.root.end = len(tree.events)
    named = max((b for b in tree.blocks if b.tag in ("article", "main") and b.all_letters > b.all_linked), key=lambda b: b.all_letters, default=None)
    if best is None or best.total < LEAST:
        if named is None and tree.root.worth() < LEAST:
            return []
        kept = [named or tree.root]  # little text that the page calls its content, or text outside any block
    else:
        around = best.parent.children
        at = next(k for k, b in enumerate(around) if b is best)
        near = lambda k, b: b is best or not b.is_chrome() and (b.total >= 0.2 * best.total or k == at - 1 and b.tag in HEADINGS)
        kept = [b for k, b in enumerate(around) if near(k, b)]
    found: list[tuple[str, str, dict | None]] = []

    for block in kept:
        spans, waiting = [], [*block.children]
        while waiting:  # chrome at any depth goes; pages may nest deeper than calls can
            inner = waiting.pop()
            if inner.is_chrome():
                spans.append((inner.start, inner.end))
            else:
                waiting += inner.children
        at = block.start
        for start, end in sorted(spans):
            found += tree.events[at:start]
            at = end
        found += tree.events[at : block.end]
    return found


def replay(reader: html._Reader, events: list[tuple[str, str, dict | None]]) -> html._Reader:
    """Reads a page's tags and texts again."""
    for kind, what, attrs in events:
        if kind == "begin":
            reader.begin(what, attrs)
            if what not in html.VOID:
                reader.open.append(what)
        elif kind == "end":
            reader.handle_endtag(what)
        else:
            reader.handle_data(what)
    return reader


def parse_main_text(page: str | None) -> str:
    """The main content as words between single blanks."""
    parts = [what if kind == "data" else " " if what in BLOCKS or what == "br" else "" for kind, what, _ in content(page)]
    return " ".join("".join(parts).split())


def parse_main_markdown(page: str | None) -> str:
    made = "".join(replay(html._Markdown(), content(page)).parts)
    return re.sub(r"\n{3,}", "\n\n", made).strip()


@F.pandas_udf(T.StringType())
def main_text(page: pd.Series) -> pd.Series:
    return page.map(parse_main_text)


@F.pandas_udf(T.StringType())
def main_markdown(page: pd.Series) -> pd.Series:
    return page.map(parse_main_markdown)


html.register_extractor("readability", "1", main_markdown)
