"""Main text of web pages by consensus paths of their hosts.

Every page scores its containers and votes for the path of its best one, a chain of tags and classes without numbers. The
votes are added up by host in Spark; then each page is read again at its host's winning path, and at its own best container
where the path leads nowhere.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle
from citadex.sizes import BROADCAST_ROWS, broadcast_if, fits

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|textarea|svg|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*+(?:>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td html center blockquote".split())
#: An opening tag of the key ends an open one of the value, within the nearest of the bounds.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_BOUND = frozenset("ul ol dl table article section div body main nav aside footer header form select td th".split())
DROPPED = frozenset("nav aside footer form button select dialog menu search head".split())
#: Words that mark what is not the article, as whole class or role tokens or joined with ``NEUTRAL`` ones: those that always do,
#: and those that do where links or shortness agree.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored cookie cookies consent gdpr comment comments commentlist commentform"
    " respond replies disqus nav navbar breadcrumb breadcrumbs masthead footer sidebar complementary contentinfo navigation newsletter".split()
)
SUSPECT = frozenset(
    "menu menubar aside promo promotion banner notice notices alert popup modal overlay subscribe subscription signup login reply discussion share"
    " sharing social related recommended recommendations widget widgets toolbar pagination pager paywall skip search searchform topbar".split()
)
NEUTRAL = frozenset(
    "bar block body bottom box button buttons container content element group holder icon icons inner item items label left line link links list"
    " mobile module outer panel popular post posts region right row section side site slot text thread title top unit wrap wrapper".split()
)
#: Elements that such words can mark; headings, paragraphs and inline elements are text wherever they stand.
MARKED = frozenset("div section aside ul ol dl table header footer nav form details dialog center figure fieldset iframe span".split())
PAGE_HEADER = frozenset("header topbar pageheader siteheader".split())
HINT = frozenset("article content post entry story main body text page".split())
#: Evidence against a suspect: so large a share of its text is links, or it has no more characters than this.
LINKED, SHORT = 0.3, 300
#: A winning path counts on a page if it leads to nearly all of what the page's own best container holds.
COVERED = 0.9


@dataclass
class Node:
    tag: str
    path: int
    parent: int
    in_article: bool
    #: 2: dropped whatever it holds; 1: dropped if what it holds agrees.
    doubt: int = 0
    hint: bool = False
    dropped: bool = False
    first: int = 0
    last: int = 0
    chars: int = 0
    link_chars: int = 0


def _doubt(tokens: list[str]) -> int:
    """2 if a token marks what is never the article, 1 if it may, 0 else."""
    most = 0
    for token in tokens:
        parts = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", re.sub(r"\d+", "", token)) if w]
        low = [w.lower() for w in parts]
        if low and all(w in ALWAYS or w in SUSPECT or w in NEUTRAL for w in low):
            most = max(most, 2 if any(w in ALWAYS for w in low) else 1 if any(w in SUSPECT for w in low) else 0)
    return most


def _named(attrs: str) -> tuple[list[str], list[str], str, bool]:
    """Tokens of class and role; a whole id; the generalised class; whether the element is hidden."""
    if not attrs:
        return [], [], "", False
    bare = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs, re.I))
    if "=" not in attrs:
        return [], [], "", bare
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    classes = found.get("class", "").split()
    general = ".".join(sorted(re.sub(r"\d+", "#", c.lower()) for c in classes[:3]))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden") == "true" or bare
    return classes + found.get("role", "").split(), found.get("id", "").split(), general, hidden


class Page:
    """The containers of a page and its text in page order; every tag is looked at a bounded number of times."""

    def __init__(self, source: str) -> None:
        self.nodes = [Node("html", 0, -1, False)]
        #: Paths as (path above, step), by number; 0 is the page.
        self.steps: dict[tuple[int, str], int] = {}
        self.names: list[tuple[int, str]] = [(-1, "")]
        self.parts: list[str] = []
        self.stack, self.open = [0], Counter()
        self.links = 0
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self.parts.append(" ")
            if tag in VOID:
                continue
            if m["close"]:
                if tag == "a":
                    self.links = max(0, self.links - 1)
                if self.open[tag]:
                    while self.nodes[self.stack[-1]].tag != tag:
                        self._close()
                    self._close()
                continue
            if tag in ("html", "body") and self.open[tag]:
                continue
            if tag in BLOCK:
                self._imply(tag)
            if tag == "a":
                self.links += 1
            self._open(tag, m["attrs"])
        if at < len(source):
            self._text(source[at:])
        while self.stack:
            self._close()

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if n := len(text.strip()):
            node = self.nodes[self.stack[-1]]
            node.chars += n
            node.link_chars += n if self.links else 0

    def _open(self, tag: str, attrs: str) -> None:
        at = self.stack[-1]
        parent = self.nodes[at]
        tokens, ids, general, hidden = _named(attrs)
        inside = parent.in_article or tag in ("article", "main")
        doubt = 2 if hidden or tag in DROPPED else 0
        if not doubt and tag in MARKED:
            # A whole id may make suspect, a slug says what a part is about.
            doubt = max(_doubt(tokens), min(1, _doubt([i for i in ids if i.isalpha()])))
            if not inside and (tag == "header" or any(t.lower() in PAGE_HEADER for t in tokens + ids)):
                doubt = 2
        step = tag if tag == "body" else (f">{tag}" + (f".{general}" if general else "") if tag in CONTAINER and tag != "html" else "")
        self.nodes.append(Node(tag, self._step(parent.path, step) if step else parent.path, at, inside, doubt, any(w.lower() in HINT for t in tokens + ids for w in re.split(r"[-_]", t)), first=len(self.parts)))
        self.stack.append(len(self.nodes) - 1)
        self.open[tag] += 1

    def _step(self, path: int, step: str) -> int:
        key = (path, step)
        if key not in self.steps:
            self.steps[key] = len(self.names)
            self.names.append(key)
        return self.steps[key]

    def path_name(self, path: int) -> str:
        """A path in words, from the page down."""
        out = []
        while path > 0:
            path, step = self.names[path]
            out.append(step)
        return "".join(reversed(out))

    def path_number(self, name: str) -> int:
        """The number of a path in words, -1 if the page has none such."""
        path = 0
        for step in re.findall(r"^[^>]+|>[^>]*", name):
            path = self.steps.get((path, step), -1)
        return path

    def _close(self) -> None:
        """End the innermost open element, judge it, and add up what it keeps."""
        node = self.nodes[self.stack.pop()]
        node.last = len(self.parts)
        self.open[node.tag] -= 1
        node.dropped = node.doubt == 2 or node.doubt == 1 and (node.chars <= SHORT or node.link_chars >= LINKED * node.chars)
        if node.parent >= 0 and not node.dropped:
            above = self.nodes[node.parent]
            above.chars += node.chars
            above.link_chars += node.link_chars

    def _imply(self, tag: str) -> None:
        """End what an opening tag ends: an open paragraph, the item, row or cell before."""
        ends = {*CLOSES.get(tag, "").split(), "p"}
        while any(self.open[t] for t in ends):
            for depth in range(len(self.stack) - 1, 0, -1):
                open_tag = self.nodes[self.stack[depth]].tag
                if open_tag in ends:
                    while len(self.stack) > depth:
                        self._close()
                    break
                if open_tag in _BOUND:
                    return
            else:
                return
            if open_tag != "p" or not CLOSES.get(tag):
                return

    def score(self, node: Node) -> float:
        """Share of the page's kept text that is no link, weighed by what kind of container it is."""
        total = self.nodes[0].chars
        if not total or node.dropped or node.tag not in CONTAINER:
            return 0.0
        kind = {"article": 2.0, "main": 1.6, "body": 0.6, "html": 0.5}.get(node.tag, 1.3 if node.hint else 1.0)
        return kind * (node.chars - 0.8 * node.link_chars) / total

    def best(self) -> Node:
        """The best container; none inside what is dropped counts."""
        below = [False] * len(self.nodes)
        top, most = self.nodes[0], (self.score(self.nodes[0]), 0)
        for i, n in enumerate(self.nodes):
            below[i] = n.dropped or n.parent >= 0 and below[n.parent]
            if not below[i] and (found := (self.score(n), -n.first)) > most:
                top, most = n, found
        self.below = below
        return top

    def at(self, path: int) -> list[Node]:
        """Kept containers at a path; ``best`` has been asked before."""
        return [n for i, n in enumerate(self.nodes) if n.path == path and n.tag in CONTAINER and not self.below[i]]

    def text(self, nodes: list[Node]) -> str:
        """Kept text of the nodes in page order, white space as one blank."""
        gone = sorted((n.first, n.last) for n in self.nodes if n.dropped)
        out, at, g = [], 0, 0
        for n in sorted(nodes, key=lambda n: n.first):
            at = max(at, n.first)
            out.append(" ")
            while at < n.last:
                while g < len(gone) and gone[g][1] <= at:
                    g += 1
                if g < len(gone) and gone[g][0] <= at:
                    at = gone[g][1]
                    continue
                end = min(n.last, gone[g][0]) if g < len(gone) else n.last
                out += self.parts[at:end]
                at = end
        return " ".join("".join(out).split())


def extract(source: str | None, path: str | None) -> str:
    """The main text of one page, read at ``path`` if that leads to nearly all of its own best container, or to more."""
    if not source:
        return ""
    page = Page(source)
    best = page.best()
    number = page.path_number(path) if path is not None else best.path
    if number >= 0 and number != best.path:
        there = page.at(number)
        if sum(n.chars for n in there) >= max(1.0, COVERED * best.chars):
            return page.text(there)
    return page.text(page.at(best.path))


def host(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def consensus(pages: DataFrame) -> DataFrame:
    """host, path: the container path that most of a host's votes go to; of equal ones the first by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, votes = [], [], []
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if source:
                    page = Page(source)
                    best = page.best()
                    if (vote := page.score(best)) > 0:
                        hosts.append(h)
                        paths.append(page.path_name(best.path))
                        votes.append(vote)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.float64())], ["host", "path", "vote"])

    votes = arrow_map(pages.select(host().alias("host"), "html"), run, "host string, path string, vote double")
    # Votes as whole millionths add up alike in any order.
    sums = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1e6).cast("long")).alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    text is empty for null or empty html and where nothing but menus, notices and the like is found; n_chars counts code
    points. Pages without a host share one vote. Repeated rows give repeated results; other columns do not matter.
    """
    winners = settle(consensus(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(source, path) for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    keyed = pages.select("page_id", "url", "html", host().alias("host"))
    read = keyed.join(broadcast_if(fits(winners, BROADCAST_ROWS), winners), "host", "left").select("page_id", "url", "html", "path")
    return arrow_map(read, run, "page_id long, url string, text string, n_chars long")
