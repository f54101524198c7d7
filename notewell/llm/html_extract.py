"""Main text of web pages by consensus on container paths.

Each page's containers are scored by the text they hold outside links and side
matter. The best container's path of generalised tag-class steps is a vote; a
host's votes are summed in Spark, and its pages are extracted again with the
paths that won, in the order of their votes. A page that has none of them uses
the containers with its own best path.

Elements such as nav and footer are side matter. Names such as "sidebar" are
only a sign of it: an element with such a name, and a form, counts as content
if it holds an article, or, on a page without one elsewhere, most of the text. A page is read in one pass
whose time grows with its length, however deep or broken its markup is.

Defined results: a null html is the empty page, whose text is empty; a null url
has the host of the empty url; repeated rows give a row each; an empty table
gives no rows; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.llm.frames import written

LEAST_SHARE = 0.01
"""Of a host's votes; paths with less don't win, so a host has 100 winning paths at most."""
MOST_OF_PAGE = 3
"""An element with the name of side matter, on a page without article, is content if it has more than this many times the text beside it."""
LEAST_PART = 1e-3
"""Of a block's weight; containers so far out that they would get less of it get none."""
LONG_PATH = 1000

# Elements of HTML by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "select", "xmp", "noembed", "noframes"}
SIDE = {"nav", "header", "footer", "aside", "button", "menu", "dialog", "head", "label", "fieldset"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# Elements whose opening ends an open paragraph or the sibling before.
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul": "li", "ol": "li", "dl": "dt dd", "table": "tr td th"}

_SIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|notice\w*|gdpr|alert|popup|modal|newsletter|subscri\w*|"
    r"signup|login|share|sharing|social|comments?|respond|disqus|replies|reply|related|recommend\w*|pager|pagination|widget\w*|toolbar|skip\w*|copyright|legal|hidden)(?:$|[\s_-])",
    re.I,
)
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|respond|disqus|replies|reply)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
# Outside quotes a tag has no "<": so each character is read once or twice, also where tags don't end.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACES = re.compile(r"\s+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#]*)"


class _Element:
    """An open or closed element; of a container, where its text is and how much of it counts."""

    __slots__ = ("tag", "box", "link", "side", "named", "outer", "readers", "holds", "size", "beside", "dropped", "path", "score", "first", "last", "outer_box")

    def __init__(self, tag: str, box: _Element | None, named: _Element | None) -> None:
        self.tag, self.box, self.named = tag, box, named  # the nearest container, and the nearest element with a name of side matter, itself included
        self.link = self.side = self.readers = self.holds = self.dropped = False
        self.outer: _Element | None = None  # of a named one: the next named one around it
        self.size = self.beside = 0
        self.path, self.score, self.first, self.last, self.outer_box = "", 0.0, 0, 0, None


def _step(tag: str, attributes: str) -> tuple[str, bool, str]:
    """The generalised tag-class step of an element, whether it is side matter by its role, and its names."""
    if "=" not in attributes and "hidden" not in attributes:
        return tag, False, ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    names = " ".join(found.get(k, "") for k in ("class", "id")).strip()
    side = found.get("role", "").lower() in _ROLES or re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) is not None
    side = side or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "") == "true"
    own = re.sub(r"\d+", "#", found.get("class", "") or found.get("id", ""))
    return (f"{tag}.{'.'.join(sorted(set(own.lower().split())))}" if own else tag), side, names


def _path(parent: str, step: str) -> str:
    if len(parent) > LONG_PATH:
        parent = hashlib.md5(parent.encode("utf-8", "surrogatepass")).hexdigest()
    return f"{parent}/{step}" if parent else step


class _Page:
    """Reads a page once, from left to right."""

    def __init__(self, page: str) -> None:
        self.open: list[_Element] = []
        self.count: Counter[str] = Counter()  # open elements by tag
        self.boxes: list[_Element] = []
        self.named: list[_Element] = []
        self.blocks: list[tuple[str, int, _Element | None]] = []  # text, characters in links, innermost element
        self.piece: list[str] = []
        self.side = self.link = self.linked = 0
        self.holds = False  # an article that no named element is around
        self._read(page)
        self._close(0)
        self._flush()

    def _flush(self) -> None:
        if self.piece:
            text = _SPACES.sub(" ", html.unescape("".join(self.piece))).strip()
            self.piece.clear()
            if text:
                inner = self.open[-1] if self.open else None
                self.blocks.append((text, self.linked, inner))
                if inner is not None and inner.named is not None:
                    inner.named.size += max(0, len(text) - self.linked)
        self.linked = 0

    def _close(self, n: int) -> None:
        """Ends the elements from the n-th on."""
        while len(self.open) > n:
            e = self.open[-1]
            if e.tag not in INLINE:
                self._flush()
            e.last = len(self.blocks)
            self.open.pop()
            self.count[e.tag] -= 1
            self.side -= e.side
            self.link -= e.link
            if e.named is e and e.outer is not None:
                e.outer.size += e.size
                e.outer.holds |= e.holds

    def _end_of(self, tags: set[str], fence: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element of these tags, unless a container of such lists stands before it."""
        if not any(self.count[t] for t in tags):
            return
        for n in range(len(self.open) - 1, -1, -1):
            tag = self.open[n].tag
            if tag in tags:
                self._close(n)
                return
            if tag in fence or tag in CONTAINERS:
                return

    def _end(self, tag: str) -> None:
        if self.count[tag]:
            self._close(next(n for n in range(len(self.open) - 1, -1, -1) if self.open[n].tag == tag))
        elif tag in ("p", "br"):
            self._flush()

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end_of({"p"})
        if tag in SIBLINGS:
            self._end_of(SIBLINGS[tag], tuple(FENCES))
        if tag not in INLINE:
            self._flush()
        step, side, names = _step(tag, attributes)
        around = self.open[-1] if self.open else None
        e = _Element(tag, around.box if around else None, around.named if around else None)
        if tag in ("article", "main"):
            if e.named is not None:
                e.named.holds = True
            self.holds |= e.named is None
        elif tag not in ("html", "body"):
            # A header inside the article holds its headline.
            e.side = side or tag in SIDE and not (tag == "header" and (self.count["article"] or self.count["main"]))
            if not e.side and (tag == "form" or names and _SIDE_NAME.search(names)):
                e.outer, e.named, e.readers = e.named, e, bool(_READERS.search(names))
                self.named.append(e)
        e.first, e.link = len(self.blocks), tag == "a"
        self.side += e.side
        self.link += e.link
        if tag in CONTAINERS and not self.side:
            e.path, e.outer_box, e.box = _path(e.box.path if e.box else "", step), e.box, e
            self.boxes.append(e)
        self.open.append(e)
        self.count[tag] += 1

    def _read(self, page: str) -> None:
        at = 0
        while True:
            found = _MARKUP.search(page, at)
            text = page[at : found.start()] if found else page[at:]
            if text and not self.side:
                self.piece.append(text)
                if self.link:
                    self.linked += len(text.strip())
            if not found:
                return
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
            elif tag in RAW and not found[3].rstrip().endswith("/"):
                end = _ENDS[tag].search(page, at)
                after = page.find(">", end.start()) if end else -1
                at = len(page) if after < 0 else after + 1
                if tag not in INLINE:
                    self._flush()
            elif tag not in VOID:
                self._begin(tag, found[3])
            elif tag in ("br", "hr") and not self.side:
                self.piece.append(" ") if tag == "br" else self._flush()

    def judged(self) -> list[bool]:
        """Whether each block is content, by the named elements that it is in."""
        beside = sum(max(0, len(t) - linked) for t, linked, e in self.blocks if e is None or e.named is None)
        own = {id(e): e.size for e in self.named}
        for e in self.named:
            if e.outer is not None:
                own[id(e.outer)] -= e.size
        for e in self.named:  # outer ones first
            e.dropped = e.outer is not None and e.outer.dropped
            around = beside if e.outer is None else e.outer.beside
            if not e.dropped:
                most = e.size > 0 == around if e.readers else e.size > MOST_OF_PAGE * around
                e.dropped = not e.holds and (self.holds or not most)
            e.beside = around + own[id(e)]
        return [e is None or e.named is None or not e.named.dropped for _, _, e in self.blocks]


def parse(page: str) -> tuple[list[str], list[_Element]]:
    """Blocks of text outside side matter in page order, and the containers with the blocks they span."""
    read = _Page(page)
    content = read.judged()
    before = [0, *accumulate(content)]
    for (text, linked, inner), counts in zip(read.blocks, content, strict=True):
        weight, share = max(0.0, len(text) - 1.0 * linked), 1.0
        box = inner.box if inner is not None and counts else None
        while box is not None and share >= LEAST_PART:
            box.score += share * weight
            share *= 0.9
            box = box.outer_box
    boxes = [b for b in read.boxes if b.named is None or not b.named.dropped]
    for box in boxes:
        box.first, box.last = before[box.first], before[box.last]
        box.score *= 1.5 if box.tag in ("article", "main") else 1.0
    return [text for (text, _, _), counts in zip(read.blocks, content, strict=True) if counts], boxes


def best(boxes: list[_Element]) -> _Element | None:
    """The container with the highest score; of equal ones the last, which is the inner one."""
    return max(reversed(boxes), key=lambda b: b.score, default=None) if any(b.score > 0 for b in boxes) else None


def extract(page: str, paths: list[str]) -> str:
    """The text of the first path that has any, of all containers with it, or of the page's own best container."""
    blocks, boxes = parse(page)
    by_path: dict[str, list[_Element]] = {}
    for box in boxes:
        if box.score > 0:
            by_path.setdefault(box.path, []).append(box)
    for path in paths:
        if path in by_path:
            chosen = by_path[path]
            break
    else:
        own = best(boxes)
        chosen = by_path[own.path] if own else []
    if not chosen:
        return " ".join(blocks)
    out, done = [], 0
    for box in chosen:  # in page order; an inner one lies within what is done
        out += blocks[max(done, box.first) : box.last]
        done = max(done, box.last)
    return " ".join(out)


def _votes(batches):
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if box := best(parse(page)[1]):
                hosts.append(host)
                paths.append(box.path)
                scores.append(box.score)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's paths with a share of its votes, best first. pages has host and html."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    shared = counted.withColumn("all", F.sum("votes").over(Window.partitionBy("host"))).where(F.col("votes") >= LEAST_SHARE * F.col("all"))
    return shared.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def _texts(batches):
    for batch in batches:
        texts = [extract(page, paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    paths = written(winning_paths(rows))
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
