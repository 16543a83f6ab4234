"""Main text of web pages from streaming parser events.

The standard library's parser streams tags and text into lines, one for each block. Every line has a
text-to-tag ratio; the ratios are smoothed along the page with a Gaussian, and lines above a threshold
taken from the page itself are dense. The dense lines are clustered by the containers they stand in: the
article elements if these hold at least half of the dense text, else the innermost container that holds
most of it. Scripts, menus, footers, asides, form controls and what its names call an advert, a notice or
a comment count as lines without text and are left out wherever they stand.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.common import ids, map_texts, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without article text. A form is left out too, unless it is wrapped around the page's content.
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer frame frameset head iframe input label legend map menu meter nav noframes noscript object option progress script select style svg template textarea title video".split())
#: What opens closes these, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end of something else does not close these.
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header main nav ol section table td th ul".split())
REGIONS = frozenset(("article", "main"))
#: What ends where an article begins, if it was left open.
LEFT_OPEN = ("nav", "head", "header", "title")
#: Words in class, id or role that name what is not the article, ...
NAMES = frozenset(
    "ad ads adbox adslot advert advertisement advertisements adverts adsense aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies dialog discussion disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended recommendations related remark remarks replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: ... and words that may stand beside them in a name; another word makes it the name of something else.
BESIDE = frozenset(
    "area article articles bar block blocks body bottom box button buttons center col column container content cta desktop div element fixed form global group head header heading holder icon icons inner item items js left link links list main mobile module news outer page panel policy post posts primary reader readers region right row secondary section site slot sticky stories story strip text thread title top unit user users view wrap wrapper".split()
)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_STOP = re.compile(r"""[>"']""")
_HIDDEN = re.compile(r"display\s*:\s*none")


class _Line:
    """A block of the page: its text, the tags in it, its container, the code points within links."""

    __slots__ = ("linked", "node", "tags", "text")

    def __init__(self, text: str, tags: int, node: int, linked: int):
        self.text, self.tags, self.node, self.linked = text, tags, node, linked


class _Lines(HTMLParser):
    """Streams a page into lines. Work is linear in the page, whatever is left open, unquoted or out of place."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Containers: parent, tag, the form around, whether an article's title or element is in it.
        self.parent, self.tag, self.form = [-1], ["html"], [-1]
        self.titled, self.regional = [False], [False]
        self.frames: list[tuple[list, Counter]] = [([], Counter())]  # open elements, by the container around them
        self.open = Counter()
        self.node = self.skip = self.links = self.linked = self.tags = 0
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.left_out = False
        self.plain_quotes = self.open_comment = False

    # ---- bounded reading of broken markup

    def read(self, page: str) -> None:
        end = page.rfind(">") + 1
        rest = page[end:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page ends in is none
        self.feed(page[:end] + (rest[: cut.start()] if cut else rest))
        self.close()
        self.end_line()

    def _tag_end(self, i: int) -> int:
        """Behind the > of the tag at i. Quotes count behind an = only, and no more once one is found to swallow the page."""
        data = self.rawdata
        at = i + 1
        while not self.plain_quotes and (found := _STOP.search(data, at)):
            at = found.end()
            if found[0] == ">":
                return at
            before = at - 2
            while data[before].isspace():
                before -= 1
            if data[before] == "=":
                at = data.find(found[0], at) + 1
                if not at:
                    break
        self.plain_quotes = True
        return data.find(">", i) + 1 or len(data)

    def parse_starttag(self, i):
        end = self._tag_end(i)
        name = _TAG.match(self.rawdata, i)
        tag = self.lasttag = name[1].lower()
        attrs = []
        for m in _ATTRIBUTE.finditer(self.rawdata, name.end(), end):
            value = m[2]
            attrs.append((m[1].lower(), unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value) if value else value))
        if self.rawdata[end - 2 : end] == "/>":
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return end

    def parse_comment(self, i, report=1):
        end = -1 if self.open_comment else self.rawdata.find("-->", i + 4)
        if end >= 0:
            return end + 3
        self.open_comment = True
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    # ---- events

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            self._close_implied(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        inside = self._inside()
        drop = tag in DROPPED or (bool(attrs) and self._named(tag, attrs)) or (tag == "header" and not inside)
        if not drop and not self.skip and (tag in REGIONS or tag == "h1"):
            self._mark(self.titled if tag == "h1" else self.regional)
        self.open[tag] += 1
        if tag in CONTAINERS:
            self.parent.append(self.node)
            self.tag.append(tag)
            self.form.append(len(self.form) if tag == "form" else self.form[self.node])
            self.titled.append(False)
            self.regional.append(tag in REGIONS)
            self.frames.append(([(tag, drop, self.node)], Counter()))
            self.node = len(self.parent) - 1
        else:
            stack, held = self.frames[-1]
            stack.append((tag, drop, -1))
            held[tag] += 1
        self.skip += drop
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if not self.open[tag]:
            return
        if tag in CONTAINERS:
            while self.frames[-1][0][0][0] != tag:
                self._leave()
            self._leave()
        elif self.frames[-1][1][tag]:
            self._pop(tag)

    def handle_data(self, data):
        if self.skip:
            self.left_out = True
        else:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def end_line(self):
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text or self.left_out:
            self.lines.append(_Line(text, self.tags, self.node, min(self.linked, len(text))))
        self.parts, self.left_out, self.tags, self.linked = [], False, 0, 0

    # ---- open elements

    def _inside(self) -> bool:
        return any(self.open[r] for r in REGIONS)

    def _mark(self, holds: list[bool]) -> None:
        """Of all containers that are open, say that they hold something."""
        node = self.node
        while node >= 0 and not holds[node]:
            holds[node] = True
            node = self.parent[node]

    def _shut(self, item) -> None:
        tag, drop, _ = item
        self.open[tag] -= 1
        self.skip -= drop
        self.links -= tag == "a"

    def _leave(self) -> None:
        """Close the innermost container with all that is open in it."""
        stack, _ = self.frames.pop()
        for item in stack:
            self._shut(item)
        self.node = stack[0][2]

    def _pop(self, tag: str) -> None:
        """Close the last open ``tag`` within the innermost container, with all that is open in it."""
        stack, held = self.frames[-1]
        while True:
            item = stack.pop()
            held[item[0]] -= 1
            self._shut(item)
            if item[0] == tag:
                return

    def _close_implied(self, tag: str) -> None:
        shut = CLOSES[tag] if tag in ("td", "th") else CLOSES.get(tag, frozenset()) | {"p"}
        stack, held = self.frames[-1]
        if any(held[s] for s in shut):
            while True:
                last = stack[-1][0]
                self._pop(last)
                if last in shut:
                    return
        if stack and stack[0][0] in shut and len(self.frames) > 1:
            self._leave()
        elif tag in REGIONS and self.skip:
            for name in LEFT_OPEN:
                if self.open[name] and (name in CONTAINERS or self.frames[-1][1][name]):
                    self.handle_endtag(name)
                    return

    @staticmethod
    def _named(tag: str, attrs) -> bool:
        if tag in ("body", "html", "main"):
            return False
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if value and key in ("class", "id", "role", "data-role"):
                for name in _CAMEL.sub("-", value).lower().split():
                    words = {w for w in _SPLIT.split(name) if w}
                    if words & NAMES and words <= NAMES | BESIDE:
                        return True
            elif value and key == "style" and _HIDDEN.search(value):
                return True
        return False

    # ---- the page as a whole

    def leave_out_forms(self) -> None:
        """Lines in forms count as left out; not so where a form is wrapped around the article, its title or most of the text."""
        sizes = Counter()
        for line in self.lines:
            sizes[self.form[line.node]] += len(line.text)
        total = sum(sizes.values())
        wrapped = {f for f, n in sizes.items() if f < 0 or self.titled[f] or self.regional[f] or 2 * n > total and self.tag[f] == "form" and n >= 200}
        for line in self.lines:
            if self.form[line.node] not in wrapped:
                line.text, line.linked = "", 0


def ratios(lines: list[_Line]) -> np.ndarray:
    """Code points of text for each tag, by line."""
    return np.array([len(x.text) / max(1, x.tags) for x in lines])


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the page; at its ends the weights within the page count."""
    reach = min(int(3 * sigma) + 1, len(values) - 1)
    if reach < 1:
        return values
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weights


def content(page: _Lines, dense: np.ndarray, most: float) -> list[int]:
    """Indexes of the lines that make up the content, given which lines are dense."""
    parent, n = page.parent, len(page.parent)
    total, mass, linked = np.zeros(n), np.zeros(n), np.zeros(n)
    for line, d in zip(page.lines, dense):
        total[line.node] += len(line.text)
        linked[line.node] += line.linked
        if d:
            mass[line.node] += len(line.text)
    region = [-1] * n  # the outermost article or main element around each container
    for i in range(1, n):
        region[i] = region[parent[i]] if region[parent[i]] >= 0 else i if page.tag[i] in REGIONS else -1
    for i in range(n - 1, 0, -1):  # what is inside counts for what is around it
        total[parent[i]] += total[i]
        mass[parent[i]] += mass[i]
        linked[parent[i]] += linked[i]
    if not mass[0]:
        return []
    tops = {r for r in region if r >= 0 and mass[r] > 0}
    if 2 * sum(mass[r] for r in tops) >= mass[0]:
        return [i for i, x in enumerate(page.lines) if x.text and region[x.node] in tops]
    inner: dict[int, list[int]] = {}
    for i in range(1, n):
        if mass[i] > 0:
            inner.setdefault(parent[i], []).append(i)
    root = 0
    while root in inner:
        best = max(inner[root], key=lambda i: (mass[i], -i))
        if mass[best] < most * mass[root] or page.titled[root] > page.titled[best]:
            break
        root = best
    branch = [-1] * n  # the container right below the root around each container
    branch[root] = root
    for i in range(root + 1, n):
        branch[i] = i if parent[i] == root else branch[parent[i]]
    places = [i for i, d in enumerate(dense) if d and branch[page.lines[i].node] >= 0]
    kept = []
    for i, x in enumerate(page.lines):
        b = branch[x.node]
        if b < 0 or not x.text:
            continue
        if b != root and not mass[b] and (2 * linked[b] > total[b] or not places[0] < i < places[-1]):
            continue  # links, or something before or behind the dense lines
        kept.append(i)
    return kept


def main_text(html: str, sigma: float = 1.0, most: float = 0.8) -> str:
    """The blocks of the content regions, one line each; empty if there are none."""
    page = _Lines()
    page.read(html)
    page.leave_out_forms()
    if not page.lines:
        return ""
    ratio = smoothed(ratios(page.lines), sigma)
    dense = (ratio >= min(float(ratio.std()), float(ratio.max()))) & (ratio > 0) & np.array([bool(x.text) for x in page.lines])
    return "\n".join(page.lines[i].text for i in content(page, dense, most))


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sigma: float = 1.0, most: float = 0.8) -> DataFrame:
    """Main text of every page: id, text (empty if none) and n_chars (its code points).

    ``sigma``: width of the smoothing in lines; ``most``: share of the dense text that a container has to hold to be
    gone into. A null page is empty. Broken markup (tags, quotes and comments left open, unknown declarations, cut-off
    pages) is read as far as it goes, in time linear in the page. Repeated rows give a row each; columns other than the
    two named and ``url``, which is passed on if there, are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    url = {"url": df["url"]} if "url" in df.columns else {}

    more = list(url)

    def worker():
        def work(batch: pa.RecordBatch):
            found = [main_text(x, sigma, most) if x else "" for x in texts(batch)]
            extra = [batch.column(batch.schema.get_field_index(k)) for k in more]
            return pa.RecordBatch.from_arrays([ids(batch), *extra, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [id_col, *more, "text", "n_chars"])

        return work

    passed = "url string, " if url else ""
    return map_texts(df, id_col, html_col, worker, f"`{id_col}` {kind}, {passed}text string, n_chars bigint", url)
