"""Leaf blocks of an HTML page, with their text and features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

N_FEATURES = 1 << 12
#: Elements nest no deeper, as in browsers: a start tag beyond opens nothing, and its text stays.
MAX_DEPTH = 512
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile("[>\"']")
NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
# fixed values: names of HTML elements
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template svg iframe select textarea button title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: elements and class or id words that mark a page's furniture or its main part
FURNITURE_TAGS = set("nav footer aside form menu dialog head".split())
FURNITURE_WORDS = set(
    "ad ads advert advertisement banner bar breadcrumb breadcrumbs byline comment comments cookie cookies copyright disqus footer"
    " form header masthead menu modal nav navbar navigation newsletter notice pagination popup promo recommended related replies reply"
    " respond share sharing sidebar social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
MAIN_WORDS = set("article content entry main post story text body".split())
MAIN_TAGS = {"article", "main"}


class _Tags:
    """Ends of tags; ``>`` inside quotes ends none. The time for a page is in proportion to its length.

    A tag whose quotes leave it open to the page's end finishes at its first ``>`` instead. The
    places where such tags open a quote are kept, as a tag that gets to one of them stays open too.
    """

    def __init__(self, html: str) -> None:
        self.html, self.open_at, self.next = html, set(), -1

    def _stop(self, at: int) -> int:
        m = STOP.search(self.html, at)
        return m.start() if m else len(self.html)

    def end(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``, or -1."""
        html, passed = self.html, []
        if self.next < at:
            self.next = self._stop(at)
        i = self.next
        while i < len(html) and html[i] != ">":
            close = -1 if i in self.open_at else html.find(html[i], i + 1)
            passed.append(i)
            if close < 0:
                i = len(html)
            else:
                i = self._stop(close + 1)
        if i < len(html):
            return i + 1
        self.open_at.update(passed)
        return html.find(">", at) + 1 or -1


def _tokens(html: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of everything but text; name is empty for what has no tag of its own."""
    tags, at, shut = _Tags(html), html.find("<"), html.rfind(">")
    while 0 <= at < shut or (at >= 0 and html.startswith(("<!--", "<![CDATA["), at)):
        name = NAME.match(html, at + 1)
        end, label, rest = -1, "", ""
        if name:
            end = tags.end(name.end())
            label, rest = name.group().lower(), html[name.end() : end - 1] if end > 0 else ""
            if end > 0 and label in RAW:
                close = re.compile(f"</{label}\\s*>", re.I).search(html, end)
                end, label, rest = close.end() if close else len(html), "", ""
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3 if html.find("-->", at + 4) >= 0 else len(html)
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at) + 3 if html.find("]]>", at) >= 0 else len(html)
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at) + 1 or -1
        if end > 0:
            yield at, end, label, rest
        at = html.find("<", max(end, at + 1))


class Frame:
    """An open element with what it and its ancestors stand for."""

    __slots__ = ("bad", "inline", "last", "main", "numbers", "tag", "tags", "words")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Frame | None) -> None:
        self.tag, self.inline, self.numbers = tag, tag in INLINE, {}
        above = (frozenset(), frozenset(), "", False, False) if parent is None else (parent.tags, parent.words, parent.last, parent.main, parent.bad)
        self.tags, self.words, self.last, self.main, self.bad = above
        if not self.inline:
            self.last = tag
            self.main = self.main or tag in MAIN_TAGS
            self.bad = self.bad or (self.main and tag in FURNITURE_TAGS)
            if tag not in self.tags:
                self.tags = self.tags | {tag}
        if tag not in ("html", "body") and not self.words.issuperset(words):
            self.words = self.words.union(words)


NOWHERE = Frame("span", (), None)


def placed(tags: str, words: str = "") -> Frame:
    """The frame below a path of tags, outermost first; ``words`` are class words of the last."""
    frame, path = None, tags.split()
    for i, t in enumerate(path):
        frame = Frame(t, tuple(words.split()) if i + 1 == len(path) else (), frame)
    return frame or NOWHERE


def blocks(html: str) -> list[dict]:
    """Blocks in page order: text, frame (see ``Frame``) and linked characters."""
    out: list[dict] = []
    stack: list[Frame] = []
    open_: Counter = Counter()  # open elements by tag
    inner: list[Counter] = [Counter()]  # open inline elements by tag, since each open block
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append({"text": text, "frame": stack[-1] if stack else NOWHERE, "linked": linked})
        parts.clear()
        linked = 0

    def pop() -> None:
        frame = stack.pop()
        open_[frame.tag] -= 1
        if frame.inline:
            inner[-1][frame.tag] -= 1
        else:
            inner.pop()

    def text(lo: int, hi: int) -> None:
        nonlocal linked
        if hi > lo:
            parts.append(html[lo:hi])
            if links:
                linked += hi - lo

    at = 0
    for start, end, tag, rest in _tokens(html):
        text(at, start)
        at = end
        closing, tag = tag.startswith("/"), tag.lstrip("/")
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            # an inline end tag does not close blocks, and a block's end closes what is inside it
            if (inner[-1] if tag in INLINE else open_)[tag] > 0:
                while stack[-1].tag != tag:
                    pop()
                pop()
        elif tag not in VOID and not rest.endswith("/"):
            if tag not in INLINE:
                # a paragraph, or a list item, ends where the next block starts
                while stack and stack[-1].inline and open_["p"] > 0:
                    pop()
                while stack and (stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                    pop()
            if tag == "a":
                links += 1
            if len(stack) < MAX_DEPTH:
                words = tuple(w for a, b, c in NAMED.findall(rest) for w in WORD.findall((a or b or c).lower())) if "=" in rest else ()
                frame = Frame(tag, words, stack[-1] if stack else None)
                stack.append(frame)
                open_[tag] += 1
                if frame.inline:
                    inner[-1][tag] += 1
                else:
                    inner.append(Counter())
    text(at, len(html))
    flush()
    return out


def is_marked(block: dict) -> bool:
    """Whether the page's own markup puts a block in its main part."""
    frame = block["frame"]
    return frame.main and not frame.bad and not (frame.words & FURNITURE_WORDS)


def _of_frame(frame: Frame, hide_main: bool) -> frozenset:
    """Feature numbers that a block has from its place, found once for a frame."""
    if hide_main not in frame.numbers:
        main = MAIN_TAGS & frame.tags
        names = [f"last:{'heading' if re.fullmatch('h[1-6]', frame.last) else frame.last}"]
        if FURNITURE_TAGS & frame.tags or frame.words & FURNITURE_WORDS or ("header" in frame.tags and not main):
            names.append("furniture")
        elif not hide_main:
            names += [f"in:{t}" for t in main]
            if main or frame.words & MAIN_WORDS:
                names.append("main")
        # one use of a training page has the general features alone
        if not hide_main:
            names += [f"in:{t}" for t in frame.tags - MAIN_TAGS] + [f"word:{w}" for w in frame.words - MAIN_WORDS]
        frame.numbers[hide_main] = frozenset(map(_number, names))
    return frame.numbers[hide_main]


def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % N_FEATURES


def features(page: list[dict], hide_main: bool = False) -> list[list[int]]:
    """Feature numbers of each block. ``hide_main`` leaves out the names of elements and classes."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        text = b["text"]
        size = len(text.split())
        names = ["bias", f"size:{min(9, size.bit_length())}", f"link:{min(4, 4 * b['linked'] // (len(text) + 1))}", f"end:{text[-1] if text[-1] in '.!?:;|' else 'other'}"]
        names.append(f"place:{min(3, 4 * i // n)}")
        if sum(c.isupper() for c in text) * 5 > len(text) * 2:
            names.append("capitals")
        if sum(c.isdigit() for c in text) * 5 > len(text):
            names.append("digits")
        if "©" in text or "|" in text or "»" in text:
            names.append("marks")
        out.append(sorted(_of_frame(b["frame"], hide_main).union(map(_number, names))))
    return out
