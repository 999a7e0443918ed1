"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of text blocks in page order. Each paragraph gives points for its length
and its commas, discounted by the share of its text inside links, to the element that holds it and, ever less, to that
element's ancestors. The element with the most points is the main container; it is kept together with siblings that
score well themselves, and what is left of them without boilerplate elements is the article.

Names of elements tell boilerplate from articles. Those of comments and some tags, such as nav and footer, do so for sure.
Others, such as those of adverts, notices and menus, and forms, are suspects: they go unless they hold most of the page's
text and it is prose, as where a form or a layout is wrapped around the page. Others still, such as related or
discussion, only lower the score of their text, and the element goes if it isn't prose. Of what is kept, lists of links go.

Pages are read from left to right in a time in proportion to their length, whatever is left open in them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?|\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

#: Elements of raw text: without an end tag, they last to the end of the page, as in browsers.
_RAW = {"script", "style", "title", "textarea"}
#: Elements left out up to their end tag. Without one they end at the next block, or with the element around them.
_FRAME = {"iframe", "noframes", "noscript"}
_NESTED = {"svg", "math", "select", "object", "template", "button", "label"}
_LOOSE = _FRAME | _NESTED
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_FRAME_TAG = {tag: re.compile(rf"<(/?){tag}(?:[\s/][^<>]*)?>", re.I) for tag in _FRAME}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_LEAF = {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "summary", "address"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BOX = {"html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "details", "center", "hgroup"}
_CLUTTER = {"nav", "footer", "aside", "menu", "dialog", "head"}
_FORMS = {"form", "fieldset"}
_BLOCK = _LEAF | _HEADING | _BOX | _CLUTTER | _FORMS | {"header", "hr"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html"}
_SEMANTIC = {"article", "main"}
#: Words of class, id and role of readers' comments: they mark an element as no part of the article for sure.
_COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
#: Words of class, id and role that mark an element as no part of the article.
_CLUTTER_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar "
    "sidebar footer masthead contentinfo "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login paywall "
    "share sharing social".split()
)
#: Words that may as well stand for a part of the article: the element stays if it is prose.
_DOUBTFUL_WORDS = frozenset("aside widget related recommended popular trending complementary search discussion reviews".split())
#: The weight of text in doubtful elements, the length of a block of prose and its largest share of links, and the share of prose.
_DOUBTFUL, _PROSE, _LINKS, _MOSTLY = 0.3, 80, 0.25, 0.6
#: The share of the page's text that a suspect must hold to stay: one with other words in its name, and any other one.
_WEAK_SUSPECT, _SUSPECT = 0.5, 0.75
#: A list of links has so many blocks, such a share of links, and no prose.
_LISTED, _LIST_LINKS = 4, 0.75
#: First words of names that say how an element is laid out, and words for the article itself.
_LAYOUT_WORDS = frozenset({"has", "with", "without", "no", "is"})
#: Words that add nothing to a name: "ad-slot" is an advert as much as "ad".
_PLAIN_WORDS = frozenset("area bar block box container inner list outer panel section slot unit wrap wrapper zone".split())
_BODY_WORDS = frozenset({"article", "content", "body", "text", "main", "post", "entry", "story"})
_PARTS = re.compile(r"[^a-z0-9]+")


def _hidden(attributes: str) -> bool:
    """Whether an attribute is named hidden, or the style takes the element out of the page."""
    return any((name := (m[1] or "").lower()) == "hidden" or name == "style" and _NO_DISPLAY.search(m[2] or "") for m in _ATTRIBUTE.finditer(attributes))


def _raw_end(source: str, tag: str, at: int) -> int | None:
    """Where the raw text that begins at ``at`` ends with its end tag; None for a frame that another follows first."""
    if tag in _RAW:
        closed = _RAW_END[tag].search(source, at)
        return closed.end() if closed else len(source)
    following = _FRAME_TAG[tag].search(source, at)
    return following.end() if following and following[1] else None


class _Tokens:
    """Comments, declarations and tags of a page by place. A tag ends at the first '>' outside quotes; one that never does is text."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self._asked, self._special = 0, -2  # where the next '>' or quote stands for all places from _asked on
        self._failed: set[int] = set()  # quotes from which no end of a tag is reached

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, '/' of an end tag, name, attributes) of the first from ``at``; comments have no name."""
        source = self.source
        while (begin := source.find("<", at)) >= 0:
            if begin > self.last or source.startswith("<!--", begin):
                if (begin := source.find("<!--", begin)) < 0:
                    return None
                end = source.find("-->", begin + 4)
                return begin, len(source) if end < 0 else end + 3, "", "", ""
            if source[begin + 1 : begin + 2] in ("!", "?"):
                return begin, source.find(">", begin) + 1, "", "", ""
            if (tag := _TAG.match(source, begin)) and (end := self._end(tag.end())) >= 0:
                return begin, end + 1, tag[1], tag[2].lower(), source[tag.end() : end]
            at = begin + 1
        return None

    def _next_special(self, at: int) -> int:
        found = _SPECIAL.search(self.source, at)
        return found.start() if found else -1

    def _end(self, at: int) -> int:
        if self._special == -2 or not self._asked <= at <= self._special and self._special != -1:
            self._asked, self._special = at, self._next_special(at)
        place, passed = self._special, []
        while place >= 0 and place not in self._failed:
            if self.source[place] == ">":
                return place
            passed.append(place)
            closing = self.source.find(self.source[place], place + 1)
            place = self._next_special(closing + 1) if closing >= 0 else -1
        self._failed.update(passed)
        return -1


def _nested_ends(source: str) -> dict[int, int]:
    """Where the elements of _NESTED end that have an end tag of their own, by where their start tags end.

    The end tag of a block around such an element comes first where its own is missing.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    at, tokens = 0, _Tokens(source)
    while token := tokens.after(at):
        _, at, closing, tag, attributes = token
        if tag in _RAW or tag in _FRAME:
            if not closing and not attributes.endswith("/"):
                at = _raw_end(source, tag, at) or at
        elif tag not in _NESTED and tag not in _BLOCK or tag in _VOID:
            continue
        elif not closing:
            if tag in _BLOCK or not attributes.endswith("/"):
                stack.append((tag, at))
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            name = ""
            while name != tag:
                name, begun = stack.pop()
                opened[name] -= 1
            if tag in _NESTED:
                ends[begun] = at
    return ends


class _Page:
    """Elements of a page by number, 0 being the root, and its text blocks."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["html"], [0], [False]
        #: the nearest doubtful element around each, itself included, or -1
        self.doubtful = [-1]
        #: the share of the page's text that an element must hold to stay
        self.needs = [0.0]
        #: (element, text, characters in links)
        self.blocks: list[tuple[int, str, int]] = []
        #: the open elements, where in this list those of each name stand, and where its blocks do
        self._stack, self._places, self._block_places = [0], {"html": [0]}, [0]
        self._text: list[str] = []
        self._linked, self._in_link = 0, 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, ends, tokens = 0, None, _Tokens(source)
        while token := tokens.after(at):
            begin, end, closing, tag, attributes = token
            self._add(source[at:begin])
            at = end
            if not tag:
                continue
            if closing:
                self._end(tag)
            elif tag in _RAW or tag in _LOOSE:
                if attributes.endswith("/"):
                    continue
                if tag in _NESTED:
                    ends = _nested_ends(source) if ends is None else ends
                    end = ends.get(at)
                else:
                    end = _raw_end(source, tag, at)
                if end is None:
                    self._start(tag, attributes)
                else:
                    at = end
            else:
                self._start(tag, attributes)
        self._add(source[at:])
        self._flush()

    def _add(self, piece: str) -> None:
        if piece and not self.dropped[self._stack[-1]]:
            piece = html.unescape(piece) if "&" in piece else piece
            self._text.append(piece)
            if self._in_link:
                self._linked += len(piece)

    def _flush(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.blocks.append((self._stack[self._block_places[-1]], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _is_open(self, tags: set[str]) -> bool:
        return any(self._places.get(x) for x in tags)

    def _last(self, tags: set[str]) -> int:
        """Where the innermost open element of these names stands, or -1."""
        return max((own[-1] for x in tags if (own := self._places.get(x))), default=-1)

    def _close_to(self, wanted: set[str], barriers: set[str]) -> None:
        place = self._last(wanted)
        if place > 0 and place >= self._last(barriers - wanted):
            self._cut(place)

    def _cut(self, i: int) -> None:
        for e in reversed(self._stack[i:]):
            tag = self.tags[e]
            self._places[tag].pop()
            if tag in _BLOCK:
                self._block_places.pop()
            elif tag == "a":
                self._in_link -= 1
        del self._stack[i:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._flush()
            if self._is_open(_LOOSE):
                self._cut(min(own[0] for x in _LOOSE if (own := self._places.get(x))))
            if self._places.get("p"):
                self._close_to({"p"}, _SCOPE | {"li", "td", "th", "dd", "blockquote"})
            if tag in _CLOSES:
                self._close_to(_CLOSES[tag], {"ul", "ol", "dl", "table"} | ({"tr"} if tag in ("td", "th") else set()))
        elif tag == "br":
            self._text.append(" ")
        if tag in _VOID:
            return
        above = self._stack[-1]
        clutter, need, doubt = (False, 0.0, False) if self.dropped[above] else self._named(tag, attributes)
        self.tags.append(tag)
        self.parents.append(above)
        self.dropped.append(self.dropped[above] or clutter)
        self.needs.append(need)
        self.doubtful.append(len(self.tags) - 1 if doubt else self.doubtful[above])
        self._places.setdefault(tag, []).append(len(self._stack))
        if tag in _BLOCK:
            self._block_places.append(len(self._stack))
        self._stack.append(len(self.tags) - 1)
        self._in_link += tag == "a"

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if own := self._places.get(tag):
            # an inline end tag closes nothing outside its block
            if own[-1] > 0 and (tag in _BLOCK or own[-1] > self._block_places[-1]):
                self._cut(own[-1])

    def _named(self, tag: str, attributes: str) -> tuple[bool, float, bool]:
        """Whether an element is no part of an article, the share of the page's text it must hold to be one, and whether it may be none."""
        semantic = self._is_open(_SEMANTIC)
        if tag in _CLUTTER or tag in _LOOSE or tag == "header" and not semantic:
            return True, 0.0, False
        need, doubt = _SUSPECT if tag in _FORMS else 0.0, False
        if tag in ("html", "body") or not attributes.strip():
            return False, need, False
        if _HIDDEN.search(attributes) and _hidden(attributes):
            return True, 0.0, False
        for match in _NAMES.finditer(attributes):
            for name in (match[1] or match[2] or match[3] or "").lower().split():
                parts = [x for x in _PARTS.split(name) if x]
                if tag in _SEMANTIC:  # these hold articles, or a reader's comment
                    if name in _COMMENT_WORDS:
                        return True, 0.0, False
                    need = _SUSPECT if name in _CLUTTER_WORDS else need
                elif parts and parts[0] not in _LAYOUT_WORDS:
                    # a name's last word says what the element is ("post-comments"), its first what it belongs to
                    begins = parts[-1] not in _BODY_WORDS
                    if parts[-1] in _COMMENT_WORDS or parts[0] in _COMMENT_WORDS and begins and not semantic:
                        return True, 0.0, False
                    if parts[-1] == "header" and not semantic and parts[0] not in _BODY_WORDS:
                        return True, 0.0, False
                    own = [x for x in parts if x not in _PLAIN_WORDS]
                    if own and _CLUTTER_WORDS.issuperset(own):
                        need = _SUSPECT
                    elif parts[-1] in _CLUTTER_WORDS or parts[0] in _CLUTTER_WORDS and begins and not semantic:
                        need = max(need, _WEAK_SUSPECT)
                    doubt |= parts[-1] in _DOUBTFUL_WORDS or parts[0] in _DOUBTFUL_WORDS | _CLUTTER_WORDS and begins
        return False, need, doubt

    def _sums(self) -> list[list[int]]:
        """Of each element with all inside it: text outside links, text in links, text of prose blocks, blocks."""
        sums = [[0, 0, 0, 0] for _ in self.tags]
        for element, text, linked in self.blocks:
            own = sums[element]
            own[0] += len(text) - linked
            own[1] += linked
            own[2] += len(text) if len(text) >= _PROSE and linked < _LINKS * len(text) else 0
            own[3] += 1
        for e in range(len(self.tags) - 1, 0, -1):  # an element's number is greater than its parent's
            above, own = sums[self.parents[e]], sums[e]
            for i in range(4):
                above[i] += own[i]
        return sums

    def _leave_out(self, gone: list[bool]) -> None:
        """Leave out the blocks of these elements and of all inside them."""
        for e in range(1, len(self.tags)):
            gone[e] = gone[e] or gone[self.parents[e]]
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def _judge(self) -> None:
        """Leave out suspects, but for those that hold most of the page's text, which is prose for the most part."""
        if any(self.needs):
            sums = self._sums()
            self._leave_out([need > 0 and (own[0] < need * sums[0][0] or own[2] < _MOSTLY * own[0] or not own[2]) for need, own in zip(self.needs, sums)])

    def _unlist(self) -> None:
        """Leave out lists of links, unless nothing else is there."""
        sums = self._sums()
        lists = [self.tags[e] in _BOX and own[3] >= _LISTED and not own[2] and own[1] >= _LIST_LINKS * (own[0] + own[1]) for e, own in enumerate(sums)]
        if any(lists) and not lists[0]:
            self._leave_out(lists)

    def _settle(self) -> None:
        """Leave out the text of doubtful elements that isn't prose for the most part."""
        sizes: dict[int, list[int]] = {}
        for element, text, linked in self.blocks:
            own = sizes.setdefault(self.doubtful[element], [0, 0])
            own[0] += len(text)
            own[1] += len(text) if len(text) >= _PROSE and linked < _LINKS * len(text) else 0
        gone = {e for e, (size, prose) in sizes.items() if e >= 0 and prose < _MOSTLY * size}
        self.blocks = [b for b in self.blocks if self.doubtful[b[0]] not in gone]

    def scores(self) -> dict[int, float]:
        points: dict[int, float] = {}
        for element, text, linked in self.blocks:
            if self.tags[element] in _HEADING:
                continue
            gained = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text)) * min(1.0, len(text) / 25)
            gained *= 1.0 if self.doubtful[element] < 0 else _DOUBTFUL
            holder = self.parents[element] if self.tags[element] in _LEAF else element
            for level in range(5):
                points[holder] = points.get(holder, 0.0) + gained / (1, 2, 4, 6, 8)[level]
                if holder == 0:
                    break
                holder = self.parents[holder]
        return points

    def kept(self) -> set[int]:
        """The main container and the siblings that belong to it."""
        points = self.scores()
        if not points:
            return {0}
        best = max(points, key=lambda e: (points[e], -e))
        over = best
        while over and self.tags[over] not in _SEMANTIC:
            over = self.parents[over]
        best = over or best
        if best == 0:
            return {0}
        chosen, share = {best}, 0.2 * points[best]
        lengths: dict[int, list[int]] = {}
        for element, text, linked in self.blocks:
            if self.parents[element] == self.parents[best]:
                total = lengths.setdefault(element, [0, 0])
                total[0], total[1] = total[0] + len(text), total[1] + linked
        for e in [*points, *lengths]:
            if e and self.parents[e] == self.parents[best] and e not in chosen:
                size, linked = lengths.get(e, (0, 0))
                # of articles side by side, short ones count as well
                enough = share if over and self.tags[e] == self.tags[over] else max(10.0, share)
                if points.get(e, 0) >= enough or self.tags[e] == "p" and size > 80 and linked < size / 4 or self.tags[e] in ("h1", "h2") and not over:
                    chosen.add(e)
        return chosen

    def main_text(self) -> str:
        self._judge()
        self._settle()
        self._unlist()
        chosen, inside = self.kept(), {}
        for e in range(len(self.tags)):
            inside[e] = e in chosen or e > 0 and inside[self.parents[e]]
        return "\n".join(text for element, text, _ in self.blocks if inside[element])


def main_text(source: str | None) -> str:
    """The article of one page."""
    return _Page(source).main_text() if source else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null, empty or text-less html gives the text '' and n_chars 0; null ids and urls pass through; repeated rows come out
    as often as they come in. Other columns are not read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInPandas(read, "page_id long, url string, text string, n_chars long")
