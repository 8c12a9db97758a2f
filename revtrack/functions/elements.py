"""Elements of a page by structure, and selectors over them.

Which end tag belongs to which start tag is a stack, which column expressions only give in quadratic time. So this one step
runs in Arrow batches: a pass over the tags gives the table of elements, selectors are conditions on it, and what comes
back are the pieces of the page that a post is made of. All that is made of them (titles, urls, days, files) are columns.

Cases: a null page has no rows; end tags that may be left out (`li`, `tr`, `td`, `p`, ...) close by the next start tag, others by the
end of what is around them, at last by the end of the page; end tags without a start are skipped; comments, scripts and styles hold no elements.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The functions below travel to the executors by value, so none needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
# A slash that ends the tag, not an unquoted value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z|^[^=]*/\Z")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Start tag -> the open elements it ends, and those that shield what is around them.
_PARTS, _TABLE = ("thead", "tbody", "tfoot"), ("table",)
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("td", "th", "tr"), _TABLE + _PARTS),
    **{part: (("td", "th", "tr", *_PARTS), _TABLE) for part in _PARTS},
    **{block: (("p",), ("div", "li", "td", "th", "button", "article", "section", "table", "body")) for block in _BLOCKS},
}


class Element:
    """An element's name, its attributes as written, the element around it, its place among siblings and in the page, and where it begins and ends."""

    __slots__ = ("tag", "written", "parent", "nth", "place", "start", "inner", "end", "children", "_attributes")

    def __init__(self, tag, written, parent, nth, place, start, inner, end):
        self.tag, self.written, self.parent, self.nth, self.place = tag, written, parent, nth, place
        self.start, self.inner, self.end = start, inner, end
        self.children, self._attributes = 0, None

    def get(self, name: str) -> str | None:
        if not self.written:
            return None
        if self._attributes is None:
            self._attributes = {}
            for key, double, single, bare in _ATTRIBUTE.findall(self.written):
                value = double or single or bare
                self._attributes.setdefault(key.lower(), unescape(value) if "&" in value else value)
        return self._attributes.get(name)


def elements(page: str) -> list[Element]:
    """All elements in document order; `end` is where the end tag begins, or what ended the element."""
    found: list[Element] = []
    open_: list[Element] = []
    roots = at = 0
    whole, search = len(page), _TAG.search

    def close(down_to: int, where: int) -> None:
        for e in open_[down_to:]:
            e.end = where
        del open_[down_to:]

    while match := search(page, at):
        shut, name, written, shut_, name_, written_ = match.groups()
        start, at = match.span()
        if not name:
            if not name_:
                continue
            shut, name, written = shut_, name_, written_
        name = name.lower()
        if shut:
            if open_ and open_[-1].tag == name:
                open_.pop().end = start
                continue
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].tag == name:
                    close(k, start)
                    break
                if open_[k].tag == "table":  # nothing but its own end tag ends a table
                    break
            continue
        if name in _ENDS:
            ended, shields = _ENDS[name]
            outermost = None
            for k in range(len(open_) - 1, -1, -1):
                tag = open_[k].tag
                if tag in shields:
                    break
                if tag in ended:
                    outermost = k
            if outermost is not None:
                close(outermost, start)
        parent = open_[-1] if open_ else None
        if parent is None:
            roots += 1
            nth = roots
        else:
            parent.children = nth = parent.children + 1
        e = Element(name, written, parent, nth, len(found), start, at, whole)
        found.append(e)
        if name in _EMPTY or written.endswith("/") and _CLOSED.search(written):
            e.end = at
        elif name in _RAW:
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            e.end = at = stop.start() if stop else whole
        else:
            open_.append(e)
    return found


class Page:
    """The elements of a page, by tag and by class where that is asked for."""

    def __init__(self, found: list[Element]):
        self.found = found
        self.tags: dict[str, list[Element]] = {}
        for e in self.found:
            self.tags.setdefault(e.tag, []).append(e)
        self._classes: dict[str, list[Element]] | None = None

    @property
    def classes(self) -> dict[str, list[Element]]:
        if self._classes is None:
            self._classes = {}
            for e in self.found:
                if e.written and (names := e.get("class")):
                    for name in set(names.split()):
                        self._classes.setdefault(name, []).append(e)
        return self._classes

    def likely(self, step: tuple) -> list[Element]:
        """Elements that may fit a step of a selector, in document order."""
        if step[3]:
            return min((self.classes.get(c, []) for c in step[3]), key=len)
        return self.tags.get(step[1], []) if step[1] else self.found


# ---- selectors --------------------------------------------------------------------------------

_NAME = r"[A-Za-z_][A-Za-z0-9_-]*"
_ATTR = rf"\[\s*{_NAME}\s*(?:[*^$~]?=\s*(?:\"[^\"\]]*\"|'[^'\]]*'|[A-Za-z0-9_-]+)\s*)?\]"
_SIMPLE = rf"(?:[.#]{_NAME}|{_ATTR}|:first-child)"
_COMPOUND = rf"(?:(?:{_NAME}|\*){_SIMPLE}*|{_SIMPLE}+)"
# Tags, classes, ids, attributes and first children; descendants (blank) and children (>). The same in Java and Python.
SELECTOR = rf"\s*{_COMPOUND}(?:(?:\s*>\s*|\s+){_COMPOUND})*\s*"


def is_selector(selector: Column) -> Column:
    """Whether a selector is one that can be read; null and empty select nothing and are fine."""
    return F.coalesce(selector.rlike(f"^(?:{SELECTOR})?$"), F.lit(True))


def compiled(selector: str) -> tuple:
    """Steps `(is child, tag, ids, classes, attribute tests, first child)` of a selector, outermost first."""
    if not re.fullmatch(SELECTOR, selector):
        raise ValueError(f"Unknown selector: {selector}")
    steps = []
    for child, compound in re.findall(rf"(>?)\s*({_COMPOUND})", selector):
        tag = re.match(rf"{_NAME}|\*", compound)
        parts = re.findall(_SIMPLE, compound[tag.end() :] if tag else compound)
        tests = [re.fullmatch(rf"\[\s*({_NAME})\s*(?:([*^$~]?)=\s*[\"']?(.*?)[\"']?\s*)?\]", p).groups() for p in parts if p[0] == "["]
        steps.append((
            child == ">", "" if not tag or tag[0] == "*" else tag[0].lower(), [p[1:] for p in parts if p[0] == "#"], {p[1:] for p in parts if p[0] == "."},
            [(name.lower(), how, value) for name, how, value in tests], ":first-child" in parts,
        ))
    return tuple(steps)


def _fits(e: Element, step: tuple) -> bool:
    _, tag, ids, classes, tests, first = step
    if tag and e.tag != tag or first and e.nth != 1:
        return False
    if classes and not classes.issubset((e.get("class") or "").split()) or any(e.get("id") != i for i in ids):
        return False
    for name, how, value in tests:
        has = e.get(name)
        if has is None or value is not None and not (
            (has == value) if not how else bool(value) and (
                value in has if how == "*" else has.startswith(value) if how == "^" else has.endswith(value) if how == "$" else value in has.split()
            )
        ):
            return False
    return True


def selected(found: Page | list[Element], selector: str | tuple) -> list[Element]:
    """Elements that a selector chooses, in document order."""
    page = found if isinstance(found, Page) else Page(found)
    held: set[int] = set()  # places of what the steps so far have chosen
    chosen: list[Element] = []
    for k, step in enumerate(compiled(selector) if isinstance(selector, str) else selector):
        under: dict[int, bool] = {}  # by place, whether an element, or one around it, is held

        def around(e: Element | None) -> bool:
            met = []
            while e is not None and e.place not in under and e.place not in held:
                met.append(e.place)
                e = e.parent
            has = e is not None and (e.place in held or under[e.place])
            under.update(dict.fromkeys(met, has))
            return has

        chosen = [
            e for e in page.likely(step)
            if _fits(e, step) and (not k or e.parent is not None and (e.parent.place in held if step[0] else around(e.parent)))
        ]
        if not chosen:
            return []
        held = {e.place for e in chosen}
    return chosen


# ---- rows of a listing ------------------------------------------------------------------------

# --- fixed values: the usual layouts, the first that has rows counts ---
LAYOUTS = (
    "table.board_list tbody tr", "table.bbsList tbody tr", ".board_list li", ".bbs_list li", ".board-list-wrap > ul > li", "table tbody tr",
)
_FIELDS = ("title", "link", "field", "cells", "files")
_POST = "array<struct<title:string,link:string,field:string,cells:array<string>,files:array<string>>>"


def _pieces(html: str, usual: list[tuple], rows: tuple, title: tuple, date: tuple, link: tuple) -> Iterator[tuple]:
    """Per row of a listing what `_FIELDS` name."""
    page = Page(elements(html))
    lines: list[Element] = next(filter(None, (selected(page, s) for s in ([rows] if rows else usual))), [])
    if not lines:
        return

    def placed(of: list[Element]) -> tuple[list[Element], list[int]]:
        return of, [e.start for e in of]

    titles, dates, linked = (placed(selected(page, s) if s else []) for s in (title, date, link))
    anchors, cells = (placed(page.tags.get(tag, [])) for tag in ("a", "td"))

    def inside(row: Element, of: tuple[list[Element], list[int]]) -> Element | None:
        k = bisect_left(of[1], row.inner)
        return of[0][k] if k < len(of[0]) and of[1][k] < row.end else None

    def within(row: Element, of: tuple[list[Element], list[int]]) -> list[Element]:
        return of[0][bisect_right(of[1], row.start) : bisect_left(of[1], row.end)]

    def opened(e: Element | None) -> str | None:
        return None if e is None else html[e.start : e.inner]

    for row in lines:
        links = within(row, anchors)
        head = inside(row, titles) or (links[0] if links else None)
        around = head
        while around is not None and around.tag != "a":
            around = around.parent
        day = inside(row, dates)
        yield (
            None if head is None else html[head.start : head.end], opened(inside(row, linked) or around),
            None if day is None else html[day.inner : day.end],
            [] if date else [html[e.inner : e.end] for e in within(row, cells)],
            [href for e in links if (href := e.get("href")) and href.lower().endswith(".pdf")],
        )


def _listing(pages: pa.Array, rows: pa.Array, titles: pa.Array, dates: pa.Array, links: pa.Array) -> pa.Array:
    how = list(zip(*(s.to_pylist() for s in (rows, titles, dates, links))))
    usual = [compiled(s) for s in LAYOUTS]
    known: dict[tuple, list[tuple]] = {}
    posts: list[tuple] = []
    ends, missing = [0], []
    for page, asked in zip(pages.to_pylist(), how):
        if asked not in known:
            clean = [(s or "").strip() for s in asked]
            known[asked] = [compiled(s) if s else () for s in clean]
        if page is not None:
            posts.extend(_pieces(page, usual, *known[asked]))
        ends.append(len(posts))
        missing.append(page is None)
    columns = list(zip(*posts)) or [()] * len(_FIELDS)
    kinds = [pa.string()] * 3 + [pa.list_(pa.string())] * 2
    flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_FIELDS)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(missing, pa.bool_()))


def listing_rows(html: Column, rows: Column, title: Column, date: Column, link: Column) -> Column:
    """Per row the html of its title, the opening tag of its link, its date field or cells, and its `.pdf` links.

    The selectors are columns; a null or empty one means the usual: the first layout that has rows, the first link, the first
    cell that begins with a date, the link around the title.
    """
    # Marked so that Spark evaluates it once, where it stands: an explode would else ask it again in a filter below.
    return F.arrow_udf(_listing, _POST).asNondeterministic()(html, *(s.cast("string") for s in (rows, title, date, link)))
