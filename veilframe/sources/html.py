"""Elements of raw pages: a small parser turns each page into node rows, Spark makes elements of them.

``nodes`` parses whole pages in Arrow batches, one row per tag, with its kind and the texts that it refers to in its page:
its label's, its option's, its column's header. Everything else is expressions and windows over these rows: which of its
labels counts, its value, whether it stands for itself, its row and number. Nodes are numbered in document order and know the
last node below them, so what stands below a node is a range of numbers, and counts of what stands before both ends say
which of a kind are inside (``inside``).

Broken markup is read as browsers do in the common cases: unknown end tags are ignored, an open paragraph,
list item, option or table cell ends where the next begins, what is never closed ends with the page, a declaration
that is none is a comment. Time is linear in a page's length, however deep its nodes are.
Null and empty pages have no nodes. Nothing is known of layout, so no element is left out for its place.
Names of tags and attributes are lower-cased; of a repeated attribute the first counts; of a repeated id the
first node.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.tables import spread, written

# Fixed values.
SKIPPED = ("script", "style", "noscript", "template", "meta", "link", "title", "head")
BUTTON_INPUTS = ("submit", "button", "reset", "image")
IMAGES = ("img", "svg", "canvas", "video", "picture")
TEXTS = (
    *("h1", "h2", "h3", "h4", "h5", "h6", "p", "label", "span", "li", "td", "th", "legend", "figcaption"),
    *("strong", "em", "small", "dt", "dd", "summary", "caption", "output", "div", "b", "i", "u", "mark", "time"),
    *("abbr", "cite", "address", "blockquote", "pre", "code", "section", "article", "header", "footer", "aside"),
    *("nav", "main", "font", "center", "big", "sub", "sup", "ins", "del", "q", "s", "bdi", "data"),
)
ROWS, ROW_ROLES, CHROME = ("tr", "li", "article"), ("row", "listitem"), ("nav", "header", "footer")
MOST_VALUE, MOST_LABEL = 200, 120
HAS_VALUE = "[has value]"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CELLS = frozenset(("td", "th"))
#: Start tags that end an open element, and the elements beyond which they don't look.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "option": (("option",), ("select",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
_BLOCKS = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Nodes whose whole text may be asked for, beside those that a label refers to by their id.
_WHOLE = frozenset(("label", "button", "a", "option", "textarea", "th", "td"))
_WHOLE_ROLES = frozenset(("button", "columnheader"))
#: Roles of grids that are built without tables.
GRIDS, GRID_CELLS, GRID_ROW, GRID_HEADER = ("table", "grid", "treegrid"), ("cell", "gridcell"), "row", "columnheader"
_GRID_ROLES = {**dict.fromkeys(GRIDS, "grid"), **dict.fromkeys(GRID_CELLS, "grid_cell"), GRID_ROW: "grid_row"}
#: Tags of nodes that change what those below them inherit, and of nodes that refer to others or are referred to.
_MOVES = frozenset(("table", "thead", "tr", "td", "th", "label", "select", *CHROME, *ROWS))
_REFERRED = frozenset(("label", "option", "td", "th"))
_REFERRED_ROLES = frozenset((*GRIDS, *GRID_CELLS, GRID_HEADER))
_SPEAKING = frozenset(TEXTS)
_SPACE = " \t\n\x0b\f\r"  # what \s is to Spark
_SPACES = re.compile(f"[{_SPACE}]+")
_BEGUN = re.compile("<[A-Za-z/!?]")
#: Tags whose content is no markup.
_RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())
#: What stands between < and > of start and end tags as most pages write them; all others, and those whose content is no markup, are left to the parser of the library.
_START = re.compile(r'([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][-A-Za-z0-9]*="[^"<>&]*")*)[ \t\n]*/?')
_END = re.compile(r"/([A-Za-z][A-Za-z0-9]*)")
_ATTR = re.compile(r'([A-Za-z][-A-Za-z0-9]*)="([^"]*)"')
#: Tags are remembered by their text, and the trees of pages by their tags, as sites repeat them: how many, and of what length at most.
_SOME_TAGS, _SHORT_TAG, _SOME_PAGES, _SHORT_PAGE = 4_096, 200, 128, 8_192
#: Of so many pages at a time, those with one tree are taken together if there are many, up to so many texts; and how often
#: on average a text may be in what is asked of such pages.
_CHUNK, _MANY, _TEXTS, _SPANS = 10_000, 16, 200_000, 8
#: Pages that are turned into nodes at a time, and nodes that are sent on at a time: they bound what a Python worker holds.
_PAGES, _BATCH = 32, 5_000

#: What a node inherits from its nearest ancestors: their numbers, which for those of its own kind are its own.
_NEAREST = ("label", "row", "select", "table", "line", "cell", "holder", "grid", "grid_row", "grid_cell")
_OUTSIDE = {"skip": False, "chrome": False, **dict.fromkeys(_NEAREST), "head": False, "lines": None, "cells": None}
#: A node's numbers and texts, what kind of element it is, if any, then what it refers to in its page: its label's number
#: and text, the texts that aria-labelledby names, a select's option, the header of the column it is in.
NODE = pa.struct(
    [("node", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own", pa.string()), ("whole", pa.string()), ("row", pa.int32())]
    + [("element_type", pa.string()), ("label", pa.int32()), ("label_text", pa.string()), ("labelled", pa.string()), ("chosen", pa.string()), ("header", pa.string())]
)
_DDL = "node int, last int, tag string, attrs map<string,string>, own string, whole string, row int, element_type string, label int, label_text string, labelled string, chosen string, header string"


class _Tag(NamedTuple):
    """A start tag, and what follows from it alone."""

    name: str
    attrs: dict[str, str]
    skipped: bool
    block: bool
    void: bool
    ends: tuple | None
    moves: bool
    whole: bool
    refers: bool
    kind: str | None
    speaking: bool


def _start(name: str, attrs: dict[str, str]) -> _Tag:
    role = attrs.get("role")
    return _Tag(
        name,
        attrs,
        skipped=name in SKIPPED,
        block=name in _BLOCKS,
        void=name in _VOID,
        ends=_ENDS.get(name),
        moves=name in _MOVES or role in ROW_ROLES or role in _GRID_ROLES,
        whole=name in _WHOLE or "contenteditable" in attrs or role in _WHOLE_ROLES,
        refers=name in _REFERRED or "id" in attrs or "aria-labelledby" in attrs or role in _REFERRED_ROLES,
        kind=(kind := _kind(name, attrs)),
        speaking=kind is None and name in _SPEAKING,
    )


def _kind(name: str, attrs: dict[str, str]) -> str | None:
    """input, button, image or null, whatever the node says; others are text if they are of TEXTS and say something."""
    if name == "input":
        declared = attrs.get("type", "").lower()
        return None if declared == "hidden" else "button" if declared in BUTTON_INPUTS else "input"
    if name in ("textarea", "select") or attrs.get("contenteditable") == "true":
        return "input"
    if name == "button" or (name == "a" and "href" in attrs) or attrs.get("role") == "button":
        return "button"
    return "image" if name in IMAGES else None


def _read_tag(tag: str) -> _Tag | str | None:
    """A start tag, the name of an end tag, or None if the tag is not as most are."""
    if met := _END.fullmatch(tag):
        return met[1].lower()
    if (met := _START.fullmatch(tag)) and (name := met[1].lower()) not in _RAW:
        return _start(name, {k.lower(): v for k, v in reversed(_ATTR.findall(met[2]))})
    return None


_known_tag = lru_cache(_SOME_TAGS)(_read_tag)


def _plain(tag: str) -> _Tag | str | None:
    return _known_tag(tag) if len(tag) <= _SHORT_TAG else _read_tag(tag)


class _Reader(HTMLParser):
    """The tags of a page that is not plain, each with the text before it: a start tag, the name of an end tag, or None between two texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[_Tag | str | None] = []
        self.texts: list[str] = []
        self.text = ""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # what browsers make of any "<!["

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, 0)
        return end if end >= 0 else len(self.rawdata)  # one that never ends takes the rest, and is looked for once

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines

    def parse_starttag(self, i: int) -> int:
        met = _START.match(self.rawdata, i + 1)
        if not met or not self.rawdata.startswith(">", met.end()) or (tag := _plain(met[0])) is None:
            return super().parse_starttag(i)
        self._add(tag)
        return met.end() + 1

    def parse_endtag(self, i: int) -> int:
        met = None if self.cdata_elem else _END.match(self.rawdata, i + 1)
        if not met or not self.rawdata.startswith(">", met.end()):
            return super().parse_endtag(i)
        self._add(met[1].lower())
        return met.end() + 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._add(_start(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._add(tag)

    def handle_data(self, data: str) -> None:
        if self.text:
            self._add(None)
        self.text = data

    def _add(self, tag: _Tag | str | None) -> None:
        self.texts.append(self.text)
        self.tags.append(tag)
        self.text = ""


class _Tree:
    """The nodes that a sequence of tags makes, and which of them refers to which, whatever the texts between the tags say.

    There is a text before each tag and one behind the last; ``owner`` has the node that each belongs to (those of none are
    ``dropped``), and those below a node are the ones from its ``begun`` to its ``upto``. An open node is its tag, its number and what its children
    inherit; ``places`` has the open ones of each tag. Each tag is opened and closed once: nothing is looked for along the open nodes.
    """

    def __init__(self, tags: Iterable[_Tag | str | None]):
        self.tags: list[_Tag] = []
        self.nears: list[dict] = []
        self.last: list[int] = []
        self.begun: list[int] = []
        self.upto: list[int] = []
        self.row: list[int | None] = []
        self.referring: list[int] = []
        self.owner: list[int | None] = []
        self.open: list[tuple[str, int | None, dict]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        opened, owner, places = self.open, self.owner, self.places
        for tag in tags:
            owner.append(opened[-1][1] if opened else None)
            if isinstance(tag, str):
                if at := places.get(tag):
                    self._close(at[-1])
            elif tag is not None:
                self._begin(tag)
        owner.append(opened[-1][1] if opened else None)
        self._close(0)
        self.dropped = [k for k, node in enumerate(self.owner) if node is None]
        self._refer()
        del self.nears, self.referring, self.open, self.places

    def _close(self, at: int) -> None:
        """Ends the open nodes from place ``at`` on."""
        opened, places, last, upto = self.open, self.places, len(self.tags) - 1, len(self.owner)
        while len(opened) > at:
            name, node, _ = opened.pop()
            places[name].pop()
            if node is not None:
                self.last[node], self.upto[node] = last, upto

    def _nearest(self, names: tuple[str, ...]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def _begin(self, tag: _Tag) -> None:
        if tag.block and (at := self.places.get("p")):
            self._close(at[-1])
        if tag.ends:
            own, limit = map(self._nearest, tag.ends)
            if own > limit:
                self._close(own)
        near = below = self.open[-1][2] if self.open else _OUTSIDE
        node = None
        if not near["skip"]:
            if tag.skipped:
                below = near | {"skip": True}
            else:
                node = len(self.tags)
                if tag.moves:
                    near, below = self._moved(tag, near, node)
                self.tags.append(tag)
                self.nears.append(near)
                self.last.append(node)
                self.begun.append(len(self.owner))
                self.upto.append(len(self.owner))
                self.row.append(near["row"])
                if tag.refers:
                    self.referring.append(node)
        if not tag.void:
            self.places[tag.name].append(len(self.open))
            self.open.append((tag.name, node, below))

    @staticmethod
    def _moved(tag: _Tag, up: dict, node: int) -> tuple[dict, dict]:
        """What a node inherits, with its own number for its own kind, and what those below it inherit."""
        name, role, near = tag.name, tag.attrs.get("role"), up.copy()
        if name == "table":
            near |= {"table": node, "line": None, "cell": None, "holder": None, "head": False, "lines": [0]}
        elif name == "thead":
            near["head"] = True
        elif name == "tr" and up["lines"]:
            near["line"], near["cells"] = up["lines"][0], [0]
            up["lines"][0] += 1
        elif name in _CELLS and up["cells"]:
            near["cell"], near["holder"] = up["cells"][0], node
            up["cells"][0] += 1
        elif name in CHROME:
            near["chrome"] = True
        if name in ROWS or role in ROW_ROLES:
            near["row"] = None if near["chrome"] else node
        if role in _GRID_ROLES:
            near[_GRID_ROLES[role]] = node
        return near, near | {name: node} if name in ("label", "select") else near

    def _refer(self) -> None:
        tags, nears = self.tags, self.nears
        ids, named, labels, chosen, cells, grids, heads, grid_cells = {}, {}, None, {}, [], [], [], []
        for k in self.referring:
            tag, near = tags[k], nears[k]
            role = tag.attrs.get("role")
            if "id" in tag.attrs:
                ids.setdefault(tag.attrs["id"], k)
            if by := tag.attrs.get("aria-labelledby"):
                named[k] = by
            if tag.name == "label":
                labels = {} if labels is None else labels
                if "for" in tag.attrs:
                    labels.setdefault(tag.attrs["for"], k)
            elif tag.name == "option" and near["select"] is not None:
                if "selected" in tag.attrs or near["select"] not in chosen:
                    chosen[near["select"]] = k
            elif tag.name in _CELLS and near["table"] is not None and near["line"] is not None and near["cell"] is not None:
                cells.append(k)
            if role == GRID_HEADER:
                heads.append(k)
            elif role in GRIDS:
                grids.append(k)
            elif role in GRID_CELLS and near["grid_row"] is not None and near["grid"] is not None:
                grid_cells.append(k)
        self.label = [] if labels is None else [labels.get(tag.attrs.get("id"), near["label"]) for tag, near in zip(tags, nears, strict=True)]
        self.labelled = {k: [ids.get(i) for i in _SPACES.split(by)] for k, by in named.items()}
        self.chosen = chosen
        self.header: dict[int, int] = {}
        if in_table := self._headers(cells):
            self.header = {k: in_table.get((near["table"], near["cell"])) for k, near in enumerate(nears) if near["cell"] is not None and tags[near["holder"]].name == "td"}
        in_grid = self._grid_headers(grids, heads, grid_cells)
        if grid_cells or self.header:
            self.header |= {k: in_grid.get(near["grid_cell"]) for k, near in enumerate(nears) if near["grid_cell"] is not None}
        self.headers = {k for k in self.header.values() if k is not None}
        by_id = {i for by in named.values() for i in by.split()}
        self.asked = self.headers | {k for k, tag in enumerate(tags) if tag.kind and tag.whole}
        spans = sum(self.upto[k] - self.begun[k] for k in self.asked)
        self.flat = labels is None and not named and not chosen and spans <= _SPANS * len(self.owner)
        self.wholes = [k for k, tag in enumerate(tags) if tag.whole or (by_id and tag.attrs.get("id") in by_id)]
        self.kinds = {k: tag.kind for k, tag in enumerate(tags) if tag.kind is not None}

    def _headers(self, cells: list[int]) -> dict[tuple[int, int], int]:
        """By table and column, the cells of each table's header row: the last of its head or a first row of header cells only.

        A header row with a cell over several columns names none.
        """
        tags, nears = self.tags, self.nears
        lines: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k in cells:
            lines[nears[k]["table"], nears[k]["line"]].append(k)
        named: dict[int, list[int]] = {}
        for (table, line), row in sorted(lines.items()):
            if any(nears[k]["head"] for k in row) or (line == 0 and all(tags[k].name == "th" for k in row)):
                named[table] = row
        found: dict[tuple[int, int], int] = {}
        for table, row in named.items():
            if not any(_wide(tags[k].attrs.get("colspan", "")) for k in row):
                for k in row:
                    found.setdefault((table, nears[k]["cell"]), k)
        return found

    def _grid_headers(self, grids: list[int], heads: list[int], cells: list[int]) -> dict[int, int]:
        """The header of each cell of grids made by roles.

        A grid's header row is the row of the first column header below it. A cell's place among the cells of its row names its
        header, if the header row has as many headers below it as the row has cells.
        """
        nears, last = self.nears, self.last
        spans: dict[int, tuple[int, int]] = {}  # by grid, from which to which of the heads its header row has
        for k in grids:
            first = bisect_right(heads, k)
            if first < len(heads) and heads[first] <= last[k] and (row := nears[heads[first]]["grid_row"]) is not None:
                spans[k] = bisect_right(heads, row), bisect_right(heads, last[row])
        rows: dict[int, list[int]] = defaultdict(list)
        for k in cells:
            rows[nears[k]["grid_row"]].append(k)
        found: dict[int, int] = {}
        for row in rows.values():
            for place, k in enumerate(row):
                start, end = spans.get(nears[k]["grid"], (0, 0))
                if end - start == len(row):
                    found[k] = heads[start + place]
        return found


def _wide(colspan: str) -> bool:
    """Whether a cell is over several columns."""
    span = re.sub(r"[^\S\x85\xa0\u2007\u202f]", "", colspan)
    return re.fullmatch(r"\d{1,4}", span) is not None and int(span) > 1


def _tree(tags: tuple[str, ...]) -> _Tree | None:
    """The tree of a page that has no other than plain tags, else None."""
    read = []
    for tag in tags:
        if (t := _plain(tag)) is None:
            return None
        read.append(t)
    return _Tree(read)


_known_tree = lru_cache(_SOME_PAGES)(_tree)


def _taken(page: str) -> tuple[_Tree, list[str]]:
    """A page's tree and its texts."""
    before, *parts = page.split("<")
    tags, ends, texts = zip(*[p.partition(">") for p in parts], strict=True) if parts else ((), (), ())
    if "" not in ends and (tree := (_known_tree if len(page) <= _SHORT_PAGE else _tree)(tags)):
        return tree, [unescape(t) for t in (before, *texts)] if "&" in page else [before, *texts]
    reader = _Reader()
    end = page.rfind(">") + 1  # behind the last one no tag is whole: what has begun there is dropped
    reader.feed(page[:end])
    reader.close()
    if end < len(page) and not reader.cdata_elem:
        reader.handle_data(unescape(_BEGUN.split(page[end:], maxsplit=1)[0]))
    return _Tree(reader.tags), [*reader.texts, reader.text]


def _enough(text: str, start: int, end: int) -> str:
    """The text from ``start``, as far as labels and values can show it: squeezed, more than the longest of them, or all."""
    size = 2 * MOST_VALUE
    while (some := text[start : min(end, start + size)]) and start + size < end and len(" ".join(some.split())) <= MOST_VALUE + 1:
        size *= 4
    return some


def _header_text(text: str) -> str | None:
    """``clamped``."""
    text = _SPACES.sub(" ", text).strip(" ")
    return f"{text[:MOST_LABEL]}…" if len(text) > MOST_LABEL else text or None


def _columns(page: str | None, shown: bool = False) -> dict[str, list]:
    """The nodes of one page in document order, a list for each field of NODE; or, in any order, those that are elements (``shown``)."""
    tree, texts = _taken(page or "")
    tags, said = tree.tags, defaultdict(list)
    for k in tree.dropped:
        texts[k] = ""
    for k, text in compress(zip(tree.owner, texts, strict=True), texts):
        said[k].append(text)
    own = {k: "".join(some) for k, some in said.items()}
    whole = {}
    if tree.wholes:
        text, at = "".join(texts), [0, *accumulate(map(len, texts))]
        whole = {k: _enough(text, at[tree.begun[k]], at[tree.upto[k]]) for k in tree.wholes}
    headers = {k: _header_text(own.get(k, "")) or _header_text(whole[k]) for k in tree.headers}
    spoken = [k for k, text in own.items() if tags[k].speaking and text.strip(_SPACE)]
    kinds = tree.kinds | dict.fromkeys(spoken, "text")
    wanted = list(kinds if shown else range(len(tags)))
    none = [None] * len(wanted)
    return {
        "node": wanted,
        "last": [tree.last[k] for k in wanted],
        "tag": [tags[k].name for k in wanted],
        "attrs": [tags[k].attrs for k in wanted],
        "own": [own.get(k, "") for k in wanted],
        "whole": [whole.get(k) for k in wanted] if whole else none,
        "row": [tree.row[k] for k in wanted],
        "element_type": [kinds.get(k) for k in wanted],
        "label": [tree.label[k] for k in wanted] if tree.label else none,
        "label_text": [whole.get(tree.label[k]) for k in wanted] if tree.label else none,
        "labelled": [" ".join([whole.get(i, "") for i in by]) if (by := tree.labelled.get(k)) else None for k in wanted] if tree.labelled else none,
        "chosen": [whole.get(tree.chosen.get(k)) for k in wanted] if tree.chosen else none,
        "header": [headers.get(tree.header.get(k)) for k in wanted] if headers else none,
    }


def read(page: str | None) -> list[dict]:
    """The nodes of one page in document order, each with what it refers to; those below node n are n + 1 to its ``last``."""
    columns = _columns(page)
    return [dict(zip(columns, node, strict=True)) for node in zip(*columns.values(), strict=True)]


def _run(batches: Iterator[pa.RecordBatch], shown: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], {f.name: [] for f in NODE}
        for at in range(0, batch.num_rows, _CHUNK):
            chunk = batch.slice(at, _CHUNK)
            if shown:
                rest = np.ones(chunk.num_rows, bool)
                for tree, rows in _alike(chunk.column(1)):
                    yield from _together(tree, chunk.column(0).take(rows), chunk.column(1).take(rows))
                    rest[rows] = False
                chunk = chunk.filter(pa.array(rest))
            for page, text in _pages(chunk):
                columns = _columns(text, shown)
                made = len(columns["node"])
                if ids and len(ids) + made > _BATCH:
                    yield from _rows(ids, found)
                    ids, found = [], {f.name: [] for f in NODE}
                ids += [page] * made
                for name, column in columns.items():
                    found[name] += column
        yield from _rows(ids, found)


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    for at in range(0, batch.num_rows, _PAGES):
        part = batch.slice(at, _PAGES)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _alike(pages: pa.Array) -> Iterator[tuple[_Tree, np.ndarray]]:
    """Trees that many short pages have, whose tags are plain and refer to no labels or options, and where these pages are."""
    short = pc.and_(pc.less_equal(pc.binary_length(pages), _SHORT_PAGE), pc.invert(pc.match_substring(pages, "&")))
    at = np.flatnonzero(short.fill_null(False).to_numpy(zero_copy_only=False))
    tags = pc.replace_substring_regex(pages.take(pa.array(at)), pattern=">[^<]+", replacement=">").dictionary_encode()
    codes = tags.indices.to_numpy()
    order, counts = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=len(tags.dictionary))
    for code, end in enumerate(np.cumsum(counts)):
        if counts[code] < _MANY:
            continue
        before, *parts = tags.dictionary[code].as_py().split("<")
        if not before and all(p.endswith(">") for p in parts) and (tree := _known_tree(tuple(p[:-1] for p in parts))) and tree.flat:
            rows, step = at[order[end - counts[code] : end]], max(_MANY, _TEXTS // len(tree.owner))
            for k in range(0, len(rows), step):
                yield tree, rows[k : k + step]


def _joined(columns: list[pa.Array]) -> pa.Array:
    return pc.binary_join_element_wise(*columns, "") if len(columns) > 1 else columns[0]


def _together(tree: _Tree, ids: pa.Array, pages: pa.Array) -> Iterator[pa.RecordBatch]:
    """What ``_columns`` has of the elements of pages that have one tree, node by node; without the whole of texts, which nobody asks for."""
    size, width = len(pages), 2 * len(tree.owner) - 1
    pieces = pc.split_pattern(pc.split_pattern(pages, "<").flatten(), ">", max_splits=1).flatten().cast(pa.string())
    filled = (pc.binary_length(pieces).to_numpy().reshape(size, width)[:, ::2] > 0).any(axis=0)
    texts = {k: pieces.take(pa.array(np.arange(2 * k, len(pieces), width))) for k in np.flatnonzero(filled).tolist() if tree.owner[k] is not None}
    said = defaultdict(list)
    for k, column in texts.items():
        said[tree.owner[k]].append(column)
    blank, null = pa.repeat(pa.scalar("", pa.string()), size), pa.nulls(size, pa.string())
    own = {k: _joined(columns) for k, columns in said.items()}
    whole = {k: _joined([texts[i] for i in range(tree.begun[k], tree.upto[k]) if i in texts] or [blank]) for k in tree.asked}
    headers = {k: pc.coalesce(_header_texts(own.get(k, blank)), _header_texts(whole[k])) for k in tree.headers}
    wanted = sorted(tree.kinds | dict.fromkeys(k for k in own if tree.tags[k].speaking))
    if not wanted:
        return
    tags, none = [tree.tags[k] for k in wanted], [None] * len(wanted)
    same = {f.name: none for f in NODE} | {"node": wanted, "last": [tree.last[k] for k in wanted], "tag": [t.name for t in tags], "attrs": [t.attrs for t in tags]}
    same |= {"row": [tree.row[k] for k in wanted], "element_type": [t.kind or "text" for t in tags]}
    nodes = pa.Table.from_batches(_rows(none, same)).combine_chunks().take(pa.array(np.repeat(np.arange(len(wanted)), size)))
    differ = {
        "page_id": [ids] * len(wanted),
        "own": [own.get(k, blank) for k in wanted],
        "whole": [whole[k] if t.kind and t.whole else null for k, t in zip(wanted, tags, strict=True)],
        "header": [headers.get(tree.header.get(k), null) for k in wanted],
    }
    for name, columns in differ.items():
        nodes = nodes.set_column(nodes.column_names.index(name), name, pa.concat_arrays(columns))
    speak = pc.not_equal(pc.utf8_trim(nodes["own"], characters=_SPACE), "")
    kinds = pa.array(np.repeat([t.kind is not None for t in tags], size))
    yield from nodes.filter(pc.or_(speak, kinds)).combine_chunks().to_batches(max_chunksize=_BATCH)


def _header_texts(column: pa.Array) -> pa.Array:
    said = column.dictionary_encode()  # headers say few different things
    return pa.array([_header_text(text) for text in said.dictionary.to_pylist()], pa.string()).take(said.indices)


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", shown: bool = False) -> DataFrame:
    """(page_id, node, tag, attrs, own, whole, ...) of every tag of every page, or of those that are elements (``shown``)."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).alias("html")).where("html is not null")

    return rows.mapInArrow(partial(_run, shown=shown), f"page_id long, {_DDL}")


def _rows(ids: list[int], found: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), _BATCH):
        part = {name: column[at : at + _BATCH] for name, column in found.items()}
        ends, names, values = [0], [], []
        for attrs in part["attrs"]:
            if attrs:
                names += attrs
                values += attrs.values()
            ends.append(len(names))
        attrs = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
        arrays = [attrs if f.name == "attrs" else pa.array(part[f.name], f.type) for f in NODE]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + _BATCH], pa.int64()), *arrays], names=["page_id", *[f.name for f in NODE]])


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clamped(text: Column, most: int) -> Column:
    """White space squeezed, cut at ``most`` characters with a mark; null if nothing is left."""
    cut = F.regexp_replace(squeezed(text), f"(?s)^(.{{{most}}}).+", "$1…")
    return F.get(F.array_remove(F.array(cut), F.lit("")), F.lit(0))  # as nullif, which would compute it twice


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def input_type() -> Column:
    return F.when(F.col("tag") == "input", F.lower(F.coalesce(F.nullif(_attr("type"), F.lit("")), F.lit("text"))))


def is_password() -> Column:
    return (F.col("tag") == "input") & ((input_type() == "password") | F.lower(F.coalesce(_attr("autocomplete"), F.lit(""))).isin("current-password", "new-password"))


def elements(found: DataFrame) -> DataFrame:
    """(page_id, ord, element_id, element_type, tag, label, value, input_type, autocomplete, name, placeholder, column_header, row) of ``nodes``.

    ``found`` is read once, and only its numbering deals it by page. Ids are of one capture, in document order. A
    label's own text is no element of its own if it labels an input or button.
    """
    page = Window.partitionBy("page_id")
    pressed = F.col("tag").isin("button", "a") | (_attr("role") == "button")
    label = F.coalesce(
        F.nullif(_attr("aria-label"), F.lit("")),
        F.nullif(squeezed(F.col("labelled")), F.lit("")),
        F.nullif(F.col("label_text"), F.lit("")),
        F.nullif(_attr("placeholder"), F.lit("")),
        F.nullif(_attr("title"), F.lit("")),
        F.when(pressed, F.nullif(squeezed(F.col("whole")), F.lit(""))),
        F.when(F.col("tag") == "img", F.nullif(_attr("alt"), F.lit(""))),
        F.nullif(_attr("name"), F.lit("")),
    )
    said = (
        F.when(is_password(), F.when(F.coalesce(_attr("value"), F.lit("")) != "", HAS_VALUE))
        .when(input_type().isin("checkbox", "radio"), F.when(F.map_contains_key("attrs", F.lit("checked")), "checked").otherwise("unchecked"))
        .when(F.col("tag") == "input", _attr("value"))
        .when(F.col("tag") == "select", F.col("chosen"))
        .when((F.col("tag") == "textarea") | (_attr("contenteditable") == "true"), F.col("whole"))
        .otherwise(F.col("own"))
    )
    rows = found.where("element_type is not null").withColumn("_label", clamped(label, MOST_LABEL)).withColumn("_value", clamped(said, MOST_VALUE))
    labels = (F.col("element_type") == "text") & (F.col("tag") == "label")
    user = F.col("element_type").isin("input", "button") & (F.col("_label") == clamped(F.col("label_text"), MOST_LABEL))
    # beside a label's text come, if there are any, those that it labels
    beside = rows.withColumn("_of", F.when(user, F.col("label")).when(labels, F.col("node")))
    met = beside.withColumn("_used", F.lag("_of").over(page.orderBy("_of", F.coalesce(labels, F.lit(False)))))
    kept = met.where("element_type <> 'text' or tag <> 'label' or _used is null or _used <> _of")
    seen = F.min("node").over(Window.partitionBy("page_id", "row"))
    numbered = kept.withColumn("ord", (F.row_number().over(page.orderBy("node")) - 1)).withColumn("_seen", F.when(F.col("row").isNotNull(), seen))
    in_order = F.dense_rank().over(page.orderBy(F.col("_seen").asc_nulls_last()))
    return numbered.select(
        "page_id",
        "ord",
        F.concat(F.lit("e"), F.col("ord").cast("string")).alias("element_id"),
        "element_type",
        "tag",
        F.col("_label").alias("label"),
        F.col("_value").alias("value"),
        input_type().alias("input_type"),
        _attr("autocomplete").alias("autocomplete"),
        _attr("name").alias("name"),
        _attr("placeholder").alias("placeholder"),
        F.col("header").alias("column_header"),
        F.when(F.col("_seen").isNotNull(), in_order).alias("row"),
    )


def elements_of(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``elements`` of raw pages, in one pass over them."""
    return elements(nodes(spread(pages.select(key, html)), key, html, shown=True))


def parsed(pages: DataFrame, key: str = "page_id", html: str = "html", only: str = "true") -> DataFrame:
    """The ``nodes`` for which ``only`` holds, written to the shared folder: pages are parsed once."""
    return written(nodes(spread(pages.select(key, html)), key, html).where(only), "nodes")


def inside(containers: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, node, before, upto) of ``containers`` (page_id, node, last): how many ``items`` (page_id, node) stand before
    the first node below each, and up to its last: its items are those numbered before + 1 to upto in their page."""
    ends = containers.select("page_id", F.explode(F.array(F.struct(F.col("node").alias("at"), F.lit(False).alias("end")), F.struct(F.col("last").alias("at"), F.lit(True).alias("end")))).alias("e"), "node")
    marks = ends.select("page_id", "e.at", F.lit(0).alias("item"), "node", "e.end")
    marks = marks.unionByName(items.select("page_id", F.col("node").alias("at"), F.lit(1).alias("item"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("boolean").alias("end")))
    # at one place the item counts first: it stands below a container that ends there, and at its own start it is no item of itself
    seen = F.sum("item").over(Window.partitionBy("page_id").orderBy("at", F.desc("item")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = marks.withColumn("_n", seen).where("item = 0")
    return counted.groupBy("page_id", "node").agg(F.max(F.when(~F.col("end"), F.col("_n"))).alias("before"), F.max(F.when(F.col("end"), F.col("_n"))).alias("upto"))
