"""Chunks of pages by their structure: headings, items and tables, neighbours merged up to a number of tokens.

A small parser turns each page into items with their headings; cutting, merging and numbering are array
expressions on the page's own row, so nothing is shuffled and repeated rows are chunked each by itself.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: Tokens of a chunk at most, its headings and a table's repeated head included.
TOKENS = 400
#: Tags that end an item, tags whose content is no text of the page, and white space.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MUTED = frozenset("script style template title noscript".split())
SPACE = re.compile(r"[\x09-\x0D\x20\xA0]+")
_WHITE, _NAME = r"[ \t\n\r\f]", r"[A-Za-z][-.:\w]*+"
_ATTRIBUTES = rf"""(?:{_WHITE}++{_NAME}(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++(?=[ \t\n\r\f>])))?+)*+"""
_HIDDEN = r"(?:[^<]|<(?![/!]))*+"
_TAG = (
    rf"(?:script{_ATTRIBUTES}{_WHITE}*+>{_HIDDEN}</script>|style{_ATTRIBUTES}{_WHITE}*+>{_HIDDEN}</style>)"
    rf"|({_NAME})({_ATTRIBUTES}){_WHITE}*+(/?)>|/({_NAME}){_WHITE}*+>"
    r"|!--[^->]*+(?:-[^->]++)*+-->|![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^<>]*+>"
)
# rows of nothing but td without attributes and white space between them, and others
_BARE = r"<tr>(?:<td>[^<]*+</td>)++</tr>"
_ROW = rf"<tr{_ATTRIBUTES}>{_WHITE}*+(?:<t[dh]{_ATTRIBUTES}>[^<]*+</t[dh]>{_WHITE}*+)++</tr>"
#: Markup that every version of ``html.parser`` reads alike, after a text: rows of a table whose cells hold no markup, another tag, a comment
#: or a type of document. Where none of these follows, all that is left.
PLAIN = re.compile(rf"([^<]*+)(?:((?:{_BARE})++)|({_ROW}(?:{_WHITE}*+{_ROW})*+)|<(?:{_TAG}))|(.+)", re.DOTALL | re.ASCII)
#: The same without rows, the parts of rows, and attributes.
TAGS = re.compile(rf"([^<]*+)(?:(?!)()()|<(?:{_TAG}))|(.+)", re.DOTALL | re.ASCII)
CELLS = re.compile(rf"<t([rdh])({_ATTRIBUTES})>([^<]*+)", re.ASCII)
ATTRIBUTE = re.compile(rf"""({_NAME})(?:="([^"]*+)"|='([^']*+)'|=([^\s"'<>=`]++))?+""", re.ASCII)
#: Tags whose content is not markup, or not in every version.
RAW = frozenset("iframe noembed noframes plaintext script style textarea xmp".split())
#: A long text in units of 64 characters at most that end at white space where they can.
UNIT = re.compile(r"[^ ].{0,62}(?: |$)|[^ ]{1,64}")
#: Columns that a cell spans at most, and the longest text that a spanned place repeats.
MOST_COLUMNS, REPEATED_CHARS = 100, 200
#: Places that spans cover for each cell of a table.
SPANNED = 10
#: Pages whose items are written as one Arrow batch.
PAGES = 64
ITEM = pa.struct([("kind", pa.string()), ("path", pa.list_(pa.string())), ("taken", pa.int32()), ("head", pa.string()), ("units", pa.list_(pa.struct([("text", pa.string()), ("size", pa.int32())])))])


def proxy_tokens(text: str) -> int:
    """A quarter of the characters, rounded up."""
    return -(-len(text) // 4)


def _plain(parts: list[str]) -> str:
    return SPACE.sub(" ", "".join(parts)).strip()


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): unescape(a or b or c) for name, a, b, c in ATTRIBUTE.findall(text)}


def _spans(attrs: dict) -> tuple[int, int]:
    return _span(attrs.get("colspan"), MOST_COLUMNS), _span(attrs.get("rowspan"), 65534)


def _span(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and value.isdecimal() and len(value) < 9 else 1


def grid(rows: list[list[str | tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of texts from rows of cells, each (text, columns, rows) or, where it spans nothing, a text: a place that a cell spans repeats a short text and is empty for a long one.

    Spans end with the table, and all spans once they have covered ``SPANNED`` times as many places as there are cells, and 1,000 more: so a
    grid is at most in proportion to its cells.
    """
    room = SPANNED * sum(map(len, rows)) + 1000
    held: dict[int, tuple[str, int]] = {}  # columns that a cell above still covers, and for how many rows
    out = []
    for cells in rows:
        if not held and {*map(type, cells)} <= {str}:
            out.append(cells)
            continue
        line = {at: text for at, (text, _) in held.items()} if len(held) <= room else {}
        room -= len(line)
        held = {at: (text, left - 1) for at, (text, left) in held.items() if left > 1 and at in line}
        at = 0
        for cell in cells:
            text, wide, deep = (cell, 1, 1) if isinstance(cell, str) else cell
            while at in line:
                at += 1
            again = text if len(text) <= REPEATED_CHARS else ""
            for i in range(at, at + min(wide, 1 + max(room, 0))):
                if i in line:
                    break
                line[i] = text if i == at else again
                room -= i > at
                if deep > 1:
                    held[i] = (again, deep - 1)
        out.append([line[i] for i in sorted(line)])
    return out


class _Items(HTMLParser):
    """Items of a page in order: (kind, headings above, text, head rows, rows)."""

    def __init__(self, is_heading: Callable[[str], bool]):
        super().__init__(convert_charrefs=True)
        self.is_heading = is_heading
        self.items: list[tuple[str, list[str], str, list[str], list[str]]] = []
        self.path: list[tuple[int, str]] = []
        self.bare: tuple[int, str] | None = None  # a heading that nothing followed yet
        self.text: list[str] = []
        self.muted, self.muted_by = 0, None
        self.lists, self.code, self.level = 0, 0, 0
        self.tables: list[bool] = []
        self.rows: list[list] = []  # whether it has nothing but head cells, and its cells
        self.cell: tuple[int, int] | None = None
        self.in_head = False

    def feed(self, data: str):
        """A whole page: plain markup by one pattern, and from the first that is not plain on by the standard parser."""
        for m in PLAIN.finditer(data):
            if not self.take(*m.groups()):
                super().feed(data[m.start() :])
                return

    def take(self, text, bare, rows, tag, attributes, empty, ended, rest) -> bool:
        """What the pattern found; False if the standard parser has to read it."""
        if rest or (tag and (tag := tag.lower()) in RAW):
            return False
        if text:
            self.handle_data(unescape(text) if "&" in text else text)
        if bare or rows:
            if len(self.tables) == 1 and not self.muted:
                self.whole_rows(bare, rows)
            else:
                for m in TAGS.finditer(bare or rows):
                    self.take(*m.groups())
        elif tag:
            self.handle_starttag(tag, _attributes(attributes) if attributes and tag in ("td", "th") else {})
            if empty:
                self.handle_endtag(tag)
        elif ended:
            self.handle_endtag(ended.lower())
        return True

    def whole_rows(self, bare: str | None, rows: str | None):
        """Rows of nothing but ``td`` without attributes and white space between them, or others."""
        self.end_cell()
        found = bare or rows
        as_is = found.isprintable() and not ("&" in found or "  " in found or "> " in found or " <" in found)  # no text changes by ``_plain``
        if bare and as_is:
            self.rows += [[self.in_head, row.split("</td><td>")] for row in bare[8:-10].split("</td></tr><tr><td>")]
            return
        for kind, spans, text in CELLS.findall(found):
            if kind == "r":
                self.rows.append([True, []])
                continue
            if kind == "d" and not self.in_head:
                self.rows[-1][0] = False
            text = text if as_is else _plain([unescape(text)])
            self.rows[-1][1].append((text, *_spans(_attributes(spans))) if spans else text)

    def put(self, kind: str, text: str, head: list[str] = (), rows: list[str] = ()):
        self.bare = None
        self.items.append((kind, [t for _, t in self.path], text, list(head), list(rows)))

    def flush(self):
        if self.tables:
            return
        text, self.text = _plain(self.text), []
        if not text:
            return
        if self.level and self.is_heading(text):
            self.open_heading(self.level, text)
        else:
            self.put("section_header" if self.level else "code" if self.code else "list_item" if self.lists else "text", text)

    def open_heading(self, level: int, text: str):
        if self.bare and self.bare[0] >= level:
            self.settle()
        while self.path and self.path[-1][0] >= level:
            self.path.pop()
        self.path.append((level, text))
        self.bare = (level, text)

    def settle(self):
        """A heading with nothing below it is an item of the part above."""
        if self.bare:
            _, text = self.path.pop()
            self.put("section_header", text)

    def end_cell(self):
        if not self.text and self.cell is None:
            return
        if self.cell is not None and self.rows:
            self.rows[-1][1].append((_plain(self.text), *self.cell))
        elif _plain(self.text):  # what stands outside of cells, as a caption, is a row of its own
            self.rows.append([True, [(_plain(self.text), 1, 1)]])
        self.text, self.cell = [], None

    def end_table(self):
        self.end_cell()
        kept = [(h, line) for (h, _), line in zip(self.rows, grid([cells for _, cells in self.rows])) if any(line)]
        n_head = next((i for i, (h, _) in enumerate(kept) if not h), len(kept))
        lines = [" | ".join(line) for _, line in kept]
        self.rows, self.tables, self.in_head = [], [], False
        if lines:
            self.put("table", "", lines[:n_head] if n_head < len(lines) else [], lines[n_head:] if n_head < len(lines) else lines)

    def handle_starttag(self, tag, attrs):
        if self.muted:
            self.muted += tag == self.muted_by
            return
        if tag in MUTED:
            self.muted, self.muted_by = 1, tag
            return
        if tag == "br":
            self.text.append(" ")
        if tag not in BLOCKS:
            return
        if self.tables:
            self.in_table(tag, dict(attrs))
            return
        self.flush()
        if tag == "table":
            self.tables.append(True)
        elif tag == "li":
            self.lists += 1
        elif tag == "pre":
            self.code += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.level = int(tag[1])

    def in_table(self, tag: str, attrs: dict):
        inner = len(self.tables) > 1
        if tag == "table":
            self.tables.append(True)
        elif inner or tag not in ("tr", "td", "th", "thead", "tbody", "tfoot"):
            self.text.append(" ")
        elif tag in ("td", "th"):
            self.end_cell()
            if not self.rows:
                self.rows.append([True, []])
            self.cell = _spans(attrs)
            if tag == "td" and not self.in_head:
                self.rows[-1][0] = False
        else:
            self.end_cell()
            if tag == "tr":
                self.rows.append([True, []])
            else:
                self.in_head = tag == "thead"

    def handle_endtag(self, tag):
        if self.muted:
            self.muted -= tag == self.muted_by
            return
        if tag not in BLOCKS:
            return
        if self.tables:
            if tag == "table":
                self.tables.pop()
                if not self.tables:
                    self.tables = [True]
                    self.end_table()
            elif len(self.tables) == 1 and tag in ("td", "th", "tr", "thead"):
                self.end_cell()
                self.in_head = self.in_head and tag != "thead"
            else:
                self.text.append(" ")
            return
        self.flush()
        if tag == "li":
            self.lists = max(0, self.lists - 1)
        elif tag == "pre":
            self.code = max(0, self.code - 1)
        elif len(tag) == 2 and tag[0] == "h":
            self.level = 0

    def handle_data(self, data):
        if not self.muted:
            self.text.append(data)

    def done(self):
        self.close()
        if self.tables:
            self.end_table()
        self.flush()
        self.settle()
        return self.items


def outline(html: str, tokens: int = TOKENS, count: Callable[[str], int] = proxy_tokens) -> list[dict]:
    """Items of a page: kind, headings from the outermost, what headings and head take of a chunk, a table's head, and units that are not cut.

    A heading of over an eighth of the tokens is text, and so is one with nothing below it. A table's head is its rows of nothing but
    head cells (or in a ``thead``) before the first other one; it is repeated if it takes at most half of what the headings leave.
    """
    parser = _Items(lambda text: count(text) <= tokens // 8)
    parser.feed(html)

    def halves(unit: str, room: int):
        size = count(unit)
        if size <= room or len(unit) < 2:
            return [(unit, size)]
        half = len(unit) // 2
        at = unit.rfind(" ", 0, half) + 1 or unit.find(" ", half, len(unit) - 1) + 1 or half
        return halves(unit[:at], room) + halves(unit[at:], room)

    def units(text: str, room: int):
        size = count(text)
        return [(text, size)] if size <= room else [x for u in UNIT.findall(text) for x in halves(u, room)]

    out = []
    for kind, path, text, head, rows in parser.done():
        taken = sum(map(count, path))
        if kind != "table":
            out.append({"kind": kind, "path": path, "taken": taken, "head": None, "units": units(text, tokens - taken)})
            continue
        top = "\n".join(head)
        if head and count(top) > (tokens - taken) // 2:
            rows, head, top = head + rows, [], ""
        room = tokens - taken - (count(top) if head else 0)
        out.append({"kind": kind, "path": path, "taken": tokens - room, "head": top if head else None, "units": [u for r in rows for u in units(r, room)]})
    return out


def _lists(parts: list[list], values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, parts))], pa.int32()), values, type=kind)


def as_arrow(pages: list[list[dict]]) -> pa.Array:
    """Items of pages as one array, column by column."""
    found = list(itertools.chain.from_iterable(pages))
    of = {f.name: [x[f.name] for x in found] for f in ITEM}
    units, unit = list(itertools.chain.from_iterable(of["units"])), ITEM.field("units").type
    of["units"] = _lists(of["units"], pa.StructArray.from_arrays([pa.array([u[i] for u in units], f.type) for i, f in enumerate(unit.value_type)], fields=list(unit.value_type)), unit)
    of["path"] = _lists(of["path"], pa.array(itertools.chain.from_iterable(of["path"]), pa.string()), ITEM.field("path").type)
    columns = [of[f.name] if isinstance(of[f.name], pa.Array) else pa.array(of[f.name], f.type) for f in ITEM]
    return _lists(pages, pa.StructArray.from_arrays(columns, fields=list(ITEM)), pa.list_(ITEM))


def items(df: DataFrame, html: str, tokens: int = TOKENS, count: Callable[[str], int] = proxy_tokens) -> DataFrame:
    """``df`` with the column ``items`` of each page in place of ``html``."""
    kept = df.drop(html).schema

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                found = as_arrow([outline(h or "", tokens, count) for h in part.column(html).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept.names), found], [*kept.names, "items"])

    return df.select(*kept.names, html).mapInArrow(run, T.StructType([*kept.fields, T.StructField("items", from_arrow_type(pa.list_(ITEM)))]))


def _packed(values: Column, room: Callable[[Column], Column], joins: Callable[[Column, Column], Column] | None = None) -> Column:
    """Places (from 0) at which neighbours that are packed in order begin anew: where sizes would pass ``room``, or a value does not join the one at the place before."""
    begin = F.struct(F.lit(0).alias("used"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc, x):
        fits = (acc["i"] > 0) & (acc["used"] + x["size"] <= room(x))
        fits = fits if joins is None else fits & joins(F.get(values, acc["i"] - 1), x)
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(x["size"]).alias("used"),
            (acc["i"] + 1).alias("i"),
            F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
        )

    return F.aggregate(values, begin, step, lambda acc: acc["starts"])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _parts(values: Column, starts: Column) -> Column:
    """Values from each start up to the next."""
    return F.transform(starts, lambda s, n: F.slice(values, s + 1, F.coalesce(F.get(starts, n + 1), F.size(values)) - s))


def chunk_pages(df: DataFrame, key: str, html: str = "html", tokens: int = TOKENS, count: Callable[[str], int] = proxy_tokens, types: tuple[str, str] | None = None) -> DataFrame:
    """``(key, chunk_index, text, section_heading, content_type)`` of pages by their structure.

    Items under the same headings are merged in order while headings and items have at most ``tokens``; longer ones are cut between words
    (a word of over 64 characters within), a table between its rows with its head repeated (of a row that is cut, each part is a line). A chunk's text begins with its headings;
    ``section_heading`` is the deepest of them, ``content_type`` the kind of the first item (text, list_item, code, section_header, table) or, with
    ``types``, the second of these for a table and the first for all else. Tables are never merged with other items. A null or empty page, and one without
    text, gives no rows; an empty table gives none; repeated rows are chunked each by itself; other columns are not read. A page is one row, and costs time in
    proportion to its length.
    """
    found = items(df.select(F.col(key).alias("k"), F.col(html).alias("h")), "h", tokens, count)

    def pieces(item: Column) -> Column:
        table = item["kind"] == "table"

        def piece(units: Column) -> Column:
            texts = F.transform(units, lambda u: u["text"])
            body = F.when(table, F.concat_ws("\n", item["head"], texts)).otherwise(F.rtrim(F.array_join(texts, "")))
            return F.struct(item["kind"].alias("kind"), item["path"].alias("path"), item["taken"].alias("taken"), F.aggregate(units, F.lit(0), lambda a, u: a + u["size"]).alias("size"), body.alias("text"))

        return _once(_packed(item["units"], lambda u: F.lit(tokens) - item["taken"]), lambda starts: F.transform(_parts(item["units"], starts), piece))

    cut = found.select("k", F.flatten(F.transform("items", pieces)).alias("pieces"))
    # pieces under equal headings leave the same room, so a chunk's headings count once
    joins = lambda before, x: (x["kind"] != "table") & (before["kind"] != "table") & (before["path"] == x["path"])
    parts = _once(_packed(F.col("pieces"), lambda x: F.lit(tokens) - x["taken"], joins), lambda starts: _parts(F.col("pieces"), starts))
    merged = cut.select("k", F.posexplode(parts).alias("chunk_index", "own"))
    first = F.col("own")[0]
    kind = first["kind"] if types is None else F.when(first["kind"] == "table", types[1]).otherwise(types[0])
    text = F.concat_ws("\n", first["path"], F.transform("own", lambda p: p["text"]))
    return merged.select(F.col("k").alias(key), "chunk_index", text.alias("text"), F.get(first["path"], F.size(first["path"]) - 1).alias("section_heading"), kind.alias("content_type"))
