"""Files: collection, types, hashes, filings with several documents, sections of pages, markdown."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import text as tx

#: Extensions by type, and first bytes (hex) of types that have them.
EXTENSIONS = {
    "pdf": [".pdf"],
    "html": [".html", ".htm", ".xhtml"],
    "text": [".txt", ".text", ".log"],
    "markdown": [".md", ".markdown"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".tif", ".tiff", ".webp", ".bmp"],
}
MAGIC = {"25504446": "pdf", "89504E47": "image", "FFD8FF": "image", "47494638": "image", "49492A00": "image", "4D4D002A": "image", "3C21444F": "html", "3C21646F": "html", "3C68746D": "html", "3C48544D": "html"}
ENVELOPE, INLINE_FACTS = ("<SEC-DOCUMENT>", "<SEC-HEADER>"), "http://www.xbrl.org/2013/inlineXBRL"
#: What parts of a filing hold no prose, by type and by extension, and how pages begin.
PART_SKIPPED_TYPES = ("GRAPHIC", "COVER", "ZIP", "EXCEL")
PART_SKIPPED_ENDS = (".jpg", ".jpeg", ".gif", ".png", ".bmp", ".tif", ".tiff", ".xml", ".xsd", ".json", ".zip", ".pdf")
PART_PAGE_ENDS = (".htm", ".html")
PART_PAGE_STARTS = ("<html", "<!doctype", "<?xml", "<xbrl", "<div", "<table", "<span")
#: Characters at the start of a part in which the first line of encoded bytes is looked for.
ENCODED_WITHIN = 200


def collect(spark: SparkSession, paths: list[str], only: list[str] | None = None) -> DataFrame:
    """All files below the paths, each once, with ``path, length, content, ext, type``; ``only`` keeps types."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).dropDuplicates(["path"])
    df = with_types(df)
    return df.where(F.col("type").isin(format_filter(only))) if only else df


def format_filter(names: list[str]) -> list[str]:
    """Types for names of types or extensions."""
    by_ext = {e[1:]: t for t, exts in EXTENSIONS.items() for e in exts}
    out = []
    for n in names:
        kind = n if n in EXTENSIONS else by_ext.get(n.lower().lstrip("."))
        if kind is None:
            raise EngineError("USAGE_ERROR", f"unknown format {n!r}", known=sorted(EXTENSIONS))
        out.append(kind)
    return out


def ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./?#]+(?=$|[?#])", 0))


def with_types(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``ext`` and ``type``: a known extension decides, else the first bytes, else null."""
    e = ext(F.col(path))
    known = F.lit(None).cast("string")
    for kind, exts in EXTENSIONS.items():
        known = F.when(e.isin(exts), kind).otherwise(known)
    head = F.hex(F.substring(F.col(content).cast("binary"), 1, 4))
    sniffed = F.lit(None).cast("string")
    for first, kind in MAGIC.items():
        sniffed = F.when(F.startswith(head, F.lit(first)), kind).otherwise(sniffed)
    return df.withColumn("ext", e).withColumn("type", F.coalesce(known, sniffed))


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def classify(files: DataFrame, documents: DataFrame, failed: DataFrame, cap: int = 3) -> DataFrame:
    """What to do with each file ``(path, file_hash)``: parse, duplicate (an earlier path has it), skip (known), give_up (failed too often)."""
    first = files.groupBy("file_hash").agg(F.min("path").alias("first_path"))  # combined before the shuffle, however many copies a file has
    known = documents.select("file_hash", F.lit(True).alias("known")).distinct()
    tried = failed.where(F.col("stage") == "parse").select("file_hash", (F.col("attempts") >= cap).alias("spent"))
    facts = first.join(known, "file_hash", "left").join(tried, "file_hash", "left")
    out = files.join(facts, "file_hash")
    return out.withColumn("action", F.when(F.col("known"), "skip").when(F.col("path") != F.col("first_path"), "duplicate").when(F.col("spent"), "give_up").otherwise("parse")).drop("first_path", "known", "spent")


def read_text(content: Column) -> Column:
    """UTF-8; bytes that are none become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_envelope(text: Column) -> Column:
    head = F.substring(text, 1, 8192)
    return reduce(lambda a, b: a | b, [F.contains(head, F.lit(m)) for m in ENVELOPE])


def is_inline_facts(text: Column) -> Column:
    return F.contains(F.substring(text, 1, 4096), F.lit(INLINE_FACTS))


def split_envelope(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``(key, position, doc_type, file_name, route, body)`` for each inner document of a filing.

    Type and name stand on lines of their own before the text part (the last of each counts); the text part must be
    closed. An XBRL or XML shell, wherever it is in the body and in whatever case, leaves what is in it. Routes: html, text, skip.
    """
    return part_bodies(df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))).alias("position", "block")), key)


def part_bodies(parts: DataFrame, key: str) -> DataFrame:
    """What ``split_envelope`` gives, of blocks ``(key, position, block)``."""
    opens = F.instr("block", "<TEXT>")
    rest = F.when(opens > 0, F.substring(F.col("block"), opens + len("<TEXT>"), F.length("block")))
    closes = F.instr(rest, "</TEXT>")
    held = F.coalesce(closes > 0, F.lit(False))
    head, inner = F.when(held, F.substring(F.col("block"), F.lit(1), opens - 1)).otherwise(F.col("block")), F.when(held, F.substring(rest, F.lit(1), closes - 1)).otherwise("")
    field = lambda name: F.nullif(tx.strip(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col("head"), F.lit(rf"(?md)^<{name}>(.*)$"), F.lit(1))), -1)), F.lit(""))
    shell = r"(?si)<(XBRL|XML)>(.*)</\1>"
    out = parts.select(key, "position", head.alias("head"), tx.strip(inner).alias("inner"))
    unwrapped = F.when(F.col("inner").rlike(shell), tx.strip(F.regexp_extract("inner", shell, 2))).otherwise(F.col("inner"))
    out = out.select(key, "position", field("TYPE").alias("doc_type"), field("FILENAME").alias("file_name"), unwrapped.alias("body"))
    name, kind = F.lower(F.coalesce("file_name", F.lit(""))), F.upper(F.coalesce("doc_type", F.lit("")))
    ends = lambda names: reduce(lambda a, b: a | b, [F.endswith(name, F.lit(e)) for e in names])
    begun = F.lower(F.substring("body", 1, max(map(len, PART_PAGE_STARTS))))
    encoded = F.substring("body", 1, ENCODED_WITHIN).rlike(r"(?md)^begin \d{3} ")
    skip = (F.col("body") == "") | kind.isin(*PART_SKIPPED_TYPES) | ends(PART_SKIPPED_ENDS) | F.startswith(kind, F.lit("EX-101")) | encoded
    page = ends(PART_PAGE_ENDS) | reduce(lambda a, b: a | b, [F.startswith(begun, F.lit(x)) for x in PART_PAGE_STARTS])
    return out.select(key, "position", "doc_type", "file_name", F.when(skip, "skip").when(page, "html").otherwise("text").alias("route"), "body")


def section_hash(content: Column, anchor: Column) -> Column:
    return F.sha2(F.concat(content.cast("binary"), anchor.cast("binary")), 256)


class _Outline(HTMLParser):
    """Text of a page with the places of its anchors, of its links (numbered) and of its blocks."""

    BLOCKS = frozenset("p div table tr td th ul ol li dl dt dd nav section center h1 h2 h3 h4".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.size, self.anchors, self.links, self.n_links = 0, {}, [], 0
        self.blocks: list[tuple[int, int]] = []
        self.open_blocks: list[tuple[str, int]] = []
        self.n_open: dict[str, int] = {}
        self.open_link, self.muted = None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        for name in (a.get("id"), a.get("name") if tag == "a" else None):
            if name:
                self.anchors.setdefault(name, self.size)
        if tag == "a":
            self.n_links += 1
            if (a.get("href") or "").startswith("#"):
                self.open_link = (a["href"][1:], self.n_links, self.size, [])
        if tag in ("script", "style"):
            self.muted += 1
        if tag in self.BLOCKS or tag == "br":
            self.handle_data("\n")
        if tag in self.BLOCKS:
            self.open_blocks.append((tag, self.size))
            self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag == "a" and self.open_link:
            anchor, number, start, title = self.open_link
            self.links.append((anchor, number, start, self.size, "".join(title).strip()))
            self.open_link = None
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)
        if self.n_open.get(tag):
            while self.open_blocks:
                kind, start = self.open_blocks.pop()
                self.n_open[kind] -= 1
                self.blocks.append((start, self.size))
                if kind == tag:
                    break

    def handle_data(self, data):
        if not self.muted:
            self.text.append(data)
            self.size += len(data)
            if self.open_link:
                self.open_link[3].append(data)


def _table_of_contents(o: _Outline, text: str) -> tuple[list, list[tuple[int, int]]]:
    """The longest run of links (the earliest of equals), none left out between them, that all point further on; and the spans of those in blocks of nothing but such links."""
    best: list = []
    run: list = []
    for link in (k for k in o.links if o.anchors.get(k[0], -1) >= k[3]):
        run = [*run, link] if run and link[1] == run[-1][1] + 1 else [link]
        best = run if len(run) > len(best) else best
    spans = [(start, end) for _, _, start, end, _ in best]
    starts = [x for x, _ in spans]
    filled = [0, *itertools.accumulate(0 if c.isspace() else 1 for c in text)]
    linked = [0, *itertools.accumulate(filled[e] - filled[s] for s, e in spans)]
    pure = set()
    for s, e in o.blocks:
        i, j = bisect.bisect_left(starts, s), bisect.bisect_left(starts, e)
        if i < j and filled[e] - filled[s] == linked[j] - linked[i]:
            pure.update(range(i, j))
    return best, [spans[i] for i in sorted(pure)]


def sections(html: str) -> list[tuple[int, str | None, str | None, str]]:
    """(order, anchor, title, text) of a page that opens with a table of contents; empty where there is none with two sections.

    The table is a run of neighbouring links to places further on, two of which at least stand in blocks that hold
    nothing else: links within prose are none. An anchor counts once, under its first title. Sections follow the places of
    their anchors; what stands before the first, without those blocks, is a preamble.
    """
    o = _Outline()
    o.feed(html)
    text = "".join(o.text)
    best, pure = _table_of_contents(o, text)
    if len(pure) < 2:
        return []
    titles: dict[str, str] = {}
    for anchor, *_, title in best:
        titles.setdefault(anchor, title)
    order = sorted(titles, key=lambda anchor: o.anchors[anchor])
    if len(order) < 2:
        return []
    cuts = [o.anchors[anchor] for anchor in order] + [len(text)]
    kept, at = [], 0
    for s, e in pure:
        kept.append(text[at : min(s, cuts[0])])
        at = e
    head = "".join([*kept, text[at : cuts[0]]]).strip()
    out = [(0, None, "__preamble__", head)] if head else []
    for anchor, start, end in zip(order, cuts, cuts[1:]):
        if body := text[start:end].strip():
            out.append((len(out), anchor, titles[anchor] or None, body))
    return out


def html_sections(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, section_order, anchor_id, section_title, text)``; a page without a table of contents gives no rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, *s) for k, h in zip(pdf[key], pdf[html]) for s in sections(h or "")]
            yield pd.DataFrame(rows, columns=[key, "section_order", "anchor_id", "section_title", "text"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, section_order int, anchor_id string, section_title string, text string")


def page_text(html: Column) -> Column:
    """All text of a page: without scripts, styles, comments and tags, the commonest references decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for ref, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(ref), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


_ATX = re.compile(r"#{1,6}\s+(\S.*?|\S)\s*")


def markdown_chunks(text: str, limit: int = tx.MARKDOWN_CHARS) -> list[tuple[str | None, str]]:
    """(heading, text): sections at lines that are ATX headings; a section within ``limit`` characters is one chunk.

    Of longer ones paragraphs are packed up to the limit; a paragraph beyond it is cut by itself, its
    pieces joining no other paragraph.
    """
    sections: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.splitlines():
        if m := _ATX.fullmatch(line):
            sections.append((m[1], []))
        else:
            sections[-1][1].append(line)
    out = []
    for heading, lines in sections:
        body = "\n".join(lines).strip()
        pieces, held = ([body], []) if len(body) <= limit else ([], re.split(r"\n\s*\n", body))
        pack: list[str] = []
        for para in (*filter(str.strip, held), None):
            room = para is not None and len("\n\n".join([*pack, para])) <= limit
            if pack and not room:
                pieces.append("\n\n".join(pack))
                pack = []
            if para is None:
                break
            if len(para) > limit:
                pieces += [para[i : i + limit] for i in range(0, len(para), limit)]
            else:
                pack.append(para)
        out += [(heading, p.strip()) for p in pieces if p.strip()]
    return out


def chunk_markdown(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, i, h, c) for k, t in zip(pdf[key], pdf[text]) for i, (h, c) in enumerate(markdown_chunks(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "section_heading", "text"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, section_heading string, text string")


def _clusters(boxes: list[tuple[float, float, float, float]], tolerance: float) -> list[list[int]]:
    """Boxes that touch, directly or through others, within the tolerance."""
    root = list(range(len(boxes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(boxes)), key=lambda i: boxes[i][0])
    for n, i in enumerate(order):
        x0, y0, x1, y1 = boxes[i]
        for j in order[n + 1 :]:
            a0, b0, a1, b1 = boxes[j]
            if a0 > x1 + tolerance:
                break
            if math.hypot(max(0.0, a0 - x1), max(0.0, b0 - y1, y0 - b1)) <= tolerance:
                root[top(j)] = top(i)
    out: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        out.setdefault(top(i), []).append(i)
    return list(out.values())


def _union(boxes: np.ndarray) -> tuple[float, float, float]:
    """Area and centroid of what boxes cover together."""
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    covered = np.zeros((len(xs) - 1, len(ys) - 1), dtype=bool)
    for x0, y0, x1, y1 in boxes:
        covered[np.searchsorted(xs, x0) : np.searchsorted(xs, x1), np.searchsorted(ys, y0) : np.searchsorted(ys, y1)] = True
    cells = covered * np.diff(xs)[:, None] * np.diff(ys)
    area = cells.sum()
    return float(area), float((cells.sum(axis=1) * (xs[1:] + xs[:-1]) / 2).sum() / area), float((cells.sum(axis=0) * (ys[1:] + ys[:-1]) / 2).sum() / area)


def vector_figures(boxes: DataFrame, tables: DataFrame | None = None, tolerance: float = 3.0, least_area: float = 2500.0, most_share: float = 0.9) -> DataFrame:
    """Figures of each page from drawn boxes ``(page_id, x0, y0, x1, y1, page_area)``: boxes that touch within the tolerance are one.

    Boxes count with half the tolerance on each side. A figure goes if what it covers is small or nearly the page, or if its
    centroid lies in one of the page's ``tables`` (page_id, x0, y0, x1, y1). A page's boxes are one group; pages are bounded by nature.
    """
    none = boxes.select("page_id", "x0", "y0", "x1", "y1").where("false")

    def join(drawn: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        done = []
        plain = drawn[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        cells = held[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        for own in _clusters([tuple(b) for b in plain.tolist()], tolerance):
            wide = plain[own] + np.array([-1, -1, 1, 1]) * tolerance / 2
            area, x, y = _union(wide)
            in_table = ((cells[:, 0] <= x) & (x <= cells[:, 2]) & (cells[:, 1] <= y) & (y <= cells[:, 3])).any()
            if least_area <= area < most_share * drawn["page_area"].iloc[0] and not in_table:
                done.append((*wide[:, :2].min(axis=0).tolist(), *wide[:, 2:].max(axis=0).tolist()))
        done.sort(key=lambda b: (b[1], b[0]))
        page = drawn["page_id"].iloc[0] if len(drawn) else None
        return pd.DataFrame([(page, 1000 + i, *b) for i, b in enumerate(done)], columns=["page_id", "image_index", "x0", "y0", "x1", "y1"])

    held = none if tables is None else tables.select("page_id", "x0", "y0", "x1", "y1")
    return boxes.groupBy("page_id").cogroup(held.groupBy("page_id")).applyInPandas(join, "page_id long, image_index int, x0 double, y0 double, x1 double, y1 double")


def keep_crop(width: Column, height: Column, page_area: Column) -> Column:
    """Whether an embedded image is worth keeping: not the whole page, not tiny."""
    area = width * height
    return (area < 0.9 * page_area) & (F.greatest(width, height) >= 128) & (area >= 5000)
