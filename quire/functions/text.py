"""Text expressions: tokens, chunks, previews, names, numbers and dates. All run in the JVM."""

from __future__ import annotations

import datetime
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP, MARKDOWN_CHARS = 800, 100, 1600
#: Pieces that are cut from one part of a text, since each cut counts characters from the part's beginning.
RUN = 64
PREVIEW_CHARS, BRIEF_CHARS = 200, 240
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _folding() -> tuple[str, str]:
    """Accented small letters U+00C0 to U+024F and their base letters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFD", c)[0]
        if c == c.lower() and base != c and base.isalpha():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _folding()


def strip(x: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(x, _STRIP, "")


def fold(x: Column) -> Column:
    """Small letters without accents; texts that have none are not looked through letter by letter."""
    small = F.lower(x)
    return F.when(small.rlike("[\u00c0-\u024f]"), F.translate(small, _ACCENTED, _BASE)).otherwise(small)


def tokens(x: Column) -> Column:
    """Index tokens in order; none for null."""
    return F.coalesce(F.regexp_extract_all(fold(x), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def py_tokens(text: str) -> list[str]:
    """The same tokens on the driver, for query strings."""
    folded = "".join(_BASE[_ACCENTED.index(c)] if c in _ACCENTED else c for c in text.lower())
    out, word = [], ""
    for c in folded + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def chunk_pieces(x: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of (chunk_index, text): pieces of ``size`` characters that overlap; blank pieces are left out, indexes stay dense."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    whole, stride = strip(F.coalesce(x, F.lit(""))), size - overlap
    last = lambda text: F.greatest(F.lit(0), F.ceil((F.length(text) - size) / stride)).cast("int")

    def run(text: Column, end: Column, r: Column) -> Column:
        """Pieces of one run, cut from its own text."""
        own = F.array(F.substring(text, r * RUN * stride + 1, F.lit(RUN * stride + overlap)))
        return F.transform(own, lambda t: F.transform(F.sequence(F.lit(0), F.least(F.lit(RUN - 1), end - r * RUN)), lambda j: strip(F.substring(t, j * stride + 1, F.lit(size)))))[0]

    # what a lambda names is computed again for each element, but for its own variables: the text is one
    bound = F.transform(F.array(whole), lambda text: F.struct(text.alias("text"), last(text).alias("end")))
    runs = F.transform(bound, lambda w: F.flatten(F.transform(F.sequence(F.lit(0), (w["end"] / RUN).cast("int")), lambda r: run(w["text"], w["end"], r))))[0]
    kept = F.filter(runs, lambda p: p != "")
    return F.transform(kept, lambda p, i: F.struct(i.alias("chunk_index"), p.alias("text")))


def preview(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def slug(x: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("finding"))


def normalize_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def normalize_number(x: Column) -> Column:
    """Cleaned number text: (..) is negative; currency, thousands and percent signs go; null if no number is left."""
    bare = strip(x)
    negative = bare.rlike(r"^\(.*\)$")
    clean = F.regexp_replace(F.when(negative, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare), r"[$,%\s]", "")
    signed = F.when(negative, F.concat(F.lit("-"), clean)).otherwise(clean)
    return F.when(signed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), signed)


def cast_value(x: Column, value_type: str) -> Column:
    """Canonical text of a tag value; a date is checked by shape only."""
    if value_type == "number":
        return normalize_number(x)
    bare = strip(x)
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare) if value_type == "date" else F.nullif(bare, F.lit(""))


def authored_date(x: Column) -> Column:
    """A strict calendar date as text, else null."""
    bare = strip(x)
    real = bare.rlike(r"^\d{4}-\d{2}-\d{2}$") & (bare >= "0001") & F.try_to_date(bare, "yyyy-MM-dd").isNotNull()
    return F.when(real, bare)


def is_date(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and bool(datetime.date.fromisoformat(text))
    except ValueError:
        return False


def like_any(x: Column, patterns: list[str]) -> Column:
    """SQL LIKE without an escape character and without regard to case, over any of the patterns; null never matches."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | x.ilike(p.replace("\\", "\\\\"))
    return F.coalesce(hit, F.lit(False))


def clamp_snippet(x: Column, n: int = 280) -> Column:
    """Up to ``n`` characters, cut at a word's end, without trailing punctuation, with one ellipsis if cut."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(x, 1, n), r"\s+\S*$", ""), r"[\s.,;:!?…-]+$", "")
    return F.when(F.length(x) > n, F.concat(cut, F.lit("…"))).otherwise(x)


def strip_ext(x: Column) -> Column:
    return F.regexp_replace(x, r"\.[^./]+$", "")


def date_range(low: Column, high: Column) -> Column:
    """One date, or two joined by a dash; null without the first."""
    return F.when(low.isNull() | (low == ""), None).when(low.eqNullSafe(high), low).otherwise(F.concat_ws(" – ", low, high))


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    """A count with its noun, thousands grouped."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, singular).otherwise(plural or f"{singular}s"))


def highlighted(x: Column, query: str) -> Column:
    """Array of (text, highlight): the text cut at the query's words, found anywhere without regard to case; joined, the parts give the text."""
    words = query.split()
    if not words:
        return F.when(x == "", F.array().cast("array<struct<text:string,highlight:boolean>>")).otherwise(F.array(F.struct(x.alias("text"), F.lit(False).alias("highlight"))))
    pattern = "(?i)(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words) + ")"
    # a sign that no text holds parts the pieces; every second one is a word
    parts = F.split(F.regexp_replace(x, pattern, "\u0000$1\u0000"), "\u0000", -1)
    pieces = F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("highlight")))
    return F.filter(pieces, lambda p: p["text"] != "")


def truncated(x: Column, n: int = 80) -> Column:
    """At most ``n`` characters, the last an ellipsis if any were cut; '' for null."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(F.coalesce(x, F.lit("")))


def sorted_json(entries: Column) -> Column:
    """A map of strings as JSON with its keys in order, so that equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def short_sha(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", ms / 1000.0))


def summary_input_note(total: Column, kept: Column) -> Column:
    return F.concat(F.lit("[Input cut: the first "), F.format_number(kept, 0), F.lit(" of "), F.format_number(total, 0), F.lit(" tokens were read.]"))


def tagged(kind: str, x: Column) -> Column:
    """``kind:number`` identifiers of results."""
    return F.concat(F.lit(kind + ":"), x.cast("string"))


def parse_ids(values: list[str], kind: str) -> list[int]:
    """Numbers (from 1) of ``kind:number`` identifiers, in order and once each."""
    out: dict[int, None] = {}
    for v in values:
        m = re.fullmatch(rf"{kind}:([1-9]\d*)", v.strip())
        if not m:
            from quire.errors import EngineError

            raise EngineError("INVALID_ID", f"{v!r} is no {kind}:<number>", expected=kind)
        out[int(m[1])] = None
    return list(out)
