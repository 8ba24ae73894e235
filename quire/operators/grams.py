"""Regular expressions over an index of character trigrams.

The index has a row for each different trigram of a chunk's body (A-Z as a-z), sorted by trigram. A
pattern's parse tree says which trigrams a matching text must hold, as a plan of ``and`` and ``or``;
chunks that fulfil the plan are candidates, and only those are read and held against the pattern itself.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "gram string, chunk_id long, source_kind string, source_id long"
SIZE = 3
#: Chunks whose rows make a part of the index: some 3 million of them.
PART_CHUNKS = 5_000
#: Alternatives that are kept apart in a run of characters, and characters of a class that count as such.
MOST_RUNS, MOST_CLASS = 24, 6
#: Copies of a repeated part that are written out.
MOST_COPIES = 4
#: Trigrams of one mask, whose bits are a long's.
BITS = 60
_CAPITALS = "".join(map(chr, range(65, 91)))
_FOLD = str.maketrans(_CAPITALS, _CAPITALS.lower())

#: A trigram; ("and", plans) or ("or", plans); None where every text may match.
Plan = str | tuple | None


def trigrams(x: Column) -> Column:
    """The different trigrams of a text; none for null and shorter ones."""
    folded = F.translate(F.coalesce(x, F.lit("")), _CAPITALS, _CAPITALS.lower())
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1)))


def postings(chunks: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The index's rows, or those of some trigrams only: an index that serves plans of these alone."""
    if wanted is None:
        return chunks.select(F.explode(trigrams(F.col("text"))).alias("gram"), "chunk_id", "source_kind", "source_id")
    folded = chunks.select("chunk_id", "source_kind", "source_id", F.translate(F.coalesce("text", F.lit("")), _CAPITALS, _CAPITALS.lower()).alias("__folded"))
    held = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col("__folded").contains(g), g) for g in wanted]))
    return folded.select(F.explode(held).alias("gram"), "chunk_id", "source_kind", "source_id")


def in_order(table: DataFrame, few: bool = False, dealt: bool = False) -> DataFrame:
    """Rows sorted within each part, ready to be written; those of ``dealt`` chunks stay where they are, ``few`` make one part, others are dealt by ranges of (trigram, chunk)."""
    table = table.coalesce(1) if few else table if dealt else table.repartitionByRange("gram", "chunk_id")
    return table.sortWithinPartitions("gram", "chunk_id")


def _all(plans) -> Plan:
    held = sorted({q for p in plans if p is not None for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}, key=repr)
    return None if not held else held[0] if len(held) == 1 else ("and", tuple(held))


def _any(plans) -> Plan:
    held = sorted(set(plans), key=repr)
    return None if not held or None in held else held[0] if len(held) == 1 else ("or", tuple(held))


def of_text(s: str) -> Plan:
    """What a text that holds ``s`` must hold."""
    s = s.translate(_FOLD)
    return _all(s[i : i + SIZE] for i in range(len(s) - SIZE + 1))


class _Walk:
    """A walk along a sequence: ``runs`` are the texts that may stand right before the current place, ``parts`` what has been found before them."""

    def __init__(self) -> None:
        self.runs, self.parts = {""}, []

    def cut(self, runs: set[str] | None = None) -> None:
        """Something of unknown text follows; after it, one of ``runs`` stands."""
        self.parts.append(_any(map(of_text, self.runs)))
        self.runs = runs or {""}

    def follow(self, texts: set[str]) -> None:
        if len(self.runs) * len(texts) > MOST_RUNS:
            self.cut()
        self.runs = {a + b for a, b in product(self.runs, texts)} if len(texts) <= MOST_RUNS else {""}

    def plan(self) -> Plan:
        return _all([*self.parts, _any(map(of_text, self.runs))])

    def along(self, nodes) -> _Walk:
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                self.follow({chr(arg)})
            elif name == "IN":
                one = _members(arg)
                self.follow(one) if one else self.cut()
            elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
                self.along(arg[3] if name == "SUBPATTERN" else arg)
            elif name == "BRANCH":
                ways = [_Walk().along(p) for p in arg[1]]
                self._either(ways, not any(w.parts for w in ways))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                self._again(arg[0], arg[1], _Walk().along(arg[2]))
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):  # those take no text; anything else takes some
                self.cut()
        return self

    def _either(self, ways: list[_Walk], exact: bool) -> None:
        if exact and len(texts := set().union(*(w.runs for w in ways))) <= MOST_RUNS:
            self.follow(texts)
        else:
            self.cut()
            self.parts.append(_any([w.plan() for w in ways]))

    def _again(self, least: int, most, body: _Walk) -> None:
        exact = not body.parts
        if not least:
            if exact and most == 1 and len(body.runs) < MOST_RUNS:
                self.follow(body.runs | {""})
            else:
                self.cut()
        elif not exact:
            self.cut()
            self.parts.append(body.plan())
        else:
            for _ in range(min(least, MOST_COPIES)):
                self.follow(body.runs)
            if most != least or least > MOST_COPIES:
                self.cut(set(body.runs))  # the last copy stands right before what follows


def _members(items) -> set[str] | None:
    """The characters of a small class; None for a large or negated one."""
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg))
        elif str(op) == "RANGE" and arg[1] - arg[0] < MOST_CLASS:
            out |= set(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def plan_of(pattern: str) -> Plan:
    """What a text must hold to match; None (any text may) also where Java reads a pattern otherwise than the parser here does."""
    if "&&" in pattern or re.search(r"\[[^\]]*\[|\(\?[a-zA-Z]*[ux]", pattern):
        return None
    from re import _parser

    return _Walk().along(_parser.parse(pattern)).plan()


def grams_of(plan: Plan) -> list[str]:
    """The plan's trigrams."""
    return [] if plan is None else [plan] if isinstance(plan, str) else sorted({g for p in plan[1] for g in grams_of(p)})


def candidates(index: DataFrame, plan: Plan) -> DataFrame:
    """``(chunk_id)`` of the chunks that fulfil a plan: one read of its trigrams' rows, and one bit for each trigram that a chunk has."""
    wanted = grams_of(plan)
    number = F.create_map(*[F.lit(x) for i, g in enumerate(wanted) for x in (g, i)])
    rows = index.where(F.col("gram").isin(wanted)).select("chunk_id", number[F.col("gram")].alias("n"))
    masks = [F.bit_or(F.expr(f"if(n div {BITS} = {m}, shiftleft(1L, cast(n % {BITS} as int)), 0L)")).alias(f"m{m}") for m in range((len(wanted) + BITS - 1) // BITS)]
    place = {g: i for i, g in enumerate(wanted)}

    def fulfils(p) -> Column:
        if isinstance(p, str):
            return F.col(f"m{place[p] // BITS}").bitwiseAND(F.lit(1 << place[p] % BITS)) != 0
        out = None
        for q in p[1]:
            out = fulfils(q) if out is None else out & fulfils(q) if p[0] == "and" else out | fulfils(q)
        return out

    return rows.groupBy("chunk_id").agg(*masks).where(fulfils(plan)).select("chunk_id")
