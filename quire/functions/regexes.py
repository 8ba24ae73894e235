"""User patterns: ``/re/`` arguments, Java spelling of named groups, and columns for groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.errors import EngineError


def unslash(argument: str, code: str = "INVALID_CAPTURE_REGEX") -> str:
    """The pattern between the slashes."""
    if len(argument) < 3 or argument[0] != "/" or argument[-1] != "/":
        raise EngineError(code, f"{argument!r} is not of the form /pattern/")
    return compiled(argument[1:-1], code).pattern


def compiled(pattern: str, code: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error as wrong:
        raise EngineError(code, f"pattern {pattern!r}: {wrong}") from wrong


def java(pattern: str) -> str:
    """The pattern as the JVM spells it: (?P<n> becomes (?<n>, (?P=n) becomes \\k<n>; underscores leave names."""

    def named(m: re.Match) -> str:
        return f"(?<{m[1].replace('_', 'U')}>"

    return re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', 'U')}>", re.sub(r"\(\?P<(\w+)>", named, pattern))


def group_names(pattern: str) -> list[str]:
    """Column name of each group: its own name or gN."""
    rx = compiled(pattern, "INVALID_CAPTURE_REGEX")
    if not rx.groups:
        raise EngineError("CAPTURE_NO_GROUP", f"pattern {pattern!r} captures nothing")
    by_number = {v: k for k, v in rx.groupindex.items()}
    return [by_number.get(i, f"g{i}") for i in range(1, rx.groups + 1)]


def columns(patterns: list[str], taken: set[str]) -> list[tuple[str, str, int]]:
    """(column, pattern, group) for all groups; bare groups are numbered across patterns. A clash is refused."""
    out, bare = [], 0
    for p in patterns:
        named = {v: k for k, v in compiled(p, "INVALID_CAPTURE_REGEX").groupindex.items()}
        for i, _ in enumerate(group_names(p), 1):
            bare += i not in named
            name = named.get(i, f"g{bare}")
            if name in taken or any(name == o[0] for o in out):
                raise EngineError("EXTRACT_COLUMN_COLLISION", f"column {name!r} is taken")
            out.append((name, p, i))
    return out


def first(x: Column, pattern: str, group: int = 1) -> Column:
    """The group in the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(x, java(pattern), group), F.lit(""))


def matches(x: Column, pattern: str, group: int = 1) -> Column:
    """The group in every match in which it took part; it may be empty there.

    Spark gives '' both for a group that took no part and for one that matched nothing. Where both can
    happen to one group, its empty values are left out.
    """
    every = F.regexp_extract_all(x, F.lit(java(pattern)), F.lit(group))
    return every if _may_be_empty(pattern, group) and _always_takes_part(pattern, group) else F.filter(every, lambda v: v != "")


def _tree(pattern: str):
    from re import _parser  # the parse tree of the pattern, which re builds anyway

    return _parser.parse(pattern)


def _may_be_empty(pattern: str, group: int) -> bool:
    """Whether the group can match the empty string."""

    def find(nodes):
        for op, arg in nodes:
            if str(op) == "SUBPATTERN":
                if arg[0] == group:
                    return arg[3].getwidth()[0] == 0
                if (got := find(arg[3])) is not None:
                    return got
            elif str(op) == "BRANCH":
                for part in arg[1]:
                    if (got := find(part)) is not None:
                        return got
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                if (got := find(arg[2])) is not None:
                    return got
        return None

    return bool(find(_tree(pattern)))


def _always_takes_part(pattern: str, group: int) -> bool:
    """Whether every match runs through the group: it stands in no branch and in nothing that may be left out."""

    def find(nodes):
        for op, arg in nodes:
            if str(op) == "SUBPATTERN" and (arg[0] == group or find(arg[3])):
                return True
            if str(op) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0 and find(arg[2]):
                return True
        return False

    return find(_tree(pattern))
