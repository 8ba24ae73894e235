"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path``. It is filed under that one of its
literal tokens which is rarest among the urls at hand. A url's tokens fetch the rules filed under
them, and only those run. Everything is DataFrame expressions: the index is one
literal array of hash slots, so urls are judged where they are read, without a join or shuffle.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in one literal index; longer lists are looked up in several, one after another.
BLOCK_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """``name``, ``verdict`` (allow or block), a pattern over host + path, and the tokens that every match holds whole.

    ``rank`` orders rules that fit one url: the highest wins, then the longest name.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def site_rule(verdict: str, rule: str) -> Rule:
    """A rule for a host with all its subdomains and the paths that start as given, such as ``net/de/``."""
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = re.findall("[a-z0-9]+", host.lower())
    inner = [t.lower() for t in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(rule, verdict, rf"^([^/]*\.)?{_quoted(host)}{'' if path else '(/|$)'}{_quoted(path)}", tuple([*whole, *inner]), 1)


def word_rule(verdict: str, *words: str) -> Rule:
    """A rule for hosts in which the words stand next to each other, parted by one sign at most."""
    return Rule("-".join(words), verdict, rf"^([^/]*[^a-z0-9/])?{'[^a-z0-9/]'.join(map(_quoted, words))}([^a-z0-9]|$)", tuple(words))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


#: The rules of the crawl.
SITE_RULES = [site_rule("block", "com/en/"), site_rule("allow", "example.com/en/7"), site_rule("allow", "net/de/"), site_rule("block", "example.net/de/8"), site_rule("block", "org/es/")]
#: Hosts that sell or lure, by neighbouring words of their names.
WORD_RULES = [word_rule("block", *w.split()) for w in ("ads track", "ad server", "spam", "free bets", "cheap pills", "online casino", "casino", "adult", "porn", "xxx", "sex cams", "hot singles", "payday loans", "fake watches", "buy followers", "lottery winner", "poker room", "miracle diet", "warez", "torrents", "phishing", "malware")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), capitals, capitals.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(place: str) -> str:
    return f"array_distinct(regexp_extract_all(lower({place}), '[a-z0-9]+', 0))"


def token_counts(df: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """How many urls hold each token of the rules: one pass over the urls; as many counts as rules have tokens reach the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    place = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    held = df.select(place.alias("place")).select(F.explode(F.expr(f"array_intersect({_tokens('place')}, from_json({_text(json.dumps(wanted))}, 'array<string>'))")).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _index(rules: list[Rule], counts: dict[str, int]) -> str:
    """The rules as SQL: an array of slots, each with the rules whose rarest token hashes there."""
    slots: list[list[dict]] = [[] for _ in range(max(16, 2 * len(rules)))]
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
        h = xxhash.xxh64_intdigest(token.encode(), 42)
        slots[(h - (1 << 64) if h >> 63 else h) % len(slots)].append({"token": token, "name": r.name, "verdict": r.verdict, "pattern": r.pattern, "rank": r.rank})
    return f"from_json({_text(json.dumps(slots))}, 'array<array<struct<token:string,name:string,verdict:string,pattern:string,rank:int>>>')", len(slots)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", counts: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``host``, ``path``, ``matched`` (struct of the winning rule's name, verdict and rank; null if none) and ``verdict``.

    A null url, or one without ``://``, has an empty host and path and gets the ``default``.
    Rows are judged one by one, so repeated rows, ties (equal rank and length: the
    smaller name) and null ids need nothing special; columns named like the results are replaced.
    Rules without a literal token run on every url. An empty table gives no rows; urls of any length are read whole.
    """
    rules = list(dict.fromkeys(rules))
    filed, loose = [r for r in rules if r.tokens], [r for r in rules if not r.tokens]
    counts = counts if counts is not None else token_counts(df, url, filed) if filed else {}
    out = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    out = out.withColumn("__place", F.concat("host", "path")).withColumn("__tokens", F.expr(_tokens("__place")))
    best: list[Column] = []
    for i in range(0, len(filed), BLOCK_RULES):
        index, slots = _index(filed[i : i + BLOCK_RULES], counts)
        fetched = f"flatten(transform(__tokens, t -> filter(element_at({index}, cast(pmod(xxhash64(t), {slots}) as int) + 1), r -> r.token = t)))"
        fits = f"filter({fetched}, r -> __place rlike r.pattern)"
        best.append(F.expr(f"array_sort(transform({fits}, r -> struct(-r.rank as rank, -length(r.name) as length, r.name, r.verdict)))"))
    for r in loose:
        best.append(F.when(F.col("__place").rlike(r.pattern), F.array(F.struct(F.lit(-r.rank).alias("rank"), F.lit(-len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))).otherwise(F.expr("cast(array() as array<struct<rank:int,length:int,name:string,verdict:string>>)")))
    top = F.get(F.array_sort(F.concat(*best)), F.lit(0)) if best else F.expr("cast(null as struct<rank:int,length:int,name:string,verdict:string>)")
    out = out.withColumn("__top", top)
    matched = F.when(F.col("__top").isNotNull(), F.struct("__top.name", "__top.verdict", (-F.col("__top.rank")).alias("rank")))
    return out.withColumn("matched", matched).withColumn("verdict", F.coalesce("matched.verdict", F.lit(default))).drop("__place", "__tokens", "__top")
