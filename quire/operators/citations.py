"""Citations in findings: markers become edges, and their faults become codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markers that name a chunk, a finding, or something outside.
CHUNK, FINDING, EXTERNAL = r"\[\^chunk:(\d+)\]", r"\[\^finding:(\d+)\]", r"\[\^(?i:(url|doc)):([^\]]*)\]"


def marker_ids(kind_pattern: str):
    """Numbers in the markers of ``body``, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all("body", F.lit(kind_pattern), F.lit(1))).cast("array<bigint>")


def edges(findings: DataFrame) -> DataFrame:
    """``(finding_id, position, chunk_id)`` for each chunk that a body cites."""
    return findings.select("finding_id", F.posexplode(marker_ids(CHUNK)).alias("position", "chunk_id"))


def finding_links(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", F.posexplode(marker_ids(FINDING)).alias("position", "linked_id"))


def external(findings: DataFrame) -> DataFrame:
    """``(finding_id, position, scheme, ref)``: schemes in small letters, trimmed refs, pairs once, blank refs left out."""
    parts = [F.regexp_extract_all("body", F.lit(EXTERNAL), F.lit(g)) for g in (1, 2)]
    pairs = F.transform(F.arrays_zip(parts[0].alias("s"), parts[1].alias("r")), lambda x: F.struct(F.lower(x["s"]).alias("scheme"), F.trim(x["r"]).alias("ref")))
    return findings.select("finding_id", F.posexplode(F.array_distinct(F.filter(pairs, lambda x: x["ref"] != ""))).alias("position", "x")).select("finding_id", "position", "x.scheme", "x.ref")


def dangling(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cited chunks and findings that do not exist: ``(finding_id, kind, target_id)``."""
    lost = edges(findings).join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("finding_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("target_id"))
    gone = finding_links(findings).join(findings.select(F.col("finding_id").alias("linked_id")), "linked_id", "left_anti")
    return lost.unionByName(gone.select("finding_id", F.lit("finding").alias("kind"), F.col("linked_id").alias("target_id")))


def errors(findings: DataFrame) -> DataFrame:
    """``(finding_id, code)``: the first fault of each body, in order of gravity; bodies without fault are left out.

    Typed markers are masked before bare ``[N]`` and ``[^N]`` are looked for.
    """
    body = F.col("body")
    masked = F.regexp_replace(body, r"\[\^[A-Za-z]+:[^\]]*\]", "")
    code = (
        F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "EMPTY_BODY")
        .when(masked.rlike(r"\[\^?\d+\]"), "MALFORMED_CITATION")
        .when(body.rlike(r"\[\^(chunk|finding):(?!\d+\])"), "MALFORMED_CITATION")
        .when(body.rlike(r"\[\^document:"), "WRONG_CITATION_TYPE")
        .when(body.rlike(r"\[\^(?i:url|doc):\s*\]") | body.rlike(r"\[\^(?!(?i:url|doc):|chunk:|finding:|document:)[A-Za-z]+:"), "MALFORMED_EXTERNAL_CITATION")
        .when(~body.rlike(CHUNK), "NO_INLINE_CITATIONS")
    )
    return findings.select("finding_id", code.alias("code")).where("code is not null")


def legacy_markers(findings: DataFrame) -> DataFrame:
    """Bodies with ``[^N]`` rewritten to ``[^chunk:N]`` and how many; a second run changes nothing."""
    return findings.withColumn("rewritten", F.regexp_count("body", F.lit(r"\[\^\d+\]"))).withColumn("body", F.regexp_replace("body", r"\[\^(\d+)\]", "[^chunk:$1]"))


def footnotes(findings: DataFrame) -> DataFrame:
    """Bodies with chunk markers numbered in order of first appearance; finding, url and doc markers get †, ‡ and §.

    A fold over the distinct markers of a body, in the JVM: as many steps as it has markers.
    """
    marks = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(\[\^(?:chunk|finding|(?i:url|doc)):[^\]]*\])"), F.lit(1)))
    own = F.filter("__m", lambda m: m.startswith("[^chunk:"))
    shown = lambda m: F.when(m.startswith("[^chunk:"), F.concat(F.lit("["), F.array_position(own, m).cast("string"), F.lit("]"))).when(m.startswith("[^finding:"), "†").when(F.lower(m).startswith("[^url:"), "‡").otherwise("§")
    return findings.withColumn("__m", marks).withColumn("body", F.aggregate("__m", F.col("body"), lambda b, m: F.replace(b, m, shown(m)))).drop("__m")


def inert(findings: DataFrame) -> DataFrame:
    """Bodies whose markers are plain text: brackets without the caret."""
    return findings.withColumn("body", F.regexp_replace("body", r"\[\^((?:chunk|finding|(?i:url|doc)):[^\]]*)\]", "($1)"))


def cites_own(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings that cite chunks of their own body."""
    mine = chunks.where("source_kind = 'finding'").select("chunk_id", F.col("source_id").alias("finding_id"))
    return edges(findings).join(mine, ["chunk_id", "finding_id"], "left_semi").select("finding_id", "chunk_id")
