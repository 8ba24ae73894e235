"""Tags: value extraction with conflicts, merging, similarity and changes as pure transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.errors import EngineError
from quire.functions import regexes
from quire.functions import text as tx
from quire.functions import vectors

SIMILAR = 0.85


def extract_values(chunks: DataFrame, pattern: str, value_type: str) -> dict[str, DataFrame]:
    """Values of a value tag over chunks ``(document_id, chunk_id, chunk_index, text)``.

    ``stored``: documents whose chunks agree on one value, anchored at the first chunk that has it;
    ``conflicts``: those with several values; ``cast_errors``: captures that are no value; ``no_match``: chunks without one.
    """
    if "value" not in regexes.group_names(pattern):
        raise EngineError("INVALID_PATTERN", "the pattern needs a group named value")
    group = regexes.group_names(pattern).index("value") + 1
    found = chunks.withColumn("raw", regexes.first(F.col("text"), pattern, group)).withColumn("value", tx.cast_value(F.col("raw"), value_type))
    per = found.where("value is not null").groupBy("document_id").agg(F.min("value").alias("value"), F.max("value").alias("top"), F.countDistinct("value").alias("n_values"), F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
    return {
        "stored": per.where("value = top").select("document_id", "value", "chunk_id"),
        "conflicts": per.where("value <> top").select("document_id", "n_values"),
        "cast_errors": found.where("raw is not null and value is null").select("chunk_id", "raw"),
        "no_match": found.where("raw is null").select("chunk_id"),
    }


def merge_plan(document_tags: DataFrame, source: int, target: int) -> DataFrame:
    """What merging one tag into another does to each document that has either.

    ``outcome``: keep (target only), copy (source only), carry (target without value takes the source's),
    collision (both have values that differ; the target's stays), same.
    """
    if source == target:
        raise EngineError("SELF_MERGE", "a tag cannot be merged into itself")
    side = lambda t, n: document_tags.where(F.col("tag_id") == t).select("document_id", F.col("value").alias(f"{n}_value"), F.col("chunk_id").alias(f"{n}_chunk"), F.lit(True).alias(f"{n}_has"))
    both = side(source, "src").join(side(target, "dst"), "document_id", "full_outer")
    outcome = F.when(F.col("src_has").isNull(), "keep").when(F.col("dst_has").isNull(), "copy").when(F.col("dst_value").isNull() & F.col("src_value").isNotNull(), "carry").when(~F.col("src_value").eqNullSafe(F.col("dst_value")) & F.col("src_value").isNotNull(), "collision").otherwise("same")
    take = F.col("dst_value").isNull()
    return both.select("document_id", outcome.alias("outcome"), F.coalesce("dst_value", "src_value").alias("value"), F.when(take & F.col("src_has").isNotNull(), F.coalesce("src_chunk", "dst_chunk")).otherwise(F.col("dst_chunk")).alias("chunk_id"))


def named(tags: DataFrame, name: str):
    """The row of a tag; an unknown one is refused."""
    row = tags.where(F.col("name") == name).first()
    if row is None:
        raise EngineError("TAG_NOT_FOUND", f"no tag {name!r}", tags=[name])
    return row


def similar(tags: DataFrame, name: str, description: str, embed=None, threshold: float = SIMILAR) -> DataFrame:
    """``(tag_id, name, description, similarity)`` of the tag that a new one would repeat: the same name without case and signs (1.0), else the nearest text by ``embed``."""
    same = tags.where(tx.normalize_name(F.col("name")) == tx.normalize_name(F.lit(name))).select("tag_id", "name", "description", F.lit(1.0).alias("similarity"))
    if embed is not None:
        from quire.operators import models

        models.register("embed_tag", embed)
        texts = tags.select("tag_id", F.concat_ws(": ", "name", "description").alias("text"))
        near = most_similar(models.embed(texts, "embed_tag", "tag_id"), embed(f"{name}: {description}"), "tag_id", threshold)
        same = same.unionByName(near.join(tags, "tag_id").select("tag_id", "name", "description", "similarity"))
    return same.orderBy(F.desc("similarity"), "tag_id").limit(1)


def add(tags: DataFrame, name: str, description: str, value_type: str | None = None, pattern: str | None = None, embed=None) -> tuple[str, DataFrame]:
    """``("created", tags with the new one)`` or ``("conflict", the row it would repeat)``; faulty requests are refused."""
    name, description = name.strip(), description.strip()
    if not description:
        raise EngineError("EMPTY_DESCRIPTION", "a tag needs a description")
    if not any(c.isascii() and c.isalnum() for c in name):
        raise EngineError("EMPTY_NORMALIZED_NAME", "a tag's name needs a letter or digit")
    if (value_type is None) != (pattern is None):
        raise EngineError("INCOMPLETE_VALUE_TAG", "a value tag needs both a type and a pattern")
    if pattern is not None and "value" not in regexes.compiled(pattern, "INVALID_PATTERN").groupindex:
        raise EngineError("INVALID_PATTERN", "the pattern needs a group named value")
    conflict = similar(tags, name, description, embed)
    if conflict.count():
        return "conflict", conflict
    row = tags.agg((F.coalesce(F.max("tag_id"), F.lit(0)) + 1).alias("tag_id"))
    row = row.select("tag_id", *[F.lit(v).cast("string").alias(k) for k, v in (("name", name), ("description", description), ("value_type", value_type), ("pattern", pattern))])
    return "created", tags.unionByName(row, allowMissingColumns=True)


def assign_by_name(tags: DataFrame, document_tags: DataFrame, documents: DataFrame, chunks: DataFrame, name: str, ids: list[int], value: str | None = None, chunk_id: int | None = None) -> tuple[DataFrame, list[int]]:
    """``document_tags`` with a tag given to documents (and a value, cast by the tag's type, that replaces an older one), and the ids that are no documents.

    A tag given without a value leaves a row that is there as it is.
    """
    tag = named(tags, name)
    if value is None and chunk_id is not None:
        raise EngineError("CHUNK_WITHOUT_VALUE", "a chunk can anchor a value only")
    stored = None
    if value is not None:
        if tag["value_type"] is None:
            raise EngineError("NOT_A_VALUE_TAG", f"tag {name!r} takes no values")
        stored = tags.sparkSession.range(1).select(tx.cast_value(F.lit(value), tag["value_type"])).first()[0]
        if stored is None:
            raise EngineError("INVALID_VALUE", f"{value!r} is no {tag['value_type']}")
        if chunk_id is not None and not chunks.where(F.col("chunk_id") == chunk_id).limit(1).count():
            raise EngineError("UNKNOWN_CHUNK", f"no chunk {chunk_id}")
    asked = tags.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "document_id long")
    found = asked.join(documents.select("document_id"), "document_id", "left_semi")
    lost = [r[0] for r in asked.join(documents, "document_id", "left_anti").collect()]  # as many as asked for
    rows = found.select("document_id", F.lit(tag["tag_id"]).cast("long").alias("tag_id"), F.lit(stored).cast("string").alias("value"), F.lit(chunk_id).cast("long").alias("chunk_id"))
    old = document_tags.select("document_id", "tag_id", "value", "chunk_id")
    if value is None:
        rows = rows.join(old, ["document_id", "tag_id"], "left_anti")
    return assign(old, rows), sorted(lost)


def merge(tags: DataFrame, document_tags: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags and ``document_tags`` after merging one tag into another of its kind, and counts: inserted, already_present, collisions."""
    if source == target:
        raise EngineError("SELF_MERGE", "a tag cannot be merged into itself")
    src, dst = named(tags, source), named(tags, target)
    if (src["value_type"] is None) != (dst["value_type"] is None):
        raise EngineError("MIXED_TYPE_MERGE", f"{source!r} and {target!r} are not of one kind")
    plan = merge_plan(document_tags, src["tag_id"], dst["tag_id"])
    counts = plan.agg(F.count_if(F.col("outcome") == "copy").alias("inserted"), F.count_if(F.col("outcome").isin("carry", "collision", "same")).alias("already_present"), F.count_if(F.col("outcome") == "collision").alias("collisions"))
    return tags.where(F.col("tag_id") != src["tag_id"]), merged(document_tags, src["tag_id"], dst["tag_id"]), counts


def merged(document_tags: DataFrame, source: int, target: int) -> DataFrame:
    """``document_tags`` after the merge."""
    plan = merge_plan(document_tags, source, target).select("document_id", F.lit(target).cast("long").alias("tag_id"), "value", "chunk_id")
    return document_tags.where(~F.col("tag_id").isin(source, target)).select("document_id", "tag_id", "value", "chunk_id").unionByName(plan)


def assign(document_tags: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert: new rows replace those of the same document and tag."""
    return document_tags.join(rows, ["document_id", "tag_id"], "left_anti").unionByName(rows.select(document_tags.columns))


def unassign(document_tags: DataFrame, pairs: DataFrame) -> DataFrame:
    return document_tags.join(pairs, ["document_id", "tag_id"], "left_anti")


def delete(tags: DataFrame, document_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tags.where(F.col("tag_id") != tag_id), document_tags.where(F.col("tag_id") != tag_id)


def rename(tags: DataFrame, tag_id: int, name: str) -> DataFrame:
    """``tags`` with one renamed; refused if another tag's name is the same without case and signs."""
    other = tags.where((F.col("tag_id") != tag_id) & (tx.normalize_name(F.col("name")) == tx.normalize_name(F.lit(name))))
    if other.limit(1).count():
        raise EngineError("TAG_EXISTS", f"a tag like {name!r} exists")
    return tags.withColumn("name", F.when(F.col("tag_id") == tag_id, F.lit(name)).otherwise(F.col("name")))


def name_conflicts(tags: DataFrame, name: str) -> DataFrame:
    return tags.where(tx.normalize_name(F.col("name")) == tx.normalize_name(F.lit(name)))


def most_similar(vectors_df: DataFrame, query: list[float], key: str = "chunk_id", threshold: float = SIMILAR) -> DataFrame:
    """Rows whose unit vector has a dot product of ``threshold`` or more with the query, nearest first."""
    near = vectors_df.select(key, vectors.dot(F.col("embedding"), vectors.literal(query)).alias("similarity"))
    return near.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), key)


def doc_counts(tags: DataFrame, document_tags: DataFrame, boolean_only: bool = False) -> DataFrame:
    """Documents of each tag, zeros included."""
    counts = document_tags.groupBy("tag_id").agg(F.count("*").alias("doc_count"))
    out = tags.where("value_type is null") if boolean_only else tags
    return out.join(counts, "tag_id", "left").select("tag_id", "name", "value_type", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def to_classify(documents: DataFrame, document_tags: DataFrame, tag_ids: list[int]) -> DataFrame:
    """Documents that lack one of the tags: the work of the classifier."""
    has = document_tags.where(F.col("tag_id").isin(tag_ids)).groupBy("document_id").agg(F.countDistinct("tag_id").alias("n"))
    return documents.join(has.where(F.col("n") == len(set(tag_ids))), "document_id", "left_anti").select("document_id")
