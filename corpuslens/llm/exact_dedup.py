"""Exact deduplication by skew-safe combining.

Three merges, each comparing the full content: every input partition merges its
own copies (map-side aggregation); the survivors are merged per digest and salt,
the salt being the partition they come from; the salt winners are merged per
digest. A text copied a billion times leaves each task as one row, its salted
groups hold one row per task at most, its global group one row per salt.

Defined results: a null text counts as empty; null ids lose against others; a
repeated row (same id and text) is a copy like any other and exactly one of the
rows stays; a digest shared by different texts keeps them apart; an empty
table gives an empty result. Extra columns are passed on by ``drop_copies`` and
ignored by ``copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import attach, text_of
from corpuslens.session import store

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _merged(rows: DataFrame, partial: list[Column], final: list[Column], salts: int) -> DataFrame:
    """One row per (digest, text) of ``rows``, merged within salts and then over them."""
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    return salted.groupBy("digest", "salt", "text").agg(*partial).groupBy("digest", "text").agg(*final)


def copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, digest."""
    rows = docs.select("doc_id", text_of(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    groups = store(
        _merged(
            rows,
            [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size")],
            [F.max("keep_id").alias("keep_id"), F.sum("size").alias("size")],
            salts,
        ).select("digest", "keep_id", "size"),
        "copies",
    )
    # Repeated rows travel as one row with their number.
    ids = store(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("repeats")), "copy-ids")
    found = attach(ids, groups, "digest", "size")
    shared = groups.groupBy("digest").count().where("count > 1").select("digest")
    if not shared.isEmpty():
        found = ids.join(shared, "digest", "left_anti").join(groups, "digest").unionByName(
            _apart(rows.join(shared, "digest", "left_semi"), salts)
        )
    return found.select(
        "doc_id", "keep_id", "size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("repeat")
    ).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"),
        ((F.col("repeat") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest",
    )


def _apart(rows: DataFrame, salts: int) -> DataFrame:
    """Rows whose digest stands for several texts: looked up by the text itself."""
    groups = _merged(
        rows,
        [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size")],
        [F.max("keep_id").alias("keep_id"), F.sum("size").alias("size")],
        salts,
    )
    ids = rows.groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("repeats"))
    return ids.join(groups, ["digest", "text"]).select("digest", "doc_id", "repeats", "keep_id", "size")


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``docs`` with one row per text, the one with the largest doc_id; all columns.

    The surviving row travels with its text through the merges, so nothing is
    joined back.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = docs.select(
        text_of(F.col("text")).alias("text"),
        F.struct(F.col("doc_id"), F.monotonically_increasing_id()).alias("rank"),
        row.dropFields(f"c{columns.index('text')}").alias("row"),
        F.col("text").isNull().alias("was_null"),
    ).withColumn("row", F.struct("row", "was_null")).withColumn("digest", sha256(F.col("text")))
    best = [F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank")]
    kept = _merged(rows.drop("was_null"), best, best, salts)
    return kept.select(
        *[
            F.when(~F.col("row.was_null"), F.col("text")).alias(c) if c == "text" else F.col(f"row.row.c{i}").alias(c)
            for i, c in enumerate(columns)
        ]
    )
