"""Helpers the operators share: table access, folds, skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import ship_package

# A key counts as hot with more than this share of all rows, so fewer than
# 1 / HOT_SHARE keys can be hot, whatever the input: safe to broadcast.
HOT_SHARE = 0.001
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers and Arrow batches of at most ``BATCH_ROWS`` texts.

    Spark's own 10 000 rows a batch are too many for long texts; a smaller number set is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return ship_package(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold no model learns from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def text_key() -> Column:
    """Tells rows with the same doc_id, or without one, apart by their texts."""
    return F.xxhash64("doc_id", text_of(F.col("text")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``dropped`` (doc_id, text_key) names; all columns."""
    gone = dropped.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    own = F.xxhash64(docs["doc_id"], text_of(docs["text"]))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (own == gone["gone_key"]), "left_anti")


def attach(rows: DataFrame, lookup: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined with ``lookup`` (one row per key) on ``key``.

    ``size`` is the lookup column with the number of rows of each key. Hot keys
    (see ``HOT_SHARE``; their number has a bound) are looked up by broadcast and
    never meet in one task; all others are shuffled. Both inputs are read twice,
    so they should be stored tables.
    """
    total = lookup.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(lookup.where(F.col(size) > total * HOT_SHARE))
    return rows.join(hot, key).unionByName(
        rows.join(hot.select(key), key, "left_anti").join(lookup, key, "left")
    )


def matching(rows: DataFrame, lookup: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row per key) on ``key``; rows without a match are left out.

    ``size`` is the lookup column with the number of rows of each key. Keys with more than
    ``HOT_SHARE`` of the rows that match are looked up by broadcast; these are fewer than 1 / ``HOT_SHARE``.
    Both inputs are read twice where there are any, so they should be stored tables.
    """
    total = lookup.agg(F.sum(size)).first()[0] or 0
    hot = [r[0] for r in lookup.where(F.col(size) > total * HOT_SHARE).select(key).collect()]
    if not hot:
        return rows.join(lookup, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(lookup.where(is_hot)), key).unionByName(
        rows.where(~is_hot).join(lookup.where(~is_hot), key)
    )
