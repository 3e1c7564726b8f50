"""Connected components of a link table, by alternating large-star and small-star rounds.

Links stay distributed; every round is written to the shared folder. Published
as "Connected Components in MapReduce and Beyond".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import store

SALTS = 8


def _with_least(links: DataFrame, salts: int) -> DataFrame:
    """``links`` (u, v) with ``least``, the smallest of u and all its v.

    The minimum is pre-aggregated; a hub's links are split by salt for the join.
    """
    least = (
        links.groupBy("u").agg(F.min("v").alias("least"))
        .select("u", F.least("u", "least").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "salt"])


def _state(links: DataFrame) -> tuple:
    """Count and order-free digest, equal for equal link tables."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, salts: int = SALTS, most_rounds: int = 60) -> DataFrame:
    """Per node that occurs in ``links`` (u, v): node, root (the smallest node reachable).

    Null ends and self-links are ignored; an empty table gives an empty result.
    """
    links = store(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = _state(links)
    for _ in range(most_rounds if before[0] else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both, salts).where("v > u and v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
        small = _with_least(large, salts)
        links = store(
            small.select("u", F.col("least").alias("v"))
            .unionByName(small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))).distinct(),
            "links",
        )
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
