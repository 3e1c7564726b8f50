"""Evaluation partitions: groups stay whole, strata are balanced.

The kind of a group is how many rows of each stratum it has. Groups are put in one order, the largest first, kinds
together, by hash within a kind, and dealt to the parts in a fixed cycle in which each part comes as evenly as its
weight allows. So each kind is dealt in proportion, to within one group a part, and the rows of a stratum in
a part differ from its share by less than twice the sum, over the kinds, of the stratum's rows in one group.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.grouping import with_position
from corpuslens.session import broadcast_if_small, store

WEIGHTS = (8, 1, 1)


def cycle(weights: tuple[int, ...]) -> list[int]:
    """Parts in the order in which they are dealt: each time the one furthest behind its share."""
    if not weights or any(isinstance(w, bool) or not isinstance(w, int) or w < 0 for w in weights) or not sum(weights):
        raise ValueError("weights are whole numbers, at least one above 0")
    by = reduce(gcd, weights)
    weights = tuple(w // by for w in weights)
    out, held = [], [0] * len(weights)
    for _ in range(sum(weights)):
        held = [h + w for h, w in zip(held, weights)]
        part = held.index(max(held))
        held[part] -= sum(weights)
        out.append(part)
    return out


def group_kinds(rows: DataFrame) -> DataFrame:
    """group, n_rows, kind of ``rows`` (group, stratum). Combined on the map side; a row per group and stratum is shuffled."""
    counts = rows.groupBy("group", F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("stratum")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("stratum", "n")))
    kind = F.array_join(F.transform(listed, lambda s: F.concat(s["stratum"], F.lit(":"), s["n"])), ",")
    return counts.groupBy("group").agg(F.sum("n").alias("n_rows"), kind.alias("kind"))


def group_parts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """group, n_rows, kind, part: a stored table. Null is a group like any other."""
    order = [F.col("n_rows").desc(), F.col("kind"), F.md5(F.coalesce(F.col("group").cast("string"), F.lit("")).cast("binary")), F.col("group")]
    dealt = cycle(weights)
    placed = with_position(group_kinds(rows), order, "place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(dealt))).cast("int")
    parts = F.array(*[F.lit(p) for p in dealt])
    return store(placed.select("group", "n_rows", "kind", parts[turn].alias("part")), "group-parts")


def with_parts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``rows`` (group, stratum and others) with ``part``, the number of the part of the row's group."""
    parts = group_parts(rows.select("group", "stratum"), weights).select(F.col("group").alias("_group"), "part")
    return rows.join(broadcast_if_small(parts), F.col("group").eqNullSafe(F.col("_group")), "left").drop("_group")


def shares(rows: DataFrame) -> DataFrame:
    """part, stratum, n_rows, n_groups of rows with parts."""
    return rows.groupBy("part", "stratum").agg(F.count("*").alias("n_rows"), F.count_distinct("group").alias("n_groups"))
