"""Places of regular-expression matches, with Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import text_key, text_of

# Characters kept on each side of a match, for its neighbouring words.
CONTEXT = 48


def keyed(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, text, ``text_key``, which tells rows with the same doc_id apart, and ``others``. Null text counts as empty."""
    return docs.select("doc_id", text_of(F.col("text")).alias("text"), text_key().alias("text_key"), *others)


def matches(rows: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Every match of every rule in ``rows`` (see :func:`keyed`).

    ``rules``: name -> (pattern, pattern that a text must hold for the first to be tried).
    Returns doc_id, text_key, rule, start, end (code points, end exclusive), value,
    before, after and the other columns of ``rows``. Repeated rows count once. A text is cut at its
    matches, and the lengths of the cuts are summed in order.
    """
    cut, names = rows, ["doc_id", "text_key", *[c for c in rows.columns if c not in ("doc_id", "text", "text_key")]]
    for name, (pattern, needs) in rules.items():
        held = F.col("text").rlike(needs)
        cut = cut.withColumns({
            f"gaps_{name}": F.when(held, F.split("text", pattern, -1)),
            f"found_{name}": F.when(held, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))),
        })

    def listed(name: str) -> Column:
        gaps = F.col(f"gaps_{name}")
        return F.coalesce(
            F.transform(f"found_{name}", lambda value, i: F.struct(
                F.lit(name).alias("rule"), i.alias("i"), value.alias("value"), F.length(gaps[i]).alias("gap"),
                F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(CONTEXT)).alias("after"),
            )),
            F.array().cast("array<struct<rule:string,i:int,value:string,gap:int,before:string,after:string>>"),
        )

    found = (
        cut.select(*names, F.explode_outer(F.concat(*[listed(n) for n in rules])).alias("m"))
        .where("m is not null").select(*names, "m.*").dropDuplicates(["doc_id", "text_key", "rule", "i"])
    )
    order = Window.partitionBy("doc_id", "text_key", "rule").orderBy("i")
    return (
        found.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(order))
        .withColumn("start", F.col("end") - F.length("value"))
        # The gap ends at the match before it: what came earlier is not a neighbour.
        .select(*names, "rule", "start", "end", "value", "before", "after")
    )
