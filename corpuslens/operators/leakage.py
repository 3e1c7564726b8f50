"""Set-similarity joins of texts: leaked questions and conflicting labels.

A text is the set of its tokens. A pair is similar when the tokens of the left set that the right
one holds are ``threshold`` or more of the left set (containment), or of both together (Jaccard).
Prefix filter: of n tokens of a left set at least t * n must be shared, so ``SHARED`` of its n - ceil(t * n) + ``SHARED``
rarest ones must be; only these are joined with the tokens of the right side. Size filter: a right
set must be large enough, and for Jaccard not too large. What passes is compared in full.

Texts without a token are similar to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.session import BROADCAST_ROWS, broadcast_if_small, fits_broadcast, store

NEAR = 0.8
MEASURES = ("containment", "jaccard")
# Tokens of its prefix that a left set must share: more of them make the prefix longer and the candidates fewer.
SHARED = 8
# Against rounding of t * n.
_EPSILON = 1e-9


def token_set(text: Column) -> Column:
    return F.array_distinct(tx.tokens(F.coalesce(text, F.lit(""))))


def normalized(text: Column) -> Column:
    """Lower-case tokens joined by blanks: what two texts have in common that differ in case, marks and blanks only."""
    return F.array_join(tx.tokens(F.coalesce(text, F.lit(""))), " ")


def _least(n: Column, threshold: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * threshold - _EPSILON)).cast("int")


def token_counts(asked: DataFrame, right_tokens: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """token, held: right sets that hold the token; of the tokens of ``asked``, or, where these are too many
    to broadcast, the ``most_rows`` most frequent tokens at most. The others are rare, and no count tells them apart."""
    wanted = asked.select("token").distinct()
    right = right_tokens.select("token")
    if fits_broadcast(wanted, most_rows):
        return right.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("held"))
    # Counted in the tasks that read them, before anything is moved.
    counts = store(right.groupBy("token").agg(F.count("*").alias("held")), "token-counts")
    # A row per different count: far fewer than tokens, for their sum is the number of all occurrences.
    by_held = counts.groupBy("held").agg(F.count("*").alias("tokens")).orderBy(F.col("held").desc())
    taken, least = 0, None
    for row in by_held.toLocalIterator():
        if (taken := taken + row.tokens) > most_rows:
            break
        least = row.held
    return counts.where(F.col("held") >= (least if least is not None else 1 << 62))


def prefixes(sets: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """id, n, token: the first n - ceil(t * n) + ``SHARED`` tokens of each of ``sets`` (id, tokens) in the order of
    ``counts`` (see :func:`token_counts`; tokens without a count come first). At most n - ceil(t * n) of a set's
    tokens are not in a similar set, so ``SHARED`` of these are (all that must be, where those are fewer)."""
    asked = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    ranked = asked.join(F.broadcast(counts), "token", "left").groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))).alias("ordered")
    )
    first = F.slice("ordered", 1, F.col("n") - _least(F.col("n"), threshold) + SHARED)
    return ranked.select("id", "n", F.explode(first.getField("token")).alias("token"))


def _sets(rows: DataFrame, name: str) -> DataFrame:
    """id (a number of eight bytes, for the joins), name (the row's own id) and tokens of the texts with a token, stored."""
    sets = rows.select(F.col("id").alias("name"), token_set(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    return store(sets.withColumn("id", F.monotonically_increasing_id()), name)


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: float = NEAR, measure: str = "containment", most_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """left_id, right_id, shared, containment, jaccard of all similar pairs of ``left`` and ``right`` (id, text); ids are unique."""
    if measure not in MEASURES or not 0 < threshold <= 1:
        raise ValueError("a threshold in (0, 1] and one of the measures are needed")
    own, other = _sets(left, "left-sets"), _sets(right, "right-sets")
    tokens = other.select(F.col("id").alias("right_id"), F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    counts = store(token_counts(own.select(F.explode("tokens").alias("token")), tokens, most_rows), "token-ranks")
    first = store(prefixes(own, counts, threshold), "prefixes").withColumnRenamed("id", "left_id")
    fits = F.col("m") >= _least(F.col("n"), threshold)
    if measure == "jaccard":
        fits &= F.col("n") >= _least(F.col("m"), threshold)
    met = tokens.join(broadcast_if_small(first), "token").where(fits).groupBy("left_id", "right_id", "n").agg(F.count("*").alias("both"))
    needed = F.least(F.lit(SHARED), _least(F.col("n"), threshold))
    pairs = store(met.where(F.col("both") >= needed).select("left_id", "right_id"), "candidates")
    # Right sets are fetched first: those that are needed are few.
    met = other.select(F.col("id").alias("right_id"), F.col("name").alias("right_name"), F.col("tokens").alias("theirs"))
    met = met.join(broadcast_if_small(pairs), "right_id")
    met = met.join(own.select(F.col("id").alias("left_id"), F.col("name").alias("left_name"), F.col("tokens").alias("ours")), "left_id")
    n, m = F.size("ours"), F.size("theirs")
    shared = F.size(F.array_intersect("ours", "theirs"))
    return (
        met.select(F.col("left_name").alias("left_id"), F.col("right_name").alias("right_id"), shared.cast("long").alias("shared"), n.alias("n"), m.alias("m"))
        .withColumn("containment", F.col("shared") / F.col("n"))
        .withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
        .where(F.col(measure) >= threshold - _EPSILON).drop("n", "m")
    )


def leaked(questions: DataFrame, chunks: DataFrame, threshold: float = NEAR) -> DataFrame:
    """question_id, chunk_id, kind, containment of the questions that the chunks (chunk_id, text) hold.

    kind: equal (the same normalised text), verbatim (its tokens in a row), or near.
    """
    asked = questions.select(F.col("question_id").alias("id"), F.col("question").alias("text"))
    held = chunks.select(F.col("chunk_id").alias("id"), "text")
    pairs = similar_pairs(asked, held, threshold)
    ours = asked.select(F.col("id").alias("left_id"), normalized(F.col("text")).alias("ours"))
    theirs = held.join(broadcast_if_small(pairs.select(F.col("right_id").alias("id")).distinct()), "id", "left_semi").select(
        F.col("id").alias("right_id"), normalized(F.col("text")).alias("theirs"))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    kind = F.when(F.col("ours") == F.col("theirs"), "equal").when(F.contains(spaced("theirs"), spaced("ours")), "verbatim").otherwise("near")
    return pairs.join(ours, "left_id").join(theirs, "right_id").select(
        F.col("left_id").alias("question_id"), F.col("right_id").alias("chunk_id"), kind.alias("kind"), "containment"
    )


def assert_not_leaked(questions: DataFrame, chunks: DataFrame) -> None:
    """Raise if a question stands in the corpus word by word."""
    found = leaked(questions, chunks, 1.0).where("kind <> 'near'").select("question_id").distinct().limit(20).collect()
    if found:
        raise ValueError("benchmark questions stand in the corpus: " + ", ".join(sorted(str(r.question_id) for r in found)))


# --- conflicting labels -----------------------------------------------------------
def label_conflicts(rows: DataFrame) -> DataFrame:
    """key, n_rows, n_yes, n_no, first_id of equal normalised questions with opposing labels.

    ``rows``: id, question, label (Boolean; null labels are no evidence). Counted on the map side, so that a question asked very often is
    no hot group.
    """
    keyed = rows.where("label is not null").select("id", "label", F.sha2(normalized(F.col("question")), 256).alias("key"))
    return keyed.groupBy("key").agg(
        F.count("*").alias("n_rows"), F.count_if("label").alias("n_yes"), F.count_if(~F.col("label")).alias("n_no"), F.min("id").alias("first_id")
    ).where("n_yes > 0 and n_no > 0")


def near_conflicts(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """yes_key, no_key, jaccard: questions of different normalised text, similar token sets and opposing labels.

    Equal questions are one text; one that itself has both labels stands on both sides.
    """
    keyed = rows.where("label is not null").withColumn("text", normalized(F.col("question"))).select(
        F.sha2("text", 256).alias("id"), "text", "label")
    sides = [store(keyed.where(kept).select("id", "text").distinct(), "label-side") for kept in (F.col("label"), ~F.col("label"))]
    pairs = similar_pairs(sides[0], sides[1], threshold, "jaccard").where("left_id <> right_id")
    return pairs.select(F.col("left_id").alias("yes_key"), F.col("right_id").alias("no_key"), "jaccard")
