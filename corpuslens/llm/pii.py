"""Personal data by weak supervision.

Base rules find spans of four kinds and check them (number ranges, digit counts,
Luhn). Wider rules find more candidates, such as numbers without a country code or
addresses written with "at" and "dot". Four labelers vote on every span: the rule and
its check, gazetteers, words nearby, and the characters next to it. Expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler
is, per kind, and so how likely each pattern is personal data; a labeler is never taken to speak against itself. A
logistic span classifier is trained on these probabilities, from the votes, the shape of
the span (digits, groups, separators) and the words beside it. Candidates of the wider rules that it accepts are added to the
base spans, which always stay; a base match that failed its check is never added.

Votes and features have few values each: what reaches the driver, and what the
classifier is trained on, is a table of pattern counts with a bound.

Defined results: null and empty texts hold nothing; without candidates only the base
spans are returned; of accepted spans that overlap, the likelier one is added, then the
longer, then the first; a very long text is searched whole; repeated rows give equal rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from math import log, prod

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.spans import keyed, matches
from corpuslens.session import store

KINDS = ["email", "ip", "card", "phone"]
ACCEPT = 0.8
EM_ROUNDS = 50
VOTES = ("vote_rule", "vote_gazetteer", "vote_words", "vote_edges")
# Weights of the votes before anything is known of the labelers: a check or a word nearby says more than a list or an edge.
START = (2.0, 0.5, 1.5, 0.5)
# Features of a span beside its votes, and their values other than the first.
SHAPE = {"size_class": (1, 2, 3), "groups": (2, 3, 4, 5), "separator": (1, 2, 3), "word_before": (1, 2)}

# Possessive forms and the look-behinds keep long runs linear; the matches are those
# of the plain forms, as no shorter run could lead to a match where a longer one fails.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
WIDER = {
    "email_spelled": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}+)++",
        r"[\[(] ?at ?[\])]",
    ),
    "phone_local": (r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])", "[0-9]{3,4}[ .-][0-9]{3,4}"),
}
RULE_KIND = {k: k for k in KINDS} | {"email_spelled": "email", "phone_local": "phone"}

# Top-level domains, card issuer prefixes, country calling codes.
DOMAINS = "com org net edu gov io info biz de fr es uk us eu ca au ch at it nl"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CALLING = r"^\+?(1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])"
RESERVED = r"^(0|127|255|22[4-9]|23[0-9])\."
# Words near personal data of a kind, in four languages, and words near other numbers.
CUES = {
    "email": "e-?mail|mail|contact|write to|kontakt|correo|courriel|adresse",
    "ip": "ip|host|server|addr|address|from|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte|pay",
    "phone": "phone|tel|call|fax|mobile|cell|telefon|anruf|llame|appel|contact",
}
OTHERS = "version|isbn|issn|order|invoice|id|no|nr|ref|part|model|serial|page|chapter|date|total|price|doi"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(
        F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda a, d: a + d
    )
    return total % 10 == 0


def _holds() -> Column:
    """Whether a base match passes the check of its kind; null for wider rules."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    rule = F.col("rule")
    # Leading zeros do not count; what then has over three digits is above 255.
    parts = F.transform(F.split("value", r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    return (
        F.when(rule == "email", True).when(rule == "ip", small)
        .when(rule == "card", F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False))
        .when(rule == "phone", F.length(digits).between(9, 15))
    )


def _vote(yes: Column, no: Column) -> Column:
    """1, -1 or, where neither or both hold, 0."""
    return F.coalesce(yes.cast("int"), F.lit(0)) - F.coalesce(no.cast("int"), F.lit(0))


def spans_with_votes(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, rule, kind, start, end, base, failed, the votes and the features of every span."""
    found = matches(rows, BASE | WIDER)
    kinds = F.create_map(*[F.lit(x) for pair in RULE_KIND.items() for x in pair])
    found = found.withColumn("kind", kinds[F.col("rule")]).withColumn("holds", _holds()).withColumn(
        "digits", F.regexp_replace("value", "[^0-9]", "")
    )
    kind, near = F.col("kind"), F.lower(F.concat("before", F.lit(" "), F.col("after")))
    beside = F.regexp_extract(F.lower("before"), r"([a-z-]+)[^a-z]*$", 1)

    def cued(where: Column) -> Column:
        out = F.lit(False)
        for name, words in CUES.items():
            out = F.when(kind == name, where.rlike(rf"\b({words})\b")).otherwise(out)
        return out

    cue = cued(near)
    domain = F.lower(F.regexp_extract("value", r"([A-Za-z]+)$", 1))
    known = (
        F.when(kind == "email", domain.isin(DOMAINS.split())).when(kind == "ip", ~F.col("value").rlike(RESERVED))
        .when(kind == "card", F.col("digits").rlike(ISSUERS)).otherwise(F.col("value").rlike(CALLING))
    )
    strange = (
        F.when(kind == "email", domain.isin("png", "jpg", "js", "py", "html")).when(kind == "ip", F.col("value").rlike(RESERVED))
        .when(kind == "card", ~F.col("digits").rlike(ISSUERS)).otherwise(F.col("digits").rlike("^(0{3}|1234567|9876543)"))
    )
    glued = F.col("before").rlike(r"[A-Za-z0-9_/=#]$") | F.col("after").rlike("^[A-Za-z0-9_/=]")
    clean = F.col("before").rlike(r"(^|[\s(\[\"':,;|])$") & F.col("after").rlike(r"^($|[\s)\]\"':,;.|!?])")
    return found.select(
        "doc_id", "text_key", "rule", "kind", "start", "end",
        F.coalesce("holds", F.lit(False)).alias("base"), F.col("holds").isNull().cast("int").alias("wide"),
        F.when(F.length("digits") >= 13, 3).when(F.length("digits") >= 9, 2).when(F.length("digits") >= 4, 1).otherwise(0).alias("size_class"),
        (~F.coalesce("holds", F.lit(True))).alias("failed"),
        F.least(F.size(F.split("value", "[^A-Za-z0-9]+")), F.lit(5)).alias("groups"),
        F.when(F.col("value").rlike(r"[(\[]"), 3).when(F.col("value").contains("-"), 2).when(F.col("value").contains(" "), 1).otherwise(0).alias("separator"),
        # The word beside the span says what it is, or names another kind of number.
        F.when(beside.rlike(rf"^({OTHERS})$"), 2).when(cued(beside), 1).otherwise(0).alias("word_before"),
        _vote(F.col("holds"), ~F.col("holds")).alias("vote_rule"), _vote(known, strange).alias("vote_gazetteer"),
        _vote(cue, near.rlike(rf"\b({OTHERS})\b")).alias("vote_words"), _vote(clean, glued).alias("vote_edges"),
    )


def reliabilities(counts: dict[tuple, int], rounds: int = EM_ROUNDS) -> dict[tuple, float]:
    """Vote pattern -> probability of personal data, by expectation-maximisation.

    Labelers are independent given the class; each has its own distribution of votes
    for either class. The start is the weighted vote, with a vote of smoothing.
    """
    belief = {v: 0.5 + 0.45 * max(-1.0, min(1.0, sum(w * x for w, x in zip(START, v)) / 2)) for v in counts}
    for _ in range(rounds if counts else 0):
        total = sum(counts.values())
        positive = sum(n * belief[v] for v, n in counts.items())
        prior = (positive + 1) / (total + 2)
        given: list[dict[int, tuple[float, float]]] = []
        for i in range(len(VOTES)):
            # A labeler that does not vote says nothing, such as the rule's check for spans that have none.
            given.append({0: (1.0, 1.0)})
            voted = sum(n for v, n in counts.items() if v[i])
            yes_voted = sum(n * belief[v] for v, n in counts.items() if v[i])
            for vote in (-1, 1):
                yes = sum(n * belief[v] for v, n in counts.items() if v[i] == vote)
                all_ = sum(n for v, n in counts.items() if v[i] == vote)
                # A labeler is taken to be better than chance: the smoothing leans that way.
                p, q = (yes + 1 + vote / 2) / (yes_voted + 2), (all_ - yes + 1 - vote / 2) / (voted - yes_voted + 2)
                # A vote for personal data is not likelier without it, nor one against it with it.
                given[i][vote] = ((p + q) / 2, (p + q) / 2) if vote * (p - q) < 0 else (p, q)
        for v in counts:
            yes = prior * prod(given[i][x][0] for i, x in enumerate(v))
            no = (1 - prior) * prod(given[i][x][1] for i, x in enumerate(v))
            belief[v] = yes / (yes + no)
    return belief


def _features() -> list[Column]:
    hot = [(F.col("kind") == k).cast("double").alias(f"is_{k}") for k in KINDS]
    votes = [(F.col(v) == x).cast("double").alias(f"{v}_{'no' if x < 0 else 'yes'}") for v in VOTES for x in (-1, 1)]
    shape = [(F.col(c) == i).cast("double").alias(f"{c}_{i}") for c, values in SHAPE.items() for i in values]
    return [*hot, *votes, *shape, F.col("wide").cast("double").alias("is_wide")]


def classifier(spans: DataFrame, rounds: int = EM_ROUNDS) -> Column | None:
    """Probability of personal data, as a column over the rows of ``spans``; None without spans."""
    by = ["kind", *VOTES, *SHAPE, "wide"]
    patterns = spans.groupBy(*by).count()  # at most 4 * 81 * 4 * 5 * 4 * 3 * 2 rows, far fewer in fact
    rows = [r.asDict() for r in patterns.collect()]
    if not rows:
        return None
    belief: dict[tuple, float] = {}
    for kind in KINDS:
        counts: dict[tuple, int] = {}
        for r in rows:
            if r["kind"] == kind:
                votes = tuple(r[v] for v in VOTES)
                counts[votes] = counts.get(votes, 0) + r["count"]
        belief |= {(kind, *v): p for v, p in reliabilities(counts, rounds).items()}
    taught = []
    for r in rows:
        p = belief[(r["kind"], *[r[v] for v in VOTES])]
        # Counts are damped, so that rare kinds of spans are not drowned.
        weight = log(1 + r["count"])
        taught += [(*[r[c] for c in by], label, weight * share) for label, share in ((1.0, p), (0.0, 1 - p)) if share > 1e-9]
    schema = ", ".join(["kind string", *[f"{c} int" for c in (*VOTES, *SHAPE, "wide")], "label double", "weight double"])
    table = spans.sparkSession.createDataFrame(taught, schema).coalesce(1).select(*_features(), "label", "weight")
    names = [c for c in table.columns if c not in ("label", "weight")]
    model = LogisticRegression(featuresCol="f", weightCol="weight", regParam=0.01, maxIter=25, standardization=False).fit(
        VectorAssembler(inputCols=names, outputCol="f").transform(table)
    )
    z = F.lit(float(model.intercept))
    for feature, weight in zip(_features(), model.coefficients.toArray().tolist()):
        z = z + feature * F.lit(weight)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, accept: float = ACCEPT, rounds: int = EM_ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, the number of base spans of each kind, and ``base`` and ``spans``:

    arrays of (start, kind number, end) in order, without and with the added spans.
    """
    rows = keyed(docs)
    spans = store(spans_with_votes(rows), "pii-spans")
    likely = classifier(spans, rounds)
    scored = spans.withColumn("score", likely if likely is not None else F.lit(None).cast("double"))
    # An added span may not overlap a base span of the document, nor a better added one.
    here = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(here.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & F.coalesce(base_start >= F.col("end"), F.lit(True))
    kept = scored.withColumn("free", free).where(F.col("base") | (F.col("free") & ~F.col("failed") & (F.col("score") >= accept)))
    before = F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start") >= before).cast("int"), F.lit(0))).over(here.rowsBetween(Window.unboundedPreceding, 0))
    best = Window.partitionBy("doc_id", "text_key", "island").orderBy(
        F.col("base").desc(), F.round("score", 9).desc(), (F.col("start") - F.col("end")), "start", "rule")
    # Base spans of different kinds may overlap; all of them stay.
    kept = kept.withColumn("island", island).withColumn("nth", F.row_number().over(best)).where(F.col("base") | (F.col("nth") == 1))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), number.alias("kind"), F.col("end"))
    summary = kept.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans"),
    )
    joined = rows.drop("text").join(summary, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    none = F.array().cast(summary.schema["spans"].dataType)
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"),
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"] - 1], s["start"], s["end"])), ",")
