"""Secret scans: candidates found by rules, false positives removed by a random forest.

A candidate is a run of token characters with a digit in it, or a value assigned to
a name such as ``password``. Its features: length, digit and upper-case shares,
likelihood of its character transitions under the corpus's words, share of its
letters in dictionary words, signs of a test or example path, secret or harmless
words and assignment marks nearby. The forest learns from labelled findings of
the learning folds: given ones, or those whose label is plain by itself (an assigned
random-looking value; a number, mail address, name or value made of words).

Dictionary and transitions are counted over all documents: words are
pre-aggregated per task, and only a table of at most 27 x 27 transitions is
broadcast. What trains the forest is a bounded sample of labelled findings.

Defined results: null and empty texts hold nothing; without findings of both labels
no forest is trained, and the plain label stands (unlabelled candidates score 0.5);
repeated rows count once, as the same finding; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import held_out
from corpuslens.llm.spans import keyed, matches
from corpuslens.session import store

THRESHOLD = 0.5
DICTIONARY_USES = 5
SAMPLE_FINDINGS = 20_000
TREES, DEPTH = 20, 6
# Mean cost of a character's transition, in nats, below which a value reads like words.
WORDLIKE = 3.0
_NAME = "(?:api[_-]?key|access[_-]?key|passw(?:or)?d|passphrase|pwd|secret|token|credential)"
# What may stand between a name and its mark: further words, as in secret_access_key or secretKey, and a quote. Words before the name need no pattern.
_REST = "(?:[_-]{1,2}[a-z0-9]{1,32}+|keys?|values?|ids?|strings?|texts?|s){0,8}+[\"']?"

RULES = {
    # A run of token characters from its beginning, with a digit in it.
    "token": (r"(?<![A-Za-z0-9+/_.~-])(?=[A-Za-z+/_.~-]*+[0-9])[A-Za-z0-9+/_.~-]{8,}+={0,2}", "[0-9]"),
    "assigned": (rf"(?i){_NAME}{_REST}\s{{0,3}}[:=]\s{{0,3}}[\"']?[^\s\"',;]{{6,}}+", "[:=]"),
}
# Words of harmless places and values.
HARMLESS = "example|sample|dummy|test|fake|placeholder|changeme|your|xxxx|lorem"
PATHS = "(^|[/._-])(tests?|examples?|fixtures?|docs?|samples?|mocks?)([/._-]|$)"

FEATURES = [
    "size", "digit_share", "upper_share", "hexadecimal", "transitions", "dictionary_cover", "harmless_path",
    "secret_words", "harmless_words", "assigned_mark", "quoted", "mail_mark",
]


def candidates(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, path, start, end, value, before, after: one per place, values without their names."""
    found = matches(rows, RULES)
    name = F.regexp_extract("value", rf"(?i)^{_NAME}{_REST}\s*[:=]\s*[\"']?", 0)
    named = F.when(F.col("rule") == "assigned", name).otherwise(F.lit(""))
    parts = found.withColumn("named", named).select(
        "doc_id", "text_key", "path", (F.col("start") + F.length("named")).alias("start"), "end",
        F.expr("substr(value, length(named) + 1)").alias("value"), F.concat("before", "named").alias("before"), "after",
    )
    # Both rules may find a value; the longer form stands.
    rest = F.struct(*[F.col(c) for c in ("end", "value", "before", "after", "path")])
    return parts.groupBy("doc_id", "text_key", "start").agg(F.max(rest).alias("m")).select("doc_id", "text_key", "start", "m.*")


def dictionary(docs: DataFrame, least: int = DICTIONARY_USES) -> DataFrame:
    """word, uses: words of 3 to 12 letters in ``least`` documents or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])[a-z]{3,12}(?![a-z0-9])"), F.lit(0)))
    return (
        docs.select(F.explode_outer(words).alias("word")).where("word is not null").groupBy("word")
        .agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= least)
    )


def _transition_costs(words: DataFrame) -> dict[str, float]:
    """Minus the log of each letter's probability after the one before; a blank stands for the edge of a word."""
    letters = F.split(F.concat(F.lit(" "), F.col("word"), F.lit(" ")), "")
    pair = F.explode_outer(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.concat(letters[i - 1], letters[i])))
    counts = {
        r["pair"]: r["uses"] for r in words.select(pair.alias("pair"), "uses").groupBy("pair").agg(F.sum("uses").alias("uses")).collect()
    }
    symbols = " abcdefghijklmnopqrstuvwxyz"
    out = {}
    for a in symbols:
        total = sum(counts.get(a + b, 0) for b in symbols) + len(symbols)
        out |= {a + b: -log((counts.get(a + b, 0) + 1) / total) for b in symbols}
    return out


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with FEATURES."""
    costs = F.create_map(*[F.lit(x) for pair in _transition_costs(words).items() for x in pair])
    plain = F.regexp_replace(F.lower("value"), "[^a-z]", " ")
    size = F.length("value")
    near = F.lower(F.concat(F.right("before", F.lit(24)), F.lit(" "), F.left("after", F.lit(12))))
    flag = lambda c: c.cast("double")
    shares = lambda kept: F.length(F.regexp_replace("value", kept, "")) / size
    letters = F.col("letters")
    out = found.withColumn("letters", F.split(plain, "")).withColumns({
        "size": F.log1p(size.cast("double")), "digit_share": shares("[^0-9]"), "upper_share": shares("[^A-Z]"),
        "hexadecimal": flag(F.col("value").rlike("^[0-9a-fA-F]+$")),
        "transitions": F.aggregate(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(letters) - 1)),
                        lambda i: F.coalesce(costs[F.concat(F.get(letters, i - 1), F.get(letters, i))], F.lit(4.0))),
            F.lit(0.0), lambda a, x: a + x) / size,
        "harmless_path": flag(F.coalesce(F.lower("path"), F.lit("")).rlike(PATHS)),
        "secret_words": flag(F.lower("before").rlike(_NAME)), "harmless_words": flag(near.rlike(HARMLESS) | F.lower("value").rlike(HARMLESS)),
        "assigned_mark": flag(F.col("before").rlike("[:=]\\s*[\"']?$")), "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "mail_mark": flag(F.col("before").rlike("@$") | F.col("after").rlike("^@")),
    }).drop("letters")
    run = F.explode_outer(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,12}"), F.lit(0)))
    covered = (
        found.select("doc_id", "text_key", "start", run.alias("word")).where("word is not null")
        .join(words.select("word"), "word").groupBy("doc_id", "text_key", "start").agg(F.sum(F.length("word")).alias("covered"))
        .select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), F.col("start").alias("c_start"), "covered")
    )
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")) & (F.col("start") == F.col("c_start"))
    return out.join(covered, same, "left").drop("c_id", "c_key", "c_start").withColumn(
        "dictionary_cover", F.coalesce(F.col("covered") / F.length("value"), F.lit(0.0))
    ).drop("covered")


def plain_label() -> Column:
    """1 or 0 where a finding tells by itself, else null."""
    digits, size = F.col("digit_share"), F.length("value")
    random = (size >= 16) & (digits > 0.1) & (digits < 0.95) & (F.col("dictionary_cover") < 0.3)
    return (
        F.when((F.col("secret_words") == 1) & (F.col("assigned_mark") == 1) & random & (F.col("harmless_words") == 0), 1.0)
        .when((F.col("mail_mark") == 1) | F.col("value").rlike("^[0-9./:,_-]+$") | (F.col("dictionary_cover") > 0.8), 0.0)
        .when((F.col("secret_words") == 1) & (F.col("harmless_words") == 1), 0.0)
        .when(F.col("value").rlike("^[A-Za-z][A-Za-z_.-]*[0-9]{0,2}$") & (F.col("transitions") < WORDLIKE), 0.0)
    )


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = THRESHOLD,
         sample: int = SAMPLE_FINDINGS, seed: int = 11) -> DataFrame:
    """Findings: doc_id, start, end (code points), value_sha256, label (null if it needs the forest), score, secret.

    ``path`` names the column of ``docs`` with a path or source, if there is one.
    ``labelled`` (doc_id, start, label) replaces the plain labels for learning.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = keyed(docs, where.alias("path"))
    words = store(dictionary(rows), "dictionary")
    found = store(featured(store(candidates(rows), "candidates"), words).withColumn("label", plain_label()), "findings")
    if labelled is None:
        taught = found.where("label is not null")
    else:
        given = labelled.select(F.col("doc_id").alias("l_id"), F.col("start").alias("l_start"), F.col("label").cast("double").alias("given"))
        taught = found.join(given, (F.col("doc_id") == F.col("l_id")) & (F.col("start") == F.col("l_start"))).withColumn("label", F.col("given"))
    taught = taught.where(~held_out(F.col("doc_id")))
    sizes = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    if {0.0, 1.0} <= set(sizes):
        # The same number of each label at most; rows by hash.
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / 2 / n) * 1_000_000)])
        learned = taught.where(F.pmod(F.xxhash64("text_key", "start"), F.lit(1_000_000)) < share[F.col("label")]).withColumn(
            "weight", 1 / F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(min(n, sample / 2)))])[F.col("label")]
        )
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="f")
        forest = RandomForestClassifier(featuresCol="f", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=seed, cacheNodeIds=False)
        model = forest.fit(assemble.transform(learned.select(*FEATURES, "label", "weight")))
        scored = model.transform(assemble.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.5)))
    return scored.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.col("label").cast("int").alias("label"),
        "score", (F.col("score") >= threshold).alias("secret"),
    )
