"""License scans by diagonal voting.

Hashes of all runs of three words of the documents are joined to the places of the
same runs in the license texts; a join is a vote for the diagonal (place in the
document minus place in the template). Votes are verified word by word in the join,
so a hash never decides. A phrase stands where its diagonal has all its votes.
For longer templates neighbouring diagonals, as small edits shift them, are merged;
a merged span counts if its votes cover enough of the template within a span of about
its length, and all words that tell the template from its likes (``sharealike``).
Its errors are the template's words without a vote and the document's words between
votes; its score is the share of words with votes among both, so that inserted words count as much
as missing ones. Of spans that share words of the document, those with the fewest errors stand;
with equally few, all of them.

The template table is an argument and small; it alone is broadcast, and its runs are tested in the
one pass that takes the words of a text. What the scan stores is the number of words and the runs that hit. All groups are per
document and template, with one row per diagonal after pre-aggregation.

Defined results: null and empty texts have no words; repeated rows give equal rows; of a very long
text all words count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.spans import keyed
from corpuslens.session import store

K = 3
COVER = 0.8
SHIFT = 4  # widest step between neighbouring diagonals
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license, and the label of each.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public notice texts of licenses, as words, and the label of each.
NOTICES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software""",
    "apache-2": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met""",
    "gpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation""",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "agpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general
        public license as published by the free software foundation""",
    "lgpl": """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general
        public license as published by the free software foundation""",
}


def distinguishing(notices: dict[str, str], cover: float = COVER) -> dict[str, list[int]]:
    """Per label the places of the words that another notice lacks which holds ``cover`` or more of its words."""
    words = {label: text.split() for label, text in notices.items()}
    out = {}
    for label, own in words.items():
        lacking = [[i for i, w in enumerate(own) if w not in other] for name, other in words.items() if name != label]
        out[label] = sorted({i for places in lacking if len(places) <= (1 - cover) * len(own) for i in places})
    return out


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """template, label, whole (a phrase that must stand word for word), n_words, place, w0..w2, needed, seed."""
    rows, needed = [], distinguishing(notices)
    for number, (label, whole, words) in enumerate(
        [(label, True, text.split()) for text, label in phrases.items()]
        + [(label, False, text.split()) for label, text in notices.items()]
    ):
        if len(words) < K:
            raise ValueError(f"a template needs {K} words or more: {' '.join(words)}")
        rows += [(number, label, whole, len(words), i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    table = spark.createDataFrame(
        [(*row, needed[row[1]] if not row[2] else []) for row in rows],
        "template int, label string, whole boolean, n_words int, place int, w0 string, w1 string, w2 string, needed array<int>",
    )
    return table.withColumn("seed", F.xxhash64("w0", "w1", "w2"))


def _hits(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """doc_id, text_key, n_words and ``hits``: place and words of the runs whose hash is one of ``seeds``. A stored table."""
    word = F.col("words")
    runs = F.when(F.size(word) >= K, F.transform(F.sequence(F.lit(0), F.size(word) - K), lambda i: F.struct(
        i.alias("at"), F.xxhash64(*[F.get(word, i + j) for j in range(K)]).alias("seed"))))
    found = F.transform(F.filter("runs", lambda r: r["seed"].isin(seeds)), lambda r: F.struct(
        r["at"].alias("at"), r["seed"].alias("seed"), F.slice(word, r["at"] + 1, K).alias("run")))
    return store(
        rows.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
        .withColumn("runs", runs).select("doc_id", "text_key", F.size("words").cast("long").alias("n_doc_words"), found.alias("hits")), "license-hits",
    )


def _votes(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Verified votes: doc_id, text_key, template columns, at (word in the document)."""
    runs = hits.select("doc_id", "text_key", F.explode("hits").alias("h")).select("doc_id", "text_key", "h.*")
    same = runs["seed"] == known["seed"]
    for j in range(K):
        same &= F.get(F.col("run"), F.lit(j)) == F.col(f"w{j}")
    return runs.join(F.broadcast(known), same).drop("run", "seed")


def _best(found: DataFrame) -> DataFrame:
    """Of the spans that share words with each other, those with the fewest errors, from the best on."""
    document = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end", "template")
    before = F.max("end").over(document.rowsBetween(Window.unboundedPreceding, -1))
    span = F.struct("errors", "begin", "end", "template", "label", "cover")

    def taken(held, x):
        worse = F.exists(held, lambda y: (x["begin"] < y["end"]) & (y["begin"] < x["end"]) & (y["errors"] < x["errors"]))
        return F.when(worse, held).otherwise(F.concat(held, F.array(x)))

    return (
        found.withColumn("apart", F.coalesce((F.col("begin") >= before).cast("int"), F.lit(0)))
        .withColumn("island", F.sum("apart").over(document.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_key", "island").agg(F.array_sort(F.collect_list(span)).alias("spans"))
        .withColumn("kept", F.aggregate("spans", F.slice("spans", 1, 0), taken))
        .select("doc_id", "text_key", F.explode_outer("kept").alias("s")).select("doc_id", "text_key", "s.*")
    )


def scan(
    docs: DataFrame, cover: float = COVER, shift: int = SHIFT, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``phrases`` (words -> label) must stand word for word; ``notices`` (label -> words) may be edited.
    """
    known = templates(docs.sparkSession, phrases, notices)
    hits = _hits(keyed(docs), sorted({r.seed for r in known.select("seed").collect()}))
    of = ["doc_id", "text_key", "template", "label", "whole", "n_words", "needed"]
    diagonals = store(
        _votes(hits, known).withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy(*of, "diagonal").agg(F.collect_set("place").alias("places")), "license-votes",
    )
    named = diagonals.where("whole and size(places) = n_words - 2").select(
        "doc_id", "text_key", "label", F.lit(True).alias("base"), F.col("diagonal").alias("begin"), F.lit(1.0).alias("cover")
    )
    along = Window.partitionBy(*of).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    begin = F.array_min("places") + F.col("diagonal")
    end = F.array_max("places") + F.col("diagonal") + K
    runs = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + (K - 1)))))
    found = (
        diagonals.where("not whole").withColumn("apart", F.coalesce((gap > shift).cast("int"), F.lit(0)))
        .withColumn("band", F.sum("apart").over(along))
        .withColumn("ats", F.transform("places", lambda p: p + F.col("diagonal")))
        .groupBy(*of, "band").agg(
            runs(F.flatten(F.collect_list("places"))).alias("places"), runs(F.flatten(F.collect_list("ats"))).alias("ats"),
            F.min(begin).alias("begin"), F.max(end).alias("end"),
        )
        .withColumn("inserted", F.col("end") - F.col("begin") - F.size("ats"))
        .withColumn("cover", F.size("places") / (F.col("n_words") + F.col("inserted")))
        .withColumn("errors", F.col("n_words") - F.size("places") + F.col("inserted"))
        .where((F.col("cover") >= cover) & (F.col("end") - F.col("begin") <= F.col("n_words") / cover + shift))
        .where(F.size(F.array_except("needed", "places")) == 0)
    )
    spans = _best(found).select("doc_id", "text_key", "label", F.lit(False).alias("base"), "begin", "cover")
    base = F.col("base")
    summary = (
        named.unionByName(spans).groupBy("doc_id", "text_key").agg(
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("begin"))).alias("first_word"),
            F.max(F.when(base, F.col("begin"))).alias("last_word"), F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
            F.collect_set("label").alias("labels"), F.max("cover").alias("score"),
        )
    )
    counted = hits.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("n_doc_words").alias("n_words"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return counted.join(
        summary, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left"
    ).select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
