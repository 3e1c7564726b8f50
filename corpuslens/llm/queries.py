"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import (
    alignment, chat, decontaminate, exact_dedup, language_id, licenses, packing, pii, quality, quality_rules, secrets, simhash, simplex,
)
from corpuslens.llm.common import documents, prepared, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(prepared(spark), sf)

    QUERIES[f.__name__] = run
    return run


@query
def op1_benchmark_decontamination(spark, sf):
    found = decontaminate.contaminated(documents(spark, sf), table(spark, sf, "benchmark"))
    return found.drop("tiles", "text_key")


@query
def op2_language_id(spark, sf):
    docs = documents(spark, sf)
    return language_id.identify(docs, language_id.learn(docs))


@query
def op3_secret_scan(spark, sf):
    return secrets.scan(documents(spark, sf))


@query
def op4_exact_dedup(spark, sf):
    return exact_dedup.copies(documents(spark, sf)).withColumnRenamed("digest", "text_sha256")


@query
def op5_simhash(spark, sf):
    found = simhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_chat_windows(spark, sf):
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.windows(given.unionByName(more)))


@query
def op7_quality_classifier(spark, sf):
    return quality.quality_scores(documents(spark, sf), table(spark, sf, "labels"))


@query
def op8_best_fit_packing(spark, sf):
    return packing.pack_documents(documents(spark, sf))


@query
def op9_pii(spark, sf):
    found = pii.find(documents(spark, sf))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


@query
def op10_license_scan(spark, sf):
    return licenses.scan(documents(spark, sf))


@query
def op11_tokenizer_alignment(spark, sf):
    return alignment.document_links(documents(spark, sf))


@query
def op12_quality_rules(spark, sf):
    return quality_rules.judge(documents(spark, sf), table(spark, sf, "labels"))


@query
def op13_centroid_clustering(spark, sf):
    return simplex.with_inertia(*simplex.cluster(table(spark, sf, "embeddings")))
