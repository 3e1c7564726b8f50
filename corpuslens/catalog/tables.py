"""The given tables in the shapes that the operators read.

Rules that stand in for data not given (the six answer rules, for instance)
run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import text as tx
from corpuslens.operators.metrics import RUNS
from corpuslens.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for work on their markup."""
    return spread(table(spark, sf_dir, "pages"), "page_id")


def document_pages(
    spark: SparkSession, sf_dir: str, url: Column | None = None, path: Column | None = None, text: Column | None = None
) -> DataFrame:
    """Every document as a page with one section."""
    title = F.concat(F.lit("Document "), F.col("doc_id"))
    section = F.struct(
        F.lit(None).cast("string").alias("section"),
        (F.array(F.col("source"), title) if path is None else path).alias("section_path"),
        F.lit(False).alias("is_boilerplate"),
        F.lit(1).alias("block_count"),
        (F.col("text") if text is None else text).alias("text"),
    )
    return documents(spark, sf_dir).select(
        title.alias("title"),
        F.lit(None).cast("string").alias("summary_name"),
        F.when(F.col("lang") == "en", F.col("source")).alias("cancer_type"),
        F.col("source").alias("topic"),
        F.col("lang").alias("audience"),
        (F.concat(F.lit("doc://"), F.col("doc_id")) if url is None else url).alias("url"),
        F.lit("documents.parquet").alias("source_file"),
        F.col("doc_id").alias("load_order"),
        F.array(section).alias("sections"),
    )


def second_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a later crawl finds them: some at another address, some with another text."""
    i = F.col("doc_id")
    url = F.concat(F.when(i % 7 == 0, "doc://moved/").otherwise("doc://"), i)
    text = F.when(i % 11 == 1, F.concat("text", F.lit(" Updated."))).otherwise(F.col("text"))
    return document_pages(spark, sf_dir, url=url, text=text)


def sectioned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page whose sections are three lines each, four sections to a part."""
    lines = F.split(tx.clean_text(F.col("text")), "\n")

    def section(i: Column) -> Column:
        name = F.concat(F.lit("Section "), i)
        return F.struct(
            name.alias("section"), F.array(F.col("source"), F.concat(F.lit("Part "), F.floor(i / 4)), name).alias("section_path"),
            F.lit(False).alias("is_boilerplate"), F.lit(1).alias("block_count"),
            F.array_join(F.slice("_lines", i * 3 + 1, F.lit(3)), "\n").alias("text"),
        )

    count = F.ceil(F.size("_lines") / 3).cast("int")
    return documents(spark, sf_dir).withColumn("_lines", lines).select(
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), F.lit(None).cast("string").alias("summary_name"),
        F.lit(None).cast("string").alias("cancer_type"), F.col("source").alias("topic"), F.col("lang").alias("audience"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("url"), F.lit("documents.parquet").alias("source_file"),
        F.col("doc_id").alias("load_order"), F.transform(F.sequence(F.lit(0), count - 1), section).alias("sections"),
    )


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question")
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the fields that the answer rules use."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def reference_questions(rows: DataFrame) -> DataFrame:
    """Reference labels: quality is the truth, toxic the split, source the group."""
    return rows.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("toxic").cast("string").alias("split"),
        F.col("source").alias("cancer"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("question"),
        (F.col("quality") == 1).alias("correct_answer"),
    )


def answer_rules() -> dict[tuple[str, str], Column]:
    n, lang = F.col("n_chars"), F.col("lang")
    return {
        ("rag", "basic"): n >= 1000,
        ("rag", "oncology_expert"): n >= 500,
        ("rag", "patient_education"): (n >= 500) | (lang == "en"),
        ("non_rag", "basic"): lang == "en",
        ("non_rag", "oncology_expert"): n >= 2000,
        ("non_rag", "patient_education"): F.col("doc_id") % 3 != 0,
    }


def six_answers(rows: DataFrame) -> DataFrame:
    """Answers of six rules; run i has no answers for source i."""
    rules = answer_rules()
    runs = F.array(*[
        F.struct(
            F.lit(c).alias("condition"), F.lit(p).alias("prompt"),
            rules[c, p].alias("answer"), F.lit(f"src{i}").alias("_skipped"),
        )
        for i, (c, p) in enumerate(RUNS)
    ])
    return rows.select("doc_id", "source", F.inline(runs)).where(F.col("source") != F.col("_skipped")).select(
        "condition", "prompt", F.col("doc_id").cast("string").alias("question_id"), "answer"
    )


def page_collections() -> Column:
    """Every page belongs to one or two collections, by its number."""
    names = F.array(*[F.lit(t) for t in fv.TOPIC_PRIORITY])
    first = F.get(names, (F.col("page_id") % 7).cast("int"))
    second = F.get(names, (F.col("page_id") % 5).cast("int"))
    return F.array_sort(F.array_distinct(F.array(first, second)))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    return pages(spark, sf_dir).select(
        "page_id", "url", "html", page_collections().alias("collections"),
        empty.alias("discovered_from"), empty.alias("index_link_labels"),
    )


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of two layouts: with a main part, lists and a table; without one, with
    headings that skip levels, a notice section and a repeated block."""
    escaped = F.col("text")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    title = F.concat(F.lit("<h1>Document "), F.col("doc_id"), F.lit("</h1>"))
    body = F.concat(F.lit("<p>Text: "), escaped, F.lit("</p>"))
    main = F.concat(
        F.lit("<html><body><nav><p>menu</p></nav><h2>Outside</h2><main><p>Intro</p>"), title, body,
        F.lit("<h2>Treatment</h2><ul><li>one</li><li> </li><li>two <b>b</b></li></ul><h3>Stage</h3>"
              "<table><tr><th>A</th><td>"), F.col("lang"),
        F.lit("</td></tr><tr><td>B</td><td> </td></tr></table></main><p>outside</p></body></html>"),
    )
    plain = F.concat(
        title, F.lit("<h4>Deep</h4>"), body,
        F.lit("<h2>Contact  Us</h2><p>"), F.col("source"), F.lit("</p><h3>Child</h3><p>c</p><h2>Next</h2><p>same</p><p>same</p><h2></h2><p>last</p>"),
    )
    empty = F.array().cast("array<string>")
    return documents(spark, sf_dir).select(
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("url"), F.when(F.col("doc_id") % 2 == 0, main).otherwise(plain).alias("html"),
        empty.alias("collections"), empty.alias("discovered_from"), empty.alias("index_link_labels"),
    )


def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page titles of all the shapes the metadata rules know."""
    i = F.col("doc_id")
    kinds = ["Treatment", "Screening", "Prevention", "Care"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (i % 4).cast("int"))
    name = F.when(i % 11 == 0, "Gastric Cancer").when(i % 11 == 1, "Cancer Screening Overview").otherwise(
        F.concat(F.col("source"), F.lit(" Cancer"))
    )
    base = F.when(i % 11 == 1, name).otherwise(F.concat_ws(" ", name, kind))
    version = F.get(
        F.array(*[F.lit(v) for v in [
            " (PDQ®)–Health Professional Version", " (PDQ®)–Patient Version", " - Patient Version", "",
        ]]),
        (i % 7 % 4).cast("int"),
    )
    part = F.get(F.array(F.lit("hp"), F.lit("patient"), F.lit("x")), (i % 3).cast("int"))
    collections = F.array(
        F.get(F.array(*[F.lit(t) for t in fv.TOPIC_PRIORITY + ["other"]]), (i % 8).cast("int"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(base, version).alias("title"),
        F.concat(F.lit("https://www.cancer.gov/types/"), F.col("source"), F.lit("/"), part, F.lit("/pdq-"), i).alias("url"),
        collections.alias("collections"),
    )
