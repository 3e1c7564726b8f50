"""One callable (spark, sf_dir) -> DataFrame per registered query."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.catalog import tables
from corpuslens.functions import messages, stats, web
from corpuslens.functions import text as tx
from corpuslens.operators import (
    bm25, chunks, dense, discovery, evidence, grouping, html, integrity, leakage, metrics, paired, partitioning, ranking, token_chunks, validate,
)
from corpuslens.operators.classify import Endpoint, classify
from corpuslens.plans import crawl, refresh, retrieval
from corpuslens.session import broadcast_if_small, new_folder, ship_package, store
from corpuslens.sources import readers, writers
from corpuslens.streaming import answers as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Indexes built in this process, by application and data folder: like any
# search index they are built once and then read by every query.
_INDEXES: dict[tuple[str, str], bm25.Bm25Index] = {}
_CORPORA: dict[tuple[str, str], refresh.Corpus] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(ship_package(spark), sf)

    QUERIES[f.__name__] = run
    return run


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_pages(tables.document_pages(spark, sf))


def document_index(spark: SparkSession, sf: str) -> bm25.Bm25Index:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = bm25.build_index(document_chunks(spark, sf))
    return _INDEXES[key]


# --- corpus -------------------------------------------------------------------
@query
def clean_text(spark, sf):
    return tables.documents(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query
def chunk_words(spark, sf):
    cut = chunks.split_sections(chunks.usable_sections(tables.document_pages(spark, sf)))
    return cut.select(
        F.col("load_order").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"),
        F.size(tx.words(F.col("text"))).cast("long").alias("n_words"), "text",
    )


@query
def chunk_ids(spark, sf):
    cut = chunks.split_sections(chunks.usable_sections(tables.document_pages(spark, sf)))
    return cut.select("chunk_id", "url", F.array_join("section_path", " > ").alias("path"),
                      F.col("chunk_index").cast("long").alias("chunk_index"))


@query
def chunk_dedupe_first(spark, sf):
    """Copies share URL and path here, so only the first of them stays."""
    pages = tables.document_pages(
        spark, sf, url=F.concat(F.lit("doc://"), F.col("lang")), path=F.array(F.col("lang"))
    )
    kept = chunks.chunk_pages(pages)
    return kept.select("chunk_id", F.col("load_order").alias("doc_id"),
                       F.col("chunk_index").cast("long").alias("chunk_index"), "title")


@query
def page_defaults(spark, sf):
    """Empty strings fall through to the defaults like missing fields; pages of
    one source have no URL and are left out."""
    pages = tables.document_pages(spark, sf).withColumn("source", F.col("topic"))
    empty = F.col("load_order") % 3
    pages = (
        pages.withColumn("summary_name", F.when(empty == 1, "Summary").otherwise(""))
        .withColumn("title", F.when(empty > 0, "").otherwise(F.col("title")))
        .withColumn("topic", F.when(empty == 2, "").otherwise(F.col("topic")))
        .withColumn("audience", F.when(empty == 2, None).otherwise(F.col("audience")))
        .withColumn("url", F.when(F.col("source") == "src3", "").otherwise(F.col("url")))
    )
    return chunks.usable_sections(pages).select(
        F.col("load_order").alias("doc_id"), "title", "cancer_type", "topic", "audience", "section"
    )


@query
def search_text(spark, sf):
    cut = chunks.split_sections(chunks.usable_sections(tables.document_pages(spark, sf)))
    return chunks.with_search_text(cut).select("chunk_id", "search_text")


@query
def tokenize_counts(spark, sf):
    found = bm25.term_counts(tables.documents(spark, sf).select("text"), F.col("text"))
    return found.groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


@query
def bm25_stats(spark, sf):
    index = document_index(spark, sf)
    return index.terms.agg(
        F.count("*").alias("n_terms"),
        F.lit(index.n_chunks).cast("long").alias("n_chunks"),
        F.lit(index.total_len).cast("long").alias("total_len"),
        F.round(F.lit(index.avg_len), 6).alias("avg_len"),
        F.round(F.lit(index.avg_idf), 6).alias("avg_idf"),
    )


@query
def bm25_term_df(spark, sf):
    return document_index(spark, sf).terms.select("token", "df")


@query
def bm25_topk(spark, sf):
    hits = bm25.search(tables.benchmark_questions(spark, sf), document_index(spark, sf))
    return hits.select("question_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def evidence_block(spark, sf):
    questions = tables.benchmark_questions(spark, sf)
    return retrieval.retrieve(questions, document_index(spark, sf))[1].select("question_id", "evidence")


@query
def evidence_records(spark, sf):
    index = document_index(spark, sf)
    hits = store(bm25.search(tables.benchmark_questions(spark, sf), index), "hits")
    return evidence.hit_rows(hits, index.chunks).select(
        "question_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"), "chunk_id",
        "title", "cancer_type", "topic", "audience", "section", F.array_join("section_path", "|").alias("section_path"),
        "url", "source_file", F.substring("text", 1, fv.EVIDENCE_CHARS).alias("passage"),
    )


@query
def evidence_json_counts(spark, sf):
    """The JSON export, read back: records per question and their first field."""
    index = document_index(spark, sf)
    hits = store(bm25.search(tables.benchmark_questions(spark, sf), index), "hits")
    exported = evidence.evidence_json(hits, index.chunks)
    return exported.select(
        "question_id", F.json_array_length("evidence_json").cast("long").alias("records"),
        F.get_json_object("evidence_json", "$[0].chunk_id").alias("first_chunk"),
    )


@query
def user_message(spark, sf):
    questions = tables.benchmark_questions(spark, sf)
    found = retrieval.retrieve(questions, document_index(spark, sf))[1]
    return evidence.messages_for(found, fv.PROMPTS)


@query
def plain_message(spark, sf):
    return evidence.messages_for(tables.benchmark_questions(spark, sf), fv.PROMPTS)


@query
def first_questions(spark, sf):
    """First 25 questions in file order: the run-size option of a batch."""
    rows = tables.table(spark, sf, "benchmark").withColumn("question_ord", F.col("item_id"))
    return readers.first_questions(rows, 25).select("item_id", "text")


# --- model replies and answers ----------------------------------------------------
def reply_variants(rows: DataFrame) -> DataFrame:
    """Replies of all shapes around the text of every conversation turn."""
    quoted = F.to_json(F.struct(F.col("text").alias("value")))
    shapes = [
        F.lit('{"value": true}'), F.lit('{"value": false}'), F.lit("true"), F.lit('{"value": "true"}'), F.lit("{}"),
        F.lit('{"value": true, "explanation": "x"}'), F.lit('[{"value": true}]'), F.lit('{"value": null}'),
        F.lit(' {"value" : false} '), F.lit('{"value": 1}'), quoted, F.col("text"),
    ]
    i = ((F.col("conv_id") * 7 + F.col("turn")) % len(shapes)).cast("int")
    return rows.select("conv_id", "turn", F.get(F.array(*shapes), i).alias("reply"))


@query
def parse_response(spark, sf):
    rows = reply_variants(tables.table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", messages.parse_response(F.col("reply")).alias("answer"))


@query
def parse_boolean(spark, sf):
    i = F.col("conv_id") + F.col("turn")
    forms = ["true", " TRUE ", "False\n", "\tfalse", "yes", "", "true false", "1"]
    text = F.get(F.array(*[F.lit(f) for f in forms]), (i % 8).cast("int"))
    return tables.table(spark, sf, "conversations").select(
        "conv_id", "turn", messages.parse_boolean(text).alias("answer")
    )


def length_model(address: str, body: dict, headers: dict, timeout: float) -> dict:
    """Stand-in endpoint: true for messages with an even number of characters."""
    text = body["messages"][0]["content"]
    return {"choices": [{"message": {"content": json.dumps({"value": len(text) % 2 == 0})}}]}


@query
def classify_with_evidence(spark, sf):
    """Retrieval, evidence, messages, model call and reply check in one job."""
    answered = retrieval.answer(
        tables.benchmark_questions(spark, sf), fv.PROMPTS, Endpoint(), index=document_index(spark, sf),
        transport=length_model,
    )
    return answered.select("question_id", "prompt", "answer")


@query
def classify_plain(spark, sf):
    rows = evidence.messages_for(tables.benchmark_questions(spark, sf), fv.PROMPTS)
    return classify(rows, Endpoint(), transport=length_model).select("question_id", "prompt", "answer")


@query
def pending_after_checkpoint(spark, sf):
    """Questions x prompts without the ones saved by an earlier, stopped run."""
    questions = tables.benchmark_questions(spark, sf)
    path = new_folder(spark, "run")
    saved = questions.where(F.length("question") % 3 == 0).select(
        "question_id", F.lit(True).alias("answer"), F.lit(fv.PROMPTS[0]).alias("prompt")
    )
    retrieval.append_answers(saved, path)
    return retrieval.pairs(questions, fv.PROMPTS).join(retrieval.saved_answers(spark, path), ["question_id", "prompt"], "left_anti")


@query
def answer_stream(spark, sf):
    """Questions as arriving files, answered by the streaming form of the run."""
    base = new_folder(spark, "stream")
    tables.benchmark_questions(spark, sf).repartition(4).write.mode("append").json(f"{base}/in")
    for _ in range(2):  # the second run finds nothing left to do
        streaming.answer_stream(
            streaming.read_question_stream(spark, f"{base}/in"), fv.PROMPTS, Endpoint(), f"{base}/out",
            f"{base}/checkpoint", transport=length_model,
        ).awaitTermination()
    return retrieval.saved_answers(spark, f"{base}/out").select(
        "question_id", "prompt", (F.col("answer") == "true").alias("answer")
    )


# --- evaluation -----------------------------------------------------------------------
def sheet(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.labelled(spark, sf)
    return metrics.score_sheet(tables.six_answers(rows), tables.reference_questions(rows))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


@query
def confusion_metrics(spark, sf):
    """Answers joined with labels directly, all answers of each run."""
    rows = tables.labelled(spark, sf)
    answers = tables.six_answers(rows)
    labels = tables.reference_questions(rows).select(F.col("id").alias("question_id"), "correct_answer")
    return rounded(metrics.metrics_by(answers.join(labels, "question_id"), "condition", "prompt"))


@query
def metrics_two_scopes(spark, sf):
    return rounded(metrics.metrics_two_scopes(sheet(spark, sf)))


@query
def subgroup_metrics(spark, sf):
    return rounded(metrics.subgroup_metrics(sheet(spark, sf)))


@query
def subgroup_view(spark, sf):
    """Group rows of a kind with at least 5 questions."""
    rows = metrics.subgroup_metrics(sheet(spark, sf))
    return rounded(rows.where((F.col("group_type") == "cancer") & (F.col("n") >= 5)).select(
        "group", "n", "condition", "prompt", "prevalence", "accuracy", "recall", "specificity", "balanced_accuracy"
    ))


@query
def group_metrics_largest(spark, sf):
    """The twelve largest groups only."""
    return metrics.group_metrics(metrics.long_answers(sheet(spark, sf), "correct_answer", "cancer"), "cancer", 12)


@query
def metric_table_read_back(spark, sf):
    """The metrics table saved as CSV and read with its types."""
    path = new_folder(spark, "metrics")
    writers.write_csv(metrics.metrics_two_scopes(sheet(spark, sf)), path, fv.METRIC_FIELDS, single_file=True)
    read = readers.read_metric_table(spark, path)
    return read.select("scope", "condition", "prompt", "n", "tp", "fn",
                       *[F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_millionths") for c in ("coverage", "accuracy", "recall")])


@query
def group_metrics_simple(spark, sf):
    long = metrics.long_answers(sheet(spark, sf), "correct_answer", "cancer")
    return metrics.group_metrics(long, "cancer")


@query
def common_prompt_metrics(spark, sf):
    return metrics.common_metrics(sheet(spark, sf), "non_rag")


@query
def class_balance(spark, sf):
    return metrics.class_balance(tables.reference_questions(tables.labelled(spark, sf)))


@query
def paired_outcomes(spark, sf):
    return rounded(paired.paired_comparison(sheet(spark, sf)).drop("mcnemar_exact_p"))


@query
def mcnemar_exact(spark, sf):
    return rounded(paired.paired_comparison(sheet(spark, sf)).select(
        "prompt", "rag_only_correct", "non_rag_only_correct", "mcnemar_exact_p"
    ))


@query
def comparison_ranges(spark, sf):
    return rounded(paired.ranges(paired.paired_comparison(sheet(spark, sf))))


@query
def best_by_metric(spark, sf):
    rows = metrics.metrics_two_scopes(sheet(spark, sf))
    return rounded(paired.best_runs(rows, "accuracy", "recall", "specificity", "balanced_accuracy"))


@query
def six_way_common(spark, sf):
    return paired.common_ids(sheet(spark, sf))


@query
def predictions_wide(spark, sf):
    return paired.audit_rows(sheet(spark, sf))


@query
def disagreements(spark, sf):
    return paired.disagreements(sheet(spark, sf))


@query
def prompt_disagreements(spark, sf):
    return paired.prompt_disagreements(sheet(spark, sf), "non_rag")


@query
def errors(spark, sf):
    return metrics.mistakes(sheet(spark, sf))


@query
def wrong_ids_in_order(spark, sf):
    """Wrong answers of one run with their place in ID order."""
    wrong = metrics.mistakes(sheet(spark, sf)).where("condition = 'rag' and prompt = 'oncology_expert'")
    return grouping.with_position(wrong.select("question_id"), tx.sort_key(F.col("question_id")))


@query
def wrong_ids_dataset_order(spark, sf):
    """Wrong answers of one run in the order of the question file, which is not that of the IDs."""
    rows = tables.labelled(spark, sf)
    questions = tables.reference_questions(rows).withColumn("question_ord", F.col("id").cast("long") * 7919 % 1000003)
    wrong = metrics.mistakes(metrics.score_sheet(tables.six_answers(rows), questions))
    wrong = wrong.where("condition = 'rag' and prompt = 'oncology_expert'").select("question_id", "question_ord")
    return grouping.with_position(wrong, [F.col("question_ord")]).select("question_id", "position")


@query
def agreement_metrics(spark, sf):
    """Negative predictive value and Matthews correlation of each run."""
    long = metrics.long_answers(sheet(spark, sf), "correct_answer")
    return metrics.metrics_by(long, "condition", "prompt").withColumns(stats.agreement_columns()).select(
        "condition", "prompt", F.round("negative_predictive_value", 9).alias("npv"), F.round("matthews", 9).alias("matthews")
    )


@query
def id_sort(spark, sf):
    """Place of mixed IDs: numbers by value, then the others by text."""
    ids = tables.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x-"), F.col("doc_id")))
        .when(F.col("doc_id") % 4 == 1, F.lpad(F.col("doc_id").cast("string"), 12, "0"))
        .otherwise(F.col("doc_id").cast("string")).alias("question_id")
    )
    return grouping.with_position(ids, tx.sort_key(F.col("question_id")))


@query
def csv_metrics(spark, sf):
    """The metrics table as its CSV cells: six decimals, blank where undefined."""
    return writers.csv_columns(metrics.metrics_two_scopes(sheet(spark, sf)), fv.METRIC_FIELDS)


@query
def validation_violations(spark, sf):
    """Answers with unknown IDs, repeats and bad values, found by the rules."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    known = tables.reference_questions(tables.labelled(spark, sf))
    answers = tables.six_answers(docs).withColumn(
        "answer_text",
        F.when(F.col("question_id").endswith("7"), "maybe").otherwise(F.col("answer").cast("string")),
    )
    repeats = answers.where(F.col("question_id").endswith("3"))
    answers = answers.unionByName(repeats).withColumn("answer", messages.parse_boolean(F.col("answer_text")))
    return validate.answer_violations(answers, known)


@query
def question_violations(spark, sf):
    """Question files, one JSON array per thousand documents, written, read back and checked by every rule."""
    rows = tables.table(spark, sf, "labels").join(tables.table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    i = F.col("doc_id")
    shown = F.when(i % 11 == 0, " ").when(i % 13 == 0, F.concat(F.lit(" "), (i - i % 13).cast("string"), F.lit(" "))).otherwise(i.cast("string"))
    item = F.to_json(F.struct(
        shown.alias("id"), F.when(i % 7 != 0, F.col("lang")).alias("split"), F.when(i % 21 != 0, F.col("source")).alias("cancer"),
        F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit("doc "), i)).alias("question"),
        F.when(i % 3 == 0, (F.col("quality") == 1)).alias("correct_answer"),
    ))
    # A label that is text or a number, and items that are no objects.
    item = F.when(i % 3 == 1, F.regexp_replace(item, r"\}$", ',"correct_answer":"true"}')).when(
        i % 3 == 2, F.regexp_replace(item, r"\}$", ',"correct_answer":1}')).otherwise(item)
    item = F.when(i % 17 == 0, F.lit("[1]")).otherwise(item)
    folder = new_folder(spark, "questions")
    (
        rows.groupBy(F.floor(i / 1000).alias("file")).agg(F.array_sort(F.collect_list(F.struct(i, item.alias("item")))).alias("items"))
        .select("file", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]")).alias("value"))
        .repartition("file").write.partitionBy("file").text(folder)
    )
    found = readers.read_questions(spark, folder)
    return validate.question_violations(found).groupBy("rule", "detail").agg(F.count("*").alias("violations"), F.min("key").alias("first_key"))


@query
def page_json_shapes(spark, sf):
    """Page files of all root shapes, with odd names, written, read back and traced to their files."""
    i = F.col("doc_id")
    page = F.to_json(F.struct(
        F.concat(F.lit("Page "), i).alias("title"), F.concat(F.lit("doc://"), i).alias("url"),
        F.when(i % 5 == 0, F.col("lang")).alias("cancer_type"),
        F.array(F.struct(
            F.lit("S").alias("section"), F.array(F.lit("S"), F.col("source")).alias("section_path"), "text",
            F.when(i % 4 == 0, "True").when(i % 4 == 1, "false").alias("is_boilerplate"),
        )).alias("sections"),
    ))
    rows = tables.documents(spark, sf).select("doc_id", page.alias("page"), F.floor(i / 100).alias("group"))
    kind, alone = F.col("group") % 2, i % 100 == 7
    name = F.concat(F.lit("part a+b%20 é "), F.col("group"), F.lit(".json"))
    # Per hundred documents: an object with pages, or a list, with items that are no pages; and a page by itself.
    lines = rows.select(
        F.when(alone, F.concat(F.lit("one "), i, F.lit(".json"))).otherwise(name).alias("file"), i.alias("place"),
        F.when(alone, F.col("page")).otherwise(F.concat("page", F.lit(","))).alias("line"),
    )
    groups = rows.where(~alone).select("group").distinct()
    ends = groups.select(name.alias("file"), F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("place"),
                 F.when(kind == 0, '{"cancer_type":"outer","pages":[').otherwise("[5,").alias("line")),
        F.struct(F.lit(1 << 62).alias("place"), F.when(kind == 0, '"no page"]}').otherwise("null]").alias("line")),
    )))
    folder = new_folder(spark, "page-files")
    writers.write_lines(lines.unionByName(ends), folder)
    read = readers.read_page_json(spark, [folder])
    section = F.get("sections", F.lit(0))
    return read.select(
        "url", "title", "cancer_type", F.element_at(F.split("source_file", "/"), -1).alias("file"), section["is_boilerplate"].alias("is_boilerplate"),
        F.array_join(section["section_path"], " > ").alias("path"), F.sha2(section["text"], 256).alias("text_hash"),
    )


@query
def answer_file_checks(spark, sf):
    """The six answer files of the experiment, written, read back and checked; blanks, case and bad values included."""
    rows = tables.six_answers(tables.labelled(spark, sf))
    i = F.col("question_id").cast("long")
    said = F.when(i % 9 == 0, F.concat(F.lit("\" "), F.upper(F.col("answer").cast("string")), F.lit("\""))).when(
        i % 31 == 0, "yes").otherwise(F.col("answer").cast("string"))
    shown = F.when(i % 4 == 0, F.concat(F.lit("\" "), "question_id", F.lit(" \""))).otherwise(F.col("question_id"))
    line = F.concat(shown, F.lit(","), said)
    file = F.concat("condition", F.lit("/answers_"), "prompt", F.lit(".csv"))
    head = rows.select(file.alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("place"), F.lit("question_id,answer").alias("line"))
    folder = new_folder(spark, "answer-files")
    writers.write_lines(rows.select(file.alias("file"), i.alias("place"), line.alias("line")).unionByName(head), folder)
    read = readers.read_experiment(spark, {c: f"{folder}/{c}" for c in fv.CONDITIONS})
    return read.groupBy("condition", "prompt").agg(
        F.count("*").alias("answers"), F.count_if("answer").alias("yes"), F.count_if(~F.col("answer")).alias("no"),
        F.count_if(F.col("answer").isNull()).alias("invalid"), F.sum(F.col("question_id").cast("long")).alias("id_sum"),
    )


@query
def missing_answers(spark, sf):
    rows = tables.labelled(spark, sf)
    finished = tables.six_answers(rows).where("condition = 'rag' and prompt = 'basic'").select("question_id")
    return validate.missing_answers(rows.select(F.col("doc_id").cast("string").alias("question_id")), finished)


# --- web pages ----------------------------------------------------------------------------
@query
def canonical_urls(spark, sf):
    pages = tables.table(spark, sf, "pages")
    return pages.select("page_id", web.canonical_url(F.col("url")).alias("url"),
                        web.raw_html_key(F.col("url")).alias("cache_key"))


@query
def content_urls(spark, sf):
    pages = tables.titled_pages(spark, sf).unionByName(
        tables.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"), allowMissingColumns=True
    )
    return pages.select("url", web.is_content_url(F.col("url")).alias("is_content"))


@query
def audience_topic_derivation(spark, sf):
    pages = tables.titled_pages(spark, sf)
    name = web.strip_title_suffix(F.col("title"))
    return pages.select(
        "doc_id", name.alias("summary_name"), web.audience(F.col("url"), F.col("title")).alias("audience"),
        web.topic(F.col("collections")).alias("topic"), web.entity_name(name, F.col("collections")).alias("cancer_type"),
    )


@query
def last_updated(spark, sf):
    """A date line put into every document text, in several spellings."""
    i = F.col("doc_id")
    day = F.concat((i % 28 + 1).cast("string"), F.lit(", "), (i % 30 + 1995).cast("string"))
    line = (
        F.when(i % 4 == 0, F.concat(F.lit(" Updated: March "), day))
        .when(i % 4 == 1, F.concat(F.lit(" Reviewed: july  "), day))
        .when(i % 4 == 2, F.concat(F.lit(" reviewed: May "), day, F.lit(" UPDATED:\nAugust "), day))
        .otherwise(F.concat(F.lit(" Updated: Sometime "), day))
    )
    return tables.documents(spark, sf).select(
        "doc_id", tx.first_match_date(tx.normalize_ws(F.concat("text", line))).alias("last_updated")
    )


def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages, _ = crawl.parse(tables.html_pages(spark, sf))
    return store(pages, "parsed")


@query
def page_title(spark, sf):
    """One narrow reader: only the scan is stored, and no section is built."""
    return crawl.parse(tables.html_pages(spark, sf))[0].select("url", "title")


@query
def page_records(spark, sf):
    """Parsed pages without their sections and reading time."""
    return parsed_pages(spark, sf).select(
        "url", "topic", "audience", "language", "cancer_type", "summary_name", "last_updated", "content_sha256",
        F.col("section_count").cast("long").alias("section_count"), "raw_html_file",
    )


@query
def html_sections(spark, sf):
    return parsed_pages(spark, sf).select("url", F.posexplode_outer("sections").alias("pos", "s")).where("pos is not null").select(
        "url", F.col("pos").cast("long").alias("pos"), "s.section", F.array_join("s.section_path", " > ").alias("path"),
        "s.is_boilerplate", F.col("s.block_count").cast("long").alias("block_count"), "s.text",
    )


@query
def html_heading_levels(spark, sf):
    """Sections of pages with a main part, tables, notices and headings of all levels."""
    pages, _ = crawl.parse(tables.marked_up(spark, sf))
    return pages.select("url", "title", F.posexplode_outer("sections").alias("pos", "s")).where("pos is not null").select(
        "url", "title", F.col("pos").cast("long").alias("pos"), "s.section", F.array_join("s.section_path", " > ").alias("path"),
        "s.is_boilerplate", F.col("s.block_count").cast("long").alias("block_count"), F.sha2("s.text", 256).alias("text_hash"),
    )


@query
def html_links(spark, sf):
    """Links of all pages, grouped by target."""
    index = tables.html_pages(spark, sf).select("url", "html", F.col("collections")[0].alias("collection"))
    # Stored between its two Python steps, so that a task has one worker at a time.
    scanned = store(html.scan_pages(index).select("url", "collection", F.struct("scan.links").alias("scan")), "scanned")
    facts = store(discovery.link_facts(discovery.links(scanned), only_content=False), "facts")
    # Origins have no bound here, so they are counted and not listed.
    listed = discovery.discover(facts.where("kind <> 'from'"))
    return discovery.link_counts(facts).select("url", "origins").join(listed, "url").select(
        "url", F.array_join("collections", "|").alias("collections"),
        F.array_join("index_link_labels", "|").alias("labels"), "origins",
    )


@query
def group_pages_by_entity(spark, sf):
    """Entity documents, line by line: the page at each place and the number of pages."""
    lines = writers.document_lines(named_pages(spark, sf))
    opening = lines.where("place = 0").select(
        F.col("is_specific").alias("kind"), F.col("entity").alias("name"), F.col("part").alias("own_part"),
        F.get_json_object(F.concat("line", F.lit("]}")), "$.page_count").cast("long").alias("page_count"),
    )
    same = (F.col("is_specific") == F.col("kind")) & (F.col("entity") == F.col("name")) & (F.col("part") == F.col("own_part"))
    # A row per document.
    return lines.join(broadcast_if_small(opening), same).where("place between 1 and page_count").select(
        "is_specific", "entity", "part", "place", "page_count", F.get_json_object(F.ltrim("line", F.lit(",")), "$.url").alias("url")
    )


def named_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.titled_pages(spark, sf)
    name = web.strip_title_suffix(F.col("title"))
    return pages.select(
        web.topic(F.col("collections")).alias("topic"), web.audience(F.col("url"), F.col("title")).alias("audience"),
        "title", name.alias("summary_name"), web.entity_name(name, F.col("collections")).alias("cancer_type"), "url",
    )


@query
def manifest_counts(spark, sf):
    rows = writers.entity_manifest(named_pages(spark, sf))
    return rows.select(
        "is_specific", "entity", "page_count", F.array_join("topics", "|").alias("topics"),
        F.array_join("audiences", "|").alias("audiences"), "file",
    )


@query
def slugify(spark, sf):
    words = tables.documents(spark, sf).select(
        F.explode(F.split("text", "\n")).alias("name")
    ).distinct()
    return words.select("name", tx.slugify("name").alias("slug"))


@query
def cached_pages(spark, sf):
    """Pages joined with the snapshots saved for https addresses."""
    pages = tables.table(spark, sf, "pages").select("page_id", "url", "html")
    path = new_folder(spark, "raw_html")
    saved = pages.where(F.col("url").startswith("https"))
    writers.write_snapshots(saved, path)
    joined = readers.with_cached_html(pages.drop("html"), spark.read.parquet(path))
    return joined.select("page_id", "key", F.length("html").cast("long").alias("html_length"))


@query
def robots_allowed(spark, sf):
    """Groups of two agents, with rules that overlap: the first that fits decides."""
    rules = (
        "User-agent: other\nDisallow: /\n\nUser-agent: corpuslens\nAllow: /fr/1\nDisallow: /fr/\nDisallow: /de/1\n"
        "Allow: /de/\n\nUser-agent: *\nDisallow: /es/\n"
    )
    pages = tables.table(spark, sf, "pages").select("page_id", "url")
    return discovery.allowed_by_robots(pages, rules, "corpuslens").select("page_id", "allowed")


@query
def useful_first_section(spark, sf):
    return chunks.first_section(parsed_pages(spark, sf)).where("section is not null").select(
        "url", "section", F.sha2("text", 256).alias("text_hash")
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence passages retrieved for every question."""
    return bm25_topk(spark, sf)


# --- incremental refresh ----------------------------------------------------------
def refreshed_corpus(spark: SparkSession, sf: str) -> refresh.Corpus:
    """A corpus after two crawls."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CORPORA:
        corpus = refresh.Corpus.open(spark, new_folder(spark, "corpus"), n_buckets=16)
        for pages in (tables.document_pages(spark, sf), tables.second_crawl(spark, sf)):
            corpus = refresh.refresh(corpus, pages)
        _CORPORA[key] = corpus
    return _CORPORA[key]


@query
def refresh_changes(spark, sf):
    return refreshed_corpus(spark, sf).read("changes").select(F.col("version").cast("long").alias("version"), "url", "kind")


@query
def refresh_commits(spark, sf):
    kinds = ("new", "changed", "removed", "unchanged")
    return refreshed_corpus(spark, sf).commits().select(F.col("version").cast("long").alias("version"), "n_chunks", "total_len", *kinds)


@query
def refresh_term_df(spark, sf):
    return refreshed_corpus(spark, sf).terms()


@query
def refresh_topk(spark, sf):
    hits = bm25.search(tables.benchmark_questions(spark, sf), refreshed_corpus(spark, sf).index())
    return hits.select("question_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- chunks by tokens ---------------------------------------------------------------
@query
def token_chunk_ids(spark, sf):
    cut = token_chunks.chunk_pages(tables.sectioned_pages(spark, sf))
    return cut.select(
        F.col("load_order").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "section",
        F.size("sections").cast("long").alias("n_sections"), F.col("n_tokens").cast("long").alias("n_tokens"),
    )


# --- dense retrieval ------------------------------------------------------------------
@query
def dense_topk(spark, sf):
    """Every fiftieth vector against all."""
    vectors = tables.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    hits = dense.search(asked, dense.build_index(vectors))
    return hits.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _topk_lists(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Twenty chunks a question by BM25, and by the vectors with the question's and the document's number."""
    index = document_index(spark, sf)
    questions = tables.benchmark_questions(spark, sf)
    vectors = tables.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.join(questions.select(F.col("question_id").cast("long").alias("vec_id"), "question_id"), "vec_id").select(
        F.col("question_id").alias("query_id"), "vector")
    near = dense.search(asked, dense.build_index(vectors)).select(F.col("query_id").alias("question_id"), "vec_id", "rank")
    firsts = index.chunks.where("chunk_index = 0").select(F.col("load_order").alias("vec_id"), "chunk_id")
    return {
        "bm25": bm25.search(questions, index, 20).select("question_id", "chunk_id", "rank"),
        "dense": firsts.join(broadcast_if_small(near), "vec_id").select("question_id", "chunk_id", "rank"),
    }


@query
def rrf_fusion(spark, sf):
    fused = ranking.fuse(_topk_lists(spark, sf))
    return fused.select(
        "question_id", "chunk_id", F.round("score", 8).alias("score"), F.array_join("sources", "+").alias("sources"), F.col("rank").cast("long").alias("rank"))


# --- ranked lists -----------------------------------------------------------------------
@query
def metadata_boost(spark, sf):
    """Questions that name sources and languages, in words of one and two tokens."""
    i = F.col("item_id")
    named = F.when(i % 4 == 0, F.concat(F.lit(" source src"), i % 20)).when(i % 4 == 1, F.concat(F.lit(" about src"), i % 20)).when(
        i % 4 == 2, F.concat(F.lit(" topic src"), i % 20)).otherwise("")
    rows = tables.table(spark, sf, "benchmark").select(i.cast("string").alias("question_id"), F.concat("text", named).alias("question"))
    sources = tables.table(spark, sf, "documents").select("source").distinct()
    terms = sources.select(F.inline(F.array(
        F.struct(F.concat(F.lit("Source "), "source").alias("term"), F.lit("entity").alias("kind"), F.col("source").alias("value")),
        F.struct(F.col("source").alias("term"), F.lit("alias").alias("kind"), F.col("source").alias("value")),
        F.struct(F.concat(F.lit("topic "), "source").alias("term"), F.lit("topic").alias("kind"), F.col("source").alias("value")),
    )))
    index = document_index(spark, sf)
    hits = store(bm25.search(tables.benchmark_questions(spark, sf), index, 30), "hits")
    boosted = ranking.boost(hits, index.chunks, ranking.named_terms(rows, terms), audiences={"en": 1.0, "fr": 0.85})
    return boosted.select("question_id", "chunk_id", F.round("score", 4).alias("score"), "level", F.col("rank").cast("long").alias("rank"))


@query
def diversity_cap(spark, sf):
    """Pages and sections are those of the documents' source and language."""
    index = document_index(spark, sf)
    places = index.chunks.select("chunk_id", F.col("topic").alias("url"), F.array("audience").alias("section_path"))
    hits = bm25.search(tables.benchmark_questions(spark, sf), index, 20)
    kept = ranking.diverse(hits, places)
    return kept.select("question_id", "chunk_id", F.col("old_rank").cast("long").alias("old_rank"), "filled", F.col("rank").cast("long").alias("rank"))


def leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(tables.benchmark_questions(spark, sf), document_index(spark, sf).chunks)


@query
def retrieval_metrics(spark, sf):
    """Ranks of BM25 against the chunks that hold the question's passage: whole 2, most of it 1."""
    judged = leaked_items(spark, sf).select("question_id", "chunk_id", F.when(F.col("kind") == "near", 1).otherwise(2).alias("grade"))
    hits = bm25.search(tables.benchmark_questions(spark, sf), document_index(spark, sf), 20)
    found = ranking.retrieval_metrics(hits, judged)
    rates = ("recall_5", "recall_10", "reciprocal_rank", "ndcg_10")
    return found.select("question_id", "n_relevant", *[F.round(c, 6).alias(c) for c in rates])


# --- audits -----------------------------------------------------------------------------
@query
def leakage_near(spark, sf):
    return leaked_items(spark, sf).select("question_id", "chunk_id", "kind", F.round("containment", 6).alias("containment"))


def labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf).select("doc_id", "text")
    return tables.table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), (F.col("toxic") == 1).alias("label"))


@query
def label_conflicts(spark, sf):
    return leakage.label_conflicts(labelled_texts(spark, sf))


@query
def near_label_conflicts(spark, sf):
    return leakage.near_conflicts(labelled_texts(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query
def grouped_partitions(spark, sf):
    """Copies stay together; language and quality are balanced."""
    rows = labelled_texts(spark, sf).join(tables.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id").join(
        tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    grouped = rows.select("id", F.md5(F.col("question").cast("binary")).alias("group"), F.concat_ws("/", "lang", "quality").alias("stratum"))
    return partitioning.with_parts(grouped).select(F.col("id").alias("doc_id"), F.col("part").cast("long").alias("part"))


@query
def integrity_report(spark, sf):
    """A file and a page per document; some listed under another name, size or digest, some pages without a field."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("d/"), i, F.lit(".json"))
    docs = tables.documents(spark, sf)
    files = docs.select(path.alias("path"), F.length(text).cast("long").alias("size"), F.md5(text.cast("binary")).alias("digest"))
    listed = docs.select(
        F.when(i % 7 == 0, F.concat(F.lit("old/"), path)).otherwise(path).alias("path"),
        (F.length(text) + F.when(i % 13 == 2, 1).otherwise(0)).cast("long").alias("size"),
        F.when(i % 11 == 1, "0").otherwise(F.md5(text.cast("binary"))).alias("digest"),
    )
    sections = F.array(F.struct((i % 17 == 5).alias("is_boilerplate"), F.col("text").alias("text")))
    pages = docs.select(
        F.when(i % 23 == 3, F.concat(F.lit("lost/"), path)).otherwise(path).alias("path"),
        F.when(i % 19 == 4, "doc://same").when(i % 29 == 6, " ").otherwise(F.concat(F.lit("doc://"), i)).alias("url"),
        F.when(i % 31 != 7, F.concat(F.lit("Document "), i)).alias("title"), F.col("source").alias("topic"), F.col("lang").alias("audience"),
        F.md5(text.cast("binary")).alias("content_sha256"), sections.alias("sections"),
    )
    return integrity.integrity_report(listed, files, pages)
