"""Readers: page JSON, question files, answer files, saved runs, raw HTML."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import messages
from corpuslens.functions import text as tx
from corpuslens.functions import web


class InvalidInput(ValueError):
    """An input breaks a rule that has to hold before anything is computed."""


def _json_glob(spark: SparkSession, folder: str) -> str | None:
    """Pattern of the folder's JSON files; None where it has none."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path, pattern = jvm.Path(folder), f"{folder.rstrip('/')}/*.json"
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"folder does not exist: {folder}")
    return pattern if fs.globStatus(jvm.Path(pattern)) else None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def read_page_json(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Page rows of all ``*.json`` files in ``folders`` (not in subfolders).

    A file may hold ``{"pages": [...]}``, a plain list of pages or one page;
    anything that is not an object is skipped. Files are ordered by path parts.
    """
    paths = [p for p in (_json_glob(spark, folder) for folder in folders) if p]
    if not paths:
        raise FileNotFoundError("no page JSON files were found")
    raw = spark.read.text(paths, wholetext=True).select(
        F.parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file")
    )
    wrapped = F.try_variant_get("v", "$.pages", "variant")
    is_wrapper = _is(F.col("v"), "OBJECT") & _is(wrapped, "ARRAY")
    pages = raw.select(
        F.url_decode(F.regexp_replace(F.regexp_replace("file", "^file:/+", "/"), r"\+", "%2B")).alias("source_file"),
        F.when(_is(F.col("v"), "OBJECT"), _text(F.col("v"), "$.cancer_type")).alias("outer_type"),
        F.posexplode(
            F.when(is_wrapper, F.try_variant_get("v", "$.pages", "array<variant>"))
            .when(_is(F.col("v"), "ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
            .otherwise(F.array("v"))
        ).alias("page_index", "p"),
    ).where(_is(F.col("p"), "OBJECT"))
    p = F.col("p")

    def one_section(s: Column) -> Column:
        path = F.try_variant_get(s, "$.section_path", "variant")
        parts = F.when(_is(path, "ARRAY"), F.try_variant_get(s, "$.section_path", "array<string>")).when(
            _is(path, "STRING"), F.array(_text(s, "$.section_path"))
        )
        return F.struct(
            _text(s, "$.section").alias("section"),
            parts.alias("section_path"),
            _flag(s).alias("is_boilerplate"),
            F.try_variant_get(s, "$.block_count", "int").alias("block_count"),
            _text(s, "$.text").alias("text"),
        )

    sections = F.when(
        _is(F.try_variant_get(p, "$.sections", "variant"), "ARRAY"),
        F.transform(
            F.filter(F.try_variant_get(p, "$.sections", "array<variant>"), lambda s: _is(s, "OBJECT")),
            one_section,
        ),
    )
    names = ["topic", "audience", "language", "title", "summary_name", "url", "last_updated", "content_sha256"]
    lists = ["collections", "discovered_from", "index_link_labels"]
    return pages.select(
        *[_text(p, f"$.{n}").alias(n) for n in names],
        F.coalesce(tx.truthy(_text(p, "$.cancer_type")), F.col("outer_type")).alias("cancer_type"),
        *[F.try_variant_get(p, f"$.{n}", "array<string>").alias(n) for n in lists],
        F.try_variant_get(p, "$.section_count", "int").alias("section_count"),
        sections.alias("sections"),
        "source_file",
        F.struct(F.split("source_file", "/").alias("file"), "page_index").alias("load_order"),
    )


def _flag(section: Column) -> Column:
    """is_boilerplate with loose truth: missing, null, false, 0, '' and empty are no."""
    text = F.coalesce(_text(section, "$.is_boilerplate"), F.lit(""))
    return ~F.lower(text).isin("", "false", "0", "0.0", "[]", "{}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_ord, id, split, cancer, question, correct_answer and raw type
    facts (``fields``, ``answer_type``) of a JSON array file, or of all in a folder."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"question file does not exist: {path}")
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    if raw.where(~_is(F.col("v"), "ARRAY")).count():
        raise InvalidInput("the question file must be a JSON array")
    rows = raw.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("question_ord", "q"))
    q = F.col("q")
    return rows.select(
        "question_ord",
        _is(q, "OBJECT").alias("is_object"),
        F.json_object_keys(F.to_json("q")).alias("fields"),
        F.schema_of_variant(F.try_variant_get(q, "$.correct_answer", "variant")).alias("answer_type"),
        tx.strip(_text(q, "$.id")).alias("id"),
        *[_text(q, f"$.{n}").alias(n) for n in ("split", "cancer", "question")],
        F.try_variant_get(q, "$.correct_answer", "boolean").alias("correct_answer"),
    )


def first_questions(questions: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` questions in file order; all for None."""
    if n is None:
        return questions
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("the number of questions must be an integer")
    total = questions.count()
    if not 1 <= n <= total:
        raise InvalidInput(f"the number of questions must be between 1 and {total}")
    return questions.where(F.col("question_ord") < n)


def _has_bom(spark: SparkSession, path: str) -> bool:
    """True for a file that begins with a byte-order mark (readers drop it)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(jvm_path).isDirectory():
        return False
    stream = fs.open(jvm_path)
    try:
        return bytes(max(stream.read(), 0) for _ in range(3)) == b"\xef\xbb\xbf"
    finally:
        stream.close()


def check_header(spark: SparkSession, path: str, allow_bom: bool = True) -> None:
    """Header must be exactly the two answer columns, in order."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    if [c.strip('"') for c in line.split(",")] != fv.ANSWER_COLUMNS or (not allow_bom and _has_bom(spark, path)):
        raise InvalidInput(f"{path} must have the columns {','.join(fv.ANSWER_COLUMNS)}")


def read_answers(
    spark: SparkSession, path: str, *, allow_bom: bool = True, allow_empty: bool = False
) -> DataFrame:
    """question_id (stripped), answer (text) and parsed Boolean of an answer CSV."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"answer file does not exist: {path}")
    check_header(spark, path, allow_bom)
    rows = spark.read.schema("question_id string, answer string").csv(path, header=True, enforceSchema=True)
    rows = rows.select(
        tx.strip(F.coalesce("question_id", F.lit(""))).alias("question_id"),
        F.coalesce("answer", F.lit("")).alias("answer_text"),
    ).withColumn("answer", messages.parse_boolean(F.col("answer_text")))
    if not allow_empty and rows.isEmpty():
        raise InvalidInput(f"answer file is empty: {path}")
    return rows


def read_experiment(spark: SparkSession, folders: dict[str, str], **options) -> DataFrame:
    """Long table of the answers of every condition and prompt.

    ``folders`` maps a condition to the folder of its ``answers_<prompt>.csv``.
    """
    frames = [
        read_answers(spark, f"{folder}/answers_{prompt}.csv", **options).select(
            F.lit(condition).alias("condition"), F.lit(prompt).alias("prompt"),
            "question_id", "answer", "answer_text",
        )
        for condition, folder in folders.items()
        for prompt in fv.PROMPTS
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def read_finished(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """question_id of the answers saved so far; nothing yet gives no rows.

    Values must be exactly true or false. ``strict`` also strips IDs and
    refuses repeated ones.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "question_id string")
    raw = spark.read.text(path)
    if raw.isEmpty():
        return spark.createDataFrame([], "question_id string")
    check_header(spark, path, allow_bom=False)
    rows = spark.read.schema("question_id string, answer string").csv(path, header=True, enforceSchema=True)
    if strict:
        rows = rows.withColumn("question_id", tx.strip(F.col("question_id")))
        repeated = rows.groupBy("question_id").count().where("count > 1").first()
        if repeated:
            raise InvalidInput(f"repeated question_id {repeated[0]} in {path}")
    bad = rows.where(F.col("answer").isNull() | ~F.col("answer").isin("true", "false")).first()
    if bad:
        raise InvalidInput(f"invalid answer for question_id {bad[0]} in {path}")
    return rows.select("question_id")


def read_metric_table(spark: SparkSession, path: str, fields: list[str] = fv.METRIC_FIELDS) -> DataFrame:
    """A saved table of metrics with its types: counts are whole, rates are doubles, blank ones NULL.

    The header must name ``fields`` in order.
    """
    texts, counts = ("scope", "condition", "prompt", "group_type", "group"), ("n", "tp", "tn", "fp", "fn", "positives")
    kinds = {f: "string" if f in texts else "long" if f in counts else "double" for f in fields}
    first = spark.read.text(path).first()
    if first is None or first[0].split(",") != fields:
        raise InvalidInput(f"{path} must have the columns {','.join(fields)}")
    return spark.read.schema(", ".join(f"`{f}` {k}" for f, k in kinds.items())).csv(path, header=True)


def with_cached_html(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``html`` from saved snapshots (key, html); NULL where none is saved.

    One row per page: of several snapshots of an address the last one counts (by ``saved_at``,
    where the cache has it), and of those saved together the one that is largest as text.
    """
    saved_at = F.col("saved_at") if "saved_at" in cache.columns else F.lit(None).cast("timestamp")
    last = cache.groupBy("key").agg(F.max(F.struct(saved_at.alias("at"), F.col("html").alias("html"))).alias("last"))
    return (
        pages.withColumn("key", web.raw_html_key(F.col("url")))
        .join(last.select("key", "last.html"), "key", "left")
    )


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 of whole files, one task per file; files are streamed, so
    their size does not matter."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for path in batch["path"]:
                files, inner = FileSystem.from_uri(path)
                total = hashlib.sha256()
                with files.open_input_stream(inner) as stream:
                    while block := stream.read(1 << 20):
                        total.update(block)
                sums.append(total.hexdigest())
            yield batch.assign(sha256=sums)

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(len(paths), "path").mapInPandas(digest, "path string, sha256 string")
