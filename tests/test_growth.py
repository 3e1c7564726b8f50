"""What a task holds does not grow with the tables: buckets, written files, scans of pages."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens import session
from corpuslens.operators import bm25, chunks, html
from corpuslens.plans import refresh
from corpuslens.sources import readers, writers

PAGE = ("title string, summary_name string, cancer_type string, topic string, audience string, url string, source_file string, "
        "load_order long, sections array<struct<section:string,section_path:array<string>,is_boilerplate:boolean,block_count:int,text:string>>")


@pytest.fixture
def pages(spark):
    rows = [(f"t{i}", None, None, "a", "b", f"u{i}", "f", i, [("s", ["s"], False, 1, f"alpha beta{i % 5} only{i}")]) for i in range(60)]
    return spark.createDataFrame(rows, PAGE)


def test_one_row_per_page_with_several_snapshots(spark, tmp_path):
    """an address that was saved twice gave two rows."""
    seen = spark.createDataFrame([("https://a/1", "<p>old"), ("https://a/1", "<p>older"), ("https://a/2", "<p>x")], "url string, html string")
    writers.write_snapshots(seen, str(tmp_path))
    asked = spark.createDataFrame([(1, "https://a/1"), (2, "https://a/1"), (3, "https://a/3")], "page_id int, url string")
    found = lambda: {r.page_id: r.html for r in readers.with_cached_html(asked, spark.read.parquet(str(tmp_path))).collect()}
    assert readers.with_cached_html(asked, spark.read.parquet(str(tmp_path))).count() == 3
    assert found()[1] == found()[2] and found()[3] is None
    writers.write_snapshots(spark.createDataFrame([("https://a/1", "<a>new")], "url string, html string"), str(tmp_path))
    assert found() == {1: "<a>new", 2: "<a>new", 3: None}
    # A cache without times.
    old = spark.createDataFrame([(readers_key(spark, "https://a/1"), "<p>")], "key string, html string")
    assert readers.with_cached_html(asked, old).where("html = '<p>'").count() == 2
    assert isinstance(spark.read.parquet(str(tmp_path)).first().saved_at, datetime.datetime)


def readers_key(spark, url):
    from corpuslens.functions import web

    return spark.createDataFrame([(url,)], "url string").select(web.raw_html_key(F.col("url"))).first()[0]


def test_buckets_grow_with_the_files(spark):
    """F7 to F17: 256 MB of files a bucket made one task hold gigabytes of scores."""
    assert session.bucket_count(spark, 1 << 30) >= 100


def test_bucketed_tables_are_written_without_a_sort(spark, pages, monkeypatch):
    """F7 to F17: shuffles have as many partitions as buckets, and no row is sorted for its file."""
    monkeypatch.setattr(session, "BUCKET_BYTES", 1)
    path = session.new_folder(spark, "pages")
    pages.write.parquet(path)
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.maxConcurrentOutputFileWriters")}
    monkeypatch.setattr(session, "bucket_count", lambda spark, size: 23)
    cut = chunks.chunk_pages(spark.read.parquet(path))
    stored = session.store_bucketed(cut, "c", "chunk_id")
    assert {n: spark.conf.get(n) for n in before} == before
    name = session._TABLES[id(stored)]
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert described["Num Buckets"] == "23" and stored.count() == 60
    # A file per bucket that has rows: joined partitions were written by fewer tasks, each with a sort.
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in stored.inputFiles()}) == len(stored.inputFiles()) > 12
    session.drop_bucketed(stored)
    with session.writing(spark, 23):
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") != "0"
        plan = cut.repartition(23, "chunk_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and ", 23)" in plan


def test_search_of_a_refreshed_corpus_moves_no_scores(spark, pages, tmp_path, plan_of):
    """the scored pairs of every question and chunk were shuffled."""
    index = refresh.refresh(refresh.Corpus.open(spark, str(tmp_path), n_buckets=4), pages).index()
    questions = spark.createDataFrame([("1", "alpha beta1"), ("2", "only7")], "question_id string, question string")
    plan = plan_of(bm25.search(questions, index))
    assert plan[: plan.index("BroadcastHashJoin")].count("Exchange") == 1 and "Bucketed: true" in plan
    name = session._TABLES[id(index.stored[0])]
    index.close()
    assert not spark.catalog.tableExists(name)


def test_postings_of_a_version_are_a_row_per_chunk_where_the_chunk_is(spark, pages, tmp_path):
    """F4, F16: rows of single tokens were shuffled and sorted by bucket."""
    corpus = refresh.refresh(refresh.Corpus.open(spark, str(tmp_path), n_buckets=4), pages)
    made, postings = corpus.read("chunks"), corpus.read("postings")
    assert postings.count() == made.count() == 60
    assert postings.select("chunk_id", "bucket").exceptAll(made.select("chunk_id", "bucket")).isEmpty()
    assert "Exchange" not in refresh._postings(made)._jdf.queryExecution().executedPlan().toString()


def test_scans_leave_the_worker_in_small_parts(monkeypatch):
    """the scans of a whole batch were held at once."""
    monkeypatch.setattr(html, "SCAN_CHARS", 100)
    texts = pd.Series(["<p>" + "x" * (i % 60) + "</p>" for i in range(50)] + [None, "<h1>t</h1>"])
    parts = list(html.scan_html.func(iter([texts, texts[:0], texts[:1]])))
    assert max(len(p) for p in parts) < 20 and len(parts) > 10
    rows = pd.concat(parts, ignore_index=True)
    assert len(rows) == 53 and rows["error"].notna().sum() == 1 and rows["title"][51] == "t"
    assert list(rows["full_text"][:3]) == ["", "x", "xx"]


def test_pages_go_to_python_in_small_batches(spark):
    """ten thousand pages were sent at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, wanted in (("10000", session.ARROW_ROWS), ("0", session.ARROW_ROWS), ("7", 7)):
            spark.conf.set(name, given)
            html.scan_pages(spark.createDataFrame([("<p>",)], "html string"))
            assert int(spark.conf.get(name)) == wanted
    finally:
        spark.conf.set(name, before)


def test_candidates_share_several_tokens(spark, monkeypatch):
    """one shared token made a pair, whose token sets were then moved; counts past the limit leave the result as it is."""
    from corpuslens.operators import leakage

    def text(i):
        return " ".join(f"w{(i * 7 + j * (1 + i % 3)) % 60}" for j in range(20))

    left = spark.createDataFrame([(f"l{i}", text(i)) for i in range(40)], "id string, text string")
    right = spark.createDataFrame([(f"r{i}", text(i + 20)) for i in range(40)], "id string, text string")
    stored, store = {}, session.store
    monkeypatch.setattr(leakage, "store", lambda df, name: stored.setdefault(name, store(df, name)))
    found = {n: sorted(map(tuple, leakage.similar_pairs(left, right, 0.9, "jaccard", n).collect())) for n in (500_000, 30, 1) if not stored.clear()}
    assert found[500_000] == found[30] == found[1] and found[1]
    assert stored["candidates"].count() < 4 * len(found[1])
    assert dict(stored["prefixes"].dtypes)["id"] == "bigint"
