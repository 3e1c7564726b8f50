import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.operators import bm25, chunks
from corpuslens.plans import refresh
from corpuslens.plans.refresh import Corpus

PAGE = (
    "title string, summary_name string, cancer_type string, topic string, audience string, url string, source_file string, "
    "load_order long, sections array<struct<section:string,section_path:array<string>,is_boilerplate:boolean,block_count:int,text:string>>"
)
WORDS = "cell tumour stage dose risk nodes trial care pain gene scan grade".split()


def page(url, text, order, title="T", path=("A", "B")):
    return (title, None, "c", "t", "a", url, "f.json", order, [("S", list(path), False, 1, text)])


@pytest.fixture
def pages_of(spark):
    return lambda rows: spark.createDataFrame(rows, PAGE)


def crawl(seed, n=40):
    """Pages of which a third differ from one seed to the next; one URL has many pages."""
    out = []
    for i in range(n):
        if random.Random(f"{seed} gone {i}").random() < 0.15:
            continue
        stamp = seed if random.Random(f"{seed} new {i}").random() < 0.2 else 0
        drawn = random.Random(f"{stamp} {i}")
        out.append(page(f"u{i}", " ".join(drawn.choice(WORDS) for _ in range(drawn.choice([3, 40, 900]))), len(out)))
    out += [page("hot", f"copy {i % 3} of {WORDS[seed]}", len(out) + i, path=("H", str(i % 5))) for i in range(20)]
    return out + [page("", "no url", 999), page(None, "no url", 999), ("T", None, None, None, None, "bare", "f", 1000, None), page("blank", " \n", 1001)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def assert_as_rebuilt(corpus, pages):
    index, built = corpus.index(), bm25.build_index(chunks.chunk_pages(pages))
    assert rows(index.chunks, *schemas.CHUNK_FIELDS) == rows(built.chunks, *schemas.CHUNK_FIELDS)
    assert rows(index.postings, "chunk_id", "chunk_len", "token", "tf") == rows(built.postings, "chunk_id", "chunk_len", "token", "tf")
    assert rows(index.terms, "token", "df") == rows(built.terms, "token", "df")
    assert (index.n_chunks, index.total_len) == (built.n_chunks, built.total_len)
    assert index.avg_idf == pytest.approx(built.avg_idf)
    questions = index.chunks.sparkSession.createDataFrame([("1", "tumour dose of the scan"), ("2", "copy gene")], "question_id string, question string")
    asked = ("question_id", "chunk_id", F.round("score", 6), "rank")
    assert rows(bm25.search(questions, index), *asked) == rows(bm25.search(questions, built), *asked)
    built.close()


def test_refreshed_as_rebuilt(spark, pages_of, tmp_path):
    corpus = Corpus.open(spark, str(tmp_path), n_buckets=8)
    crawls = [pages_of(crawl(seed)) for seed in (1, 2, 3)]
    for number, pages in enumerate(crawls, 1):
        corpus = refresh.refresh(corpus, pages)
        assert corpus.version == number
    assert_as_rebuilt(corpus, crawls[2])
    small = refresh.compact(corpus, most_parts=1)
    assert small.version == 4 and Corpus.open(spark, str(tmp_path)) == small
    assert_as_rebuilt(small, crawls[2])
    last = refresh.refresh(small, crawls[0])
    assert_as_rebuilt(last, crawls[0])
    # Older versions stay readable.
    assert_as_rebuilt(Corpus.open(spark, str(tmp_path), 2), crawls[1])
    assert refresh.compact(last, most_parts=9) == last
    with pytest.raises(ValueError):
        Corpus.open(spark, str(tmp_path), 9)


def test_kinds_and_written_buckets(spark, pages_of, tmp_path):
    first = [page(f"u{i}", f"text {WORDS[i % 12]} {i}", i) for i in range(40)]
    corpus = refresh.refresh(Corpus.open(spark, str(tmp_path), n_buckets=16), pages_of(first))
    second = [page(r[5], "other words" if r[5] == "u7" else r[8][0][4], 100 - r[7]) for r in first if r[5] != "u3"] + [page("u99", "fresh", 0)]
    corpus = refresh.refresh(corpus, pages_of(second))
    assert rows(corpus.read("changes").where("version = 2"), "url", "kind") == [("u3", "removed"), ("u7", "changed"), ("u99", "new")]
    commit = corpus.commits().where("version = 2").first()
    assert (commit.new, commit.changed, commit.removed, commit.unchanged) == (1, 1, 1, 38)
    bucket = {r.url: r.bucket for r in corpus.read("changes").select("url", "bucket").distinct().collect()}
    for table, urls in (("changes", {"u3", "u7", "u99"}), ("chunks", {"u7", "u99"}), ("postings", {"u7", "u99"})):
        written = {int(p.name.split("=")[1]) for p in Path(tmp_path, table, "version=2").iterdir() if p.name.startswith("bucket=")}
        assert written == {bucket[u] for u in urls}
    # Nothing changed: nothing is written but the commit.
    same = refresh.refresh(corpus, pages_of(second))
    assert not [p for t in ("changes", "chunks", "postings") for p in Path(tmp_path, t, "version=3").glob("bucket=*")]
    assert rows(same.terms(), "token", "df") == rows(corpus.terms(), "token", "df")


def test_failed_run_leaves_no_trace(spark, pages_of, tmp_path, monkeypatch):
    corpus = refresh.refresh(Corpus.open(spark, str(tmp_path), n_buckets=4), pages_of(crawl(1)))
    with monkeypatch.context() as patched:
        patched.setattr(refresh, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            refresh.refresh(corpus, pages_of(crawl(2)))
    again = Corpus.open(spark, str(tmp_path))
    assert again == corpus
    assert_as_rebuilt(refresh.refresh(again, pages_of(crawl(3))), pages_of(crawl(3)))


def test_empty_crawls(spark, pages_of, tmp_path):
    corpus = refresh.refresh(Corpus.open(spark, str(tmp_path), n_buckets=4), pages_of([]))
    assert corpus.version == 1 and corpus.terms().count() == 0
    with pytest.raises(ValueError):
        corpus.index()
    corpus = refresh.refresh(corpus, pages_of([page("u", "some text", 0)]))
    assert corpus.chunks().count() == 1
    corpus = refresh.refresh(corpus, pages_of([]))
    assert corpus.chunks().count() == 0 and corpus.terms().count() == 0 and corpus.urls().count() == 0


def test_order_of_pages_counts_where_a_url_has_several(pages_of):
    two = [page("u", "one", 0), page("u", "two", 1), page("v", "x", 5)]
    other = [page("u", "two", 0), page("u", "one", 1), page("v", "x", 9)]
    digests = [dict(rows(refresh.page_digests(pages_of(p)), "url", "digest")) for p in (two, other, two[::-1])]
    assert digests[0]["u"] != digests[1]["u"] and digests[0]["v"] == digests[1]["v"] and digests[0] == digests[2]
