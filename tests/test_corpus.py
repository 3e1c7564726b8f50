"""Page JSON to chunks."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import bm25, chunks, evidence
from corpuslens.plans import retrieval
from corpuslens.sources import readers

PAGE = {
    "title": "Bladder Cancer Treatment", "topic": "adult_treatment", "audience": "patient",
    "url": "https://example.test/bladder",
    "sections": [
        {"section": "Treatment options", "section_path": ["Treatment", "Options"], "is_boilerplate": False,
         "text": "Bladder cancer may be treated with surgery, radiation, and chemotherapy."},
        {"section": "About", "is_boilerplate": True, "text": "This text should not be indexed."},
    ],
}


def write(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(value), encoding="utf-8")
    return str(folder)


def test_one_page_one_chunk_one_hit(spark, tmp_path):
    folder = write(tmp_path / "a", "bladder.json", {"cancer_type": "Bladder Cancer", "pages": [PAGE]})
    found = retrieval.load_chunks(spark, [folder])
    row = found.collect()
    assert len(row) == 1
    assert row[0]["cancer_type"] == "Bladder Cancer" and row[0]["section_path"] == ["Treatment", "Options"]
    assert row[0]["source_file"].endswith("/a/bladder.json")
    index = bm25.build_index(found)
    questions = spark.createDataFrame([("1", "bladder chemotherapy treatment")], "question_id string, question string")
    hits = bm25.search(questions, index, 1)
    assert [(r["rank"], r["score"] < 0) for r in hits.collect()] == [(1, True)]
    assert "chemotherapy" in evidence.evidence_text(questions, hits, index.chunks).first()["evidence"]
    record = json.loads(evidence.evidence_json(hits, index.chunks).first()["evidence_json"])[0]
    assert list(record) == ["rank", "score", "chunk_id", "title", "cancer_type", "topic", "audience", "section",
                            "section_path", "url", "source_file", "passage"]


def test_root_shapes_and_odd_rows(spark, tmp_path):
    folder = tmp_path / "mixed"
    write(folder, "a.json", [PAGE | {"url": "u1"}, "no page", 5])
    write(folder, "b.json", PAGE | {"url": "u2", "title": "", "summary_name": "", "topic": "", "cancer_type": ""})
    write(folder, "c.json", {"pages": [PAGE | {"url": ""}, PAGE | {"url": "u3", "sections": "none"}, None]})
    write(folder, "d.json", "text")
    write(folder, "e.json", PAGE | {"url": "u5", "sections": [
        {"text": "  first \t line \r\n\n second ", "section_path": " only "},
        {"text": "named", "section": "S", "section_path": [" ", ""]},
        {"text": 42, "section_path": [1, "b"]}, "no section", {"text": "   "}, {"text": "b", "is_boilerplate": 1},
        {"text": "kept", "is_boilerplate": 0},
    ]})
    (folder / "notes.txt").write_text("not json")
    rows = {(r["url"], r["text"]): r for r in retrieval.load_chunks(spark, [str(folder)]).collect()}
    assert {u for u, _ in rows} == {"u1", "u2", "u5"}
    u2 = rows["u2", PAGE["sections"][0]["text"]]
    assert (u2["title"], u2["topic"], u2["cancer_type"]) == ("b", "general", None)
    assert rows["u5", "first line\nsecond"]["section_path"] == ["only"]
    assert rows["u5", "named"]["section_path"] == ["S"]
    assert rows["u5", "42"]["section_path"] == ["1", "b"]
    assert ("u5", "kept") in rows and ("u5", "b") not in rows


def test_first_copy_in_path_order_wins(spark, tmp_path):
    a = write(tmp_path / "b-dir", "z.json", PAGE | {"title": "second"})
    b = write(tmp_path / "b", "z.json", PAGE | {"title": "first"})
    assert [r["title"] for r in retrieval.load_chunks(spark, [a, b]).collect()] == ["first"]


def test_missing_folder_and_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_page_json(spark, [str(tmp_path / "none")])
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_page_json(spark, [str(tmp_path / "empty")])


def test_windows_restore_the_words(spark):
    text = " ".join(f"w{i}" for i in range(1234))
    section = F.struct(F.lit("s").alias("section"), F.array(F.lit("p")).alias("section_path"),
                       F.lit(False).alias("is_boilerplate"), F.col("text"))
    pages = spark.createDataFrame([(text,)], "text string").select(
        F.lit("t").alias("title"), F.lit("").alias("summary_name"), F.lit("").alias("cancer_type"),
        F.lit("").alias("topic"), F.lit("").alias("audience"), F.lit("u").alias("url"), F.lit("f.json").alias("source_file"),
        F.lit(0).alias("load_order"), F.array(section).alias("sections"),
    )
    parts = [r["text"].split() for r in chunks.chunk_pages(pages).orderBy("chunk_index").collect()]
    assert max(map(len, parts)) == 350
    assert parts[0] + [w for p in parts[1:] for w in p[50:]] == text.split()


def test_hot_copies_are_pruned_before_the_shuffle(spark, plan_of):
    pages = spark.range(3000).select(
        F.lit("t").alias("title"), F.lit("").alias("summary_name"), F.lit("").alias("cancer_type"),
        F.lit("").alias("topic"), F.lit("").alias("audience"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"),
        F.lit("f").alias("source_file"), F.col("id").alias("load_order"),
        F.array(F.struct(F.lit("s").alias("section"), F.array(F.lit("p")).alias("section_path"),
                         F.lit(False).alias("is_boilerplate"), F.lit("text").alias("text"))).alias("sections"),
    )
    kept = chunks.chunk_pages(pages)
    plan = plan_of(kept)
    assert plan.count("Exchange") == 1 and "row_number(), 1, Partial" in plan
    assert kept.count() == 2001
    assert kept.where("url = 'hot'").first()["load_order"] == 0
