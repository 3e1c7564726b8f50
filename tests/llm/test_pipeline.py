import random
import zlib

import pytest

import corpus_pipeline
from corpuslens.llm import packing, quality
from test_decontaminate import brute
from test_near_copies import brute as brute_near
from test_packing import check_packing, plain_ids


@pytest.fixture
def tables(spark, prose, tmp_path):
    """Documents of every kind that a stage drops, with their tables, as a data folder."""
    drawn = random.Random(12)
    items = [(i, prose(30, 900 + i)) for i in range(4)]
    pairs = [(i, prose(drawn.randint(20, 120), i)) for i in range(160)]
    pairs += [(200 + i, pairs[i][1]) for i in range(20)] + [(300 + i, pairs[0][1]) for i in range(40)]
    pairs += [(400 + i, pairs[30 + i][1] + " more") for i in range(10)]
    pairs += [(500 + i, prose(20, 700 + i) + " " + items[i % 4][1]) for i in range(8)]
    junk = [(600 + i, " ".join(w.upper() + "!!" for w in prose(40, 800 + i).split())) for i in range(60)]
    pairs += junk + [(700, None), (701, ""), (702, prose(5000, 5)), (None, prose(30, 6)), (5, pairs[5][1])]
    labels = [(i, 1, 0) for i in range(160)] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), pairs, items, labels


def test_run_as_brute_force(spark, tables):
    folder, pairs, items, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = []
    for i, t in pairs:
        f = next(quality.features([t or ""]))
        score = 1 / (1 + 2.718281828459045 ** -(float(model.weights[f].mean(dtype="float64")) + model.bias)) if len(f) else model.prior
        if score >= quality.THRESHOLD:
            left.append((i, t))
    assert {i for i, _ in pairs if i is not None and i < 600} == {i for i, _ in left if i is not None and i < 600}
    assert not {i for i, _ in left if i is not None and 600 <= i < 700}
    last = {}
    for i, t in left:
        if (i if i is not None else -1) >= last.get(t or "", (-2,))[0]:
            last[t or ""] = (i if i is not None else -1, t)
    left = [(i if i >= 0 else None, t) for i, t in last.values()]
    # Five-word Jaccard of 0.8 or more, all pairs.
    least = brute_near(left)
    assert {i for i, t in left if i != least[t]} >= {401, 402, 409}
    left = [(i, t) for i, t in left if i == least[t]]
    leaks = {i for i, _, _ in brute([x for x in left if len(x[1] or "") < 5000], items)}
    assert len(leaks) == 8
    left = [(i, t) for i, t in left if i not in leaks]
    wanted = []
    for i, t in left:
        ids = [*plain_ids(t), 0]
        wanted += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + 2048])))
                   for k, at in enumerate(range(0, len(ids), packing.CAPACITY))]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(wanted, key=repr)
    check_packing([r.sequence_id for r in rows], [r.offset for r in rows], [r.length for r in rows], packing.CAPACITY)


def test_stages(spark, tables):
    folder, *_ = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_registered():
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in driver.oracle_sql()
