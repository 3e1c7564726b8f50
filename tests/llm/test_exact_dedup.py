import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from corpuslens.llm import exact_dedup


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out, used = [], set()
    for i, t in pairs:
        t = t or ""
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        kept = i == keep and t not in used
        if kept:
            used.add(t)
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


PAIRS = (
    [(i, "hot text") for i in range(400)]
    + [(1000, "a"), (1001, "A"), (1002, "a"), (1003, None), (1004, ""), (1005, "é" * 50_000), (1006, "é" * 50_000)]
    + [(2000, "twice"), (2000, "twice"), (None, "no id"), (None, "no id"), (None, "a")]
)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "digest").collect()), key=repr)


def test_as_brute_force(docs_of):
    assert found(exact_dedup.copies(docs_of(PAIRS).repartition(7))) == brute(PAIRS)


def test_digest_shared_by_different_texts(docs_of):
    """The content decides, whatever the digest."""
    weak = exact_dedup.copies(docs_of(PAIRS).repartition(5), digest=lambda t: F.length(t).cast("string"))
    assert [r[:4] for r in found(weak)] == [r[:4] for r in found(exact_dedup.copies(docs_of(PAIRS)))]


def test_empty(no_docs):
    assert exact_dedup.copies(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_drop_copies_keeps_columns_and_one_row(docs_of):
    docs = docs_of(PAIRS).repartition(6)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [r["text"] or "" for r in rows]
    assert sorted(texts) == sorted({t or "" for _, t in PAIRS})
    by_text = {r["text"] or "": r["doc_id"] for r in rows}
    assert by_text["hot text"] == 399 and by_text["a"] == 1002 and by_text[""] == 1004 and by_text["no id"] is None
    assert all(r["digest"] == "x" and r["salt"] == 1 for r in rows)


def test_no_python_and_local_merge_first(docs_of, plan_of):
    df = exact_dedup.drop_copies(docs_of(PAIRS))
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)
