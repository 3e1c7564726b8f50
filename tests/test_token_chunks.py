import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.operators import token_chunks

PAGE = (
    "title string, summary_name string, cancer_type string, topic string, audience string, url string, source_file string, "
    "load_order long, sections array<struct<section:string,section_path:array<string>,is_boilerplate:boolean,block_count:int,text:string>>"
)
TOKEN = re.compile(r"[a-z0-9]+(?:[-_/+][a-z0-9]+)*", re.IGNORECASE)


def count(text):
    return len(TOKEN.findall(text))


def brute_pieces(text, most, run):
    """(text, glue) of each piece."""
    out = []
    for line in text.split("\n"):
        parts = [line] if count(line) <= most else re.split(r"(?<=[.!?]) ", line)
        cut = []
        for part in parts:
            if count(part) <= most:
                cut.append([(part, " ")])
            else:
                found, held, last = [], 0, 0
                for m in TOKEN.finditer(part):
                    held += 1
                    if held == run:
                        found.append(part[last : m.end()])
                        held, last = 0, m.end()
                rest = part[last:]
                if held:
                    found.append(rest)
                elif found:
                    found[-1] += rest
                cut.append([(f, "") for f in found[:-1]] + [(found[-1], " ")])
        flat = [p for c in cut for p in c]
        out += flat[:-1] + [(flat[-1][0], "\n")]
    return out


def brute(sections, target, most, least, overlap):
    """Texts, section numbers and token counts of the chunks of a page: sections are (parent, text)."""
    groups = []
    for i, (parent, text) in enumerate(sections):
        own = [(i, *p) for p in brute_pieces(text, most, max(1, overlap))]
        size = lambda ps: sum(count(p[1]) for p in ps)
        if groups and sections[i - 1][0] == parent and min(size(groups[-1]), size(own)) < least and size(groups[-1]) + size(own) <= target:
            groups[-1] += own
        else:
            groups.append(own)
    out = []
    for group in groups:
        sizes = [count(p[1]) for p in group]
        start = taken = 0
        while taken < len(group):
            stop = taken + 1
            while stop < len(group) and sum(sizes[start : stop + 1]) <= target:
                stop += 1
            if sum(sizes[stop:]) < least and sum(sizes[start:]) <= most:
                stop = len(group)
            chunk = group[start:stop]
            out.append(("".join(p[1] + p[2] for p in chunk).rstrip(" \n"), chunk[0][0], chunk[-1][0], sum(sizes[start:stop])))
            taken = stop
            if taken < len(group):
                before, start = start, taken
                while start > before + 1 and sum(sizes[start - 1 : taken]) <= min(overlap, most - sizes[taken]):
                    start -= 1
                while start < taken and sizes[start] == 0:
                    start += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(3, 9), st.integers(0, 4), st.integers(0, 2))
def test_ranges_as_brute_force(tokens, target, more, overlap):
    most, least = target + more, 3
    tokens = [min(t, most) for t in tokens]
    texts = ["\n".join(" ".join(["w"] * t) or "-" for t in tokens)]
    wanted = [c[3] for c in brute([("p", texts[0])], target, most, least, overlap)]
    found = token_chunks.ranges(tokens, target, most, least, overlap)
    assert [sum(tokens[a:b]) for a, b in found] == wanted
    assert all(sum(tokens[a:b]) <= most for a, b in found)
    # Every piece is in a chunk, in order; repeats stay within the overlap.
    assert found[0][0] == 0 and found[-1][1] == len(tokens)
    assert all(a[1] >= b[0] > a[0] or a[1] == b[0] for a, b in zip(found, found[1:])) and all(sum(tokens[b[0] : a[1]]) <= overlap for a, b in zip(found, found[1:]))


@pytest.fixture
def pages():
    rng = random.Random(4)
    words = ["dose", "risk-free", "node", "a/b", "scan", "é", "x1", "--"]
    texts = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([3, 10, 30, 200])
            lines.append(" ".join(rng.choice(words) + rng.choice(["", "", ".", "!", ","]) for _ in range(n)))
        texts.append("\n".join(lines))
    texts += ["w " * 3000 + "end!!", "one.two.three " * 40 + "\n" + "é" * 50, "x"]
    out = []
    for i in range(12):
        own = [(f"S{j}", ["A", f"P{j // 3}", f"S{j}"], j % 5 == 4, 1, texts[(7 * i + j) % len(texts)]) for j in range(rng.randint(1, 9))]
        out.append((f"T{i}", None, None, "t", "a", f"u{i}", "f.json", i, own + [("blank", ["A"], False, 1, " \n\t"), ("null", None, None, None, None)]))
    return out


@pytest.mark.parametrize("sizes", [(40, 60, 10, 8), (550, 800, 60, 80), (50, 50, 50, 0)])
def test_pages_as_brute_force(spark, pages, sizes):
    from corpuslens.functions import text as tx

    cleaned = {r.t: r.c for r in spark.createDataFrame([(s[4],) for p in pages for s in p[8]], "t string").distinct()
               .select("t", tx.clean_text(F.col("t")).alias("c")).collect()}
    odd = [("T", None, None, "t", "a", "", "f", 50, pages[0][8]), ("T", None, None, "t", "a", "none", "f", 51, None), ("T", None, None, "t", "a", "bare", "f", 52, [])]
    rows = token_chunks.chunk_pages(spark.createDataFrame(pages + odd + pages[:1], PAGE), *sizes).collect()
    wanted = []
    for p in [*pages, pages[0]]:
        used = [s for s in p[8] if not s[2] and s[4] and s[4].strip()]
        for k, (text, first, last, n) in enumerate(brute([(s[1][:-1], cleaned[s[4]]) for s in used], *sizes)):
            path = used[first][1] if first == last else used[first][1][:-1]
            wanted.append((p[5], k, used[first][0], path, [s[0] for s in used[first : last + 1]], n, text))
    assert sorted((r.url, r.chunk_index, r.section, r.section_path, r.sections, r.n_tokens, r.text) for r in rows) == sorted(wanted)
    assert len({r.chunk_id for r in rows}) == len({(r.url, r.chunk_index) for r in rows})


def test_plan_is_narrow(spark, pages, plan_of):
    assert "Exchange" not in plan_of(token_chunks.chunk_pages(spark.createDataFrame(pages, PAGE)))


def test_sections_are_made_once(spark, pages):
    """filters on sections were pushed below what makes them, and made them again, once for each section."""
    sections = F.transform(F.split("source_file", ";"), lambda t: F.struct(
        t.alias("section"), F.array(t).alias("section_path"), F.lit(False).alias("is_boilerplate"), F.lit(1).alias("block_count"), t.alias("text")))
    rows = [("T", None, None, "t", "a", f"u{i}", text, i, None) for i, text in enumerate(["one;two", None, "", " ; "])]
    cut = token_chunks.chunk_pages(spark.createDataFrame(rows, PAGE).withColumn("sections", sections))
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("split(source_file") == 1
    assert [(r.url, r.sections) for r in cut.collect()] == [("u0", ["one", "two"])]


def test_sizes_are_checked(spark, pages):
    frame = spark.createDataFrame(pages, PAGE)
    for sizes in ((550, 500, 60, 80), (550, 800, 60, 550), (550, 800, 600, 80)):
        with pytest.raises(ValueError):
            token_chunks.chunk_pages(frame, *sizes)
