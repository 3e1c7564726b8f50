import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate as dc


def plain_tiles(a, b, shortest):
    """Greedy string tiling as first published: longest runs of unmarked tokens, again and again."""
    marked_a, marked_b, total = [False] * len(a), [False] * len(b), []
    while True:
        longest, found = shortest, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not marked_a[i + k] and not marked_b[j + k]:
                    k += 1
                if k > longest:
                    longest, found = k, [(i, j)]
                elif k == longest:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(marked_a[i : i + longest]) and not any(marked_b[j : j + longest]):
                marked_a[i : i + longest] = marked_b[j : j + longest] = [True] * longest
                total.append(longest)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=25), st.integers(1, 4))
def test_tiles_are_greedy(a, b, shortest):
    tiles = dc.greedy_tiles(a, b, shortest, 7)
    for i, j, k in tiles:
        assert k >= shortest and a[i : i + k] == b[j : j + k]
    for side in (0, 1):
        places = [p for t in tiles for p in range(t[side], t[side] + t[2])]
        assert len(places) == len(set(places))
    # The longest tile is that of the plain method, and nothing tileable is left.
    wanted = plain_tiles(a, b, shortest)
    assert max((t[2] for t in tiles), default=0) == max(wanted, default=0)
    marked_a = {p for i, _, k in tiles for p in range(i, i + k)}
    marked_b = {p for _, j, k in tiles for p in range(j, j + k)}
    for i in range(len(a) - shortest + 1):
        for j in range(len(b) - shortest + 1):
            free = not any(i + k in marked_a or j + k in marked_b for k in range(shortest))
            assert not (free and a[i : i + shortest] == b[j : j + shortest])


@pytest.fixture
def case(prose):
    items = [(i, prose(40, i)) for i in range(6)] + [(6, "too short here"), (7, None), (8, ""), (9, prose(40, 2))]
    words = {i: t.split() for i, t in items if t}
    rng = random.Random(1)
    docs = [(i, prose(300, 100 + i)) for i in range(10)]
    docs.append((20, prose(50, 300) + " " + items[0][1] + " " + prose(50, 301)))
    docs.append((21, "  ".join(w.upper() + "!!" for w in words[1])))
    parts = [words[2][i : i + 10] for i in range(0, 40, 10)]
    rng.shuffle(parts)
    docs.append((22, " ".join(" ".join(p) + " zz " + prose(3, 400 + i) for i, p in enumerate(parts))))  # reordered
    docs.append((23, " ".join(words[3][:30]) + " " + prose(100, 500)))  # 0.75 of the item
    docs.append((24, " ".join(w if i % 4 else "zz" for i, w in enumerate(words[4]))))  # no run of five
    docs.append((25, (items[5][1] + " ") * 200))
    docs += [(26, None), (27, ""), (28, "Too short, here!"), (29, "much too short here"), (20, docs[10][1]), (None, items[0][1])]
    # Scripts without blanks, and passages whose blanks and marks are others.
    items += [(30, "これは長い文章で、単語の間に空白がない。"), (31, "ab—cd “ef” gh\u00a0ij\u2009kl… mn·op"), (32, "ภาษาไทยไม่มีช่องว่าง"), (33, "日本"), (34, "…“”")]
    docs += [(40, "前に「これは長い文章で，単語の間に 空白がない」と書いた"), (41, "so ab cd ef, gh ij kl mn op it is"), (42, "คือภาษาไทยไม่มีช่องว่างนะ"), (43, "日 本"), (44, "日本語"), (45, "ab\u200bcd")]
    return docs, items


def plain_tokens(text):
    """Letters and digits, one character at a time."""
    out, word = [], ""
    for c in (text or "").lower():
        kind = unicodedata.category(c)
        alone = re.match("[\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff]", c) and kind[0] in "LN"
        if kind == "Cf" and ord(c) > 127:
            continue
        if alone or not (kind[0] in "LN" or (kind[0] == "M" and ord(c) > 127)):
            out, word = [*out, word], ""
        if alone:
            out.append(c)
        elif kind[0] in "LN" or (kind[0] == "M" and ord(c) > 127):
            word += c
    return [w for w in [*out, word] if w]


@given(st.one_of(st.text(max_size=30), st.text(alphabet="aB 1—“\u00a0日本ไม่ é\u0301\u200b_-", max_size=30)))
def test_tokens_as_brute_force(text):
    if not re.search("[\u1000-\u109f\u1780-\u17ff\u31f0-\u31ff\u3400-\u4dbf\uf900-\ufaff\U00020000-\U0003ffff]", text):
        assert dc.tokens(text) == plain_tokens(text)


def brute(docs, items):
    out = set()
    for i, t in docs:
        for j, s in items:
            a, b = plain_tokens(t), plain_tokens(s)
            if 0 < len(b) < 5 and a == b:
                out.add((i, j, 1.0))
            if len(a) < 2000 and len(b) >= 5:
                cover = sum(plain_tiles(a, b, 5)) / len(b)
                if cover >= 0.8:
                    out.add((i, j, cover))
    return out


def test_as_brute_force(spark, docs_of, case):
    docs, items = case
    found = dc.contaminated(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.collect()
    got = {(r.doc_id, r.item_id, r.coverage) for r in rows}
    assert {x for x in got if x[0] != 25} == brute(docs, items)
    assert {x[:2] for x in got if x[0] == 25} == {(25, 5)}
    assert {x[0] for x in got} == {20, 21, 22, 25, 28, 40, 41, 42, 43, None}
    assert len(rows) == len(got)
    assert next(r.n_tiles for r in rows if r.doc_id == 22 and r.item_id == 2) >= 4


def test_small_bitmap_gives_the_same(spark, docs_of, case):
    docs, items = case
    items = spark.createDataFrame(items, "item_id long, text string")
    full = {tuple(r)[:5] for r in dc.contaminated(docs_of(docs), items).collect()}
    assert {tuple(r)[:5] for r in dc.contaminated(docs_of(docs), items, bitmap_bits=8).collect()} == full


def test_common_phrases_are_not_joined(spark, docs_of, prose):
    """Of an item's runs those that very many documents hold are spared; all it is found in are still found."""
    phrase = prose(12, 1)
    item = phrase + " " + prose(30, 2)
    docs = [(i, f"{phrase} {prose(30, 100 + i)}") for i in range(200)] + [(900, item), (901, prose(20, 3) + " " + item)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string").withColumn("item_text", F.col("text")).withColumn("item_key", F.lit(1).cast("long"))
    runs = dc._item_seeds(items, 5)
    held = runs.select("seed", F.when(F.col("place") <= 7, 202).otherwise(2).alias("uses"))
    joined = dc._joined_seeds(runs, held, 5, 0.8)
    common = {r.seed for r in held.where("uses > 2").collect()}
    left = {r.seed for r in joined.collect()}
    assert runs.count() == 38 and len(left) == 32 and len(left & common) == 2
    found = dc.contaminated(docs_of(docs), items.select("item_id", "text"))
    assert {r.doc_id for r in found.collect()} == {900, 901}


def test_drop_and_empty(spark, docs_of, no_docs, case):
    docs, items = case
    items = spark.createDataFrame(items, "item_id long, text string")
    kept = dc.drop_contaminated(docs_of(docs), items)
    assert kept.columns == docs_of(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {20, 21, 22, 25, 28, 40, 41, 42, 43, None}
    clean = docs_of([(None, "nothing of note"), (20, "another text with this id")])
    assert dc.drop_contaminated(docs_of(docs).unionByName(clean), items).join(clean, "text", "left_semi").count() == 2
    assert dc.contaminated(no_docs, items).count() == 0
    assert dc.contaminated(docs_of(docs), items.limit(0)).count() == 0
