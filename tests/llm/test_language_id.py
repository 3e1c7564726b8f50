import random
from collections import Counter

import pytest

from corpuslens.llm import language_id as li

SYLLABLES = {"en": "th er on an the and ing tion", "fr": "é ou eau que oi les ç ent", "de": "sch ß ung ein ü keit ich zu"}


def brute_grams(text):
    """N-grams of padded words, by count and then by characters."""
    clean = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text)
    counts = Counter()
    for w in clean.split():
        counts.update(w)
    padded = " " + " ".join(clean.split()) + " " if clean.split() else ""
    for n in (2, 3):
        counts.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if " " not in g[1:-1])
    return counts


def decoded(code):
    out = ""
    while code:
        out = chr(code & (1 << 21) - 1) + out
        code >>= 21
    return out


@pytest.mark.parametrize("text", ["", "12 !?", "a", "The the THE", "Été, l'été ß ẞ", "x1y  \n z", "ǅ İI", "日本 語"])
def test_grams_as_brute_force(text):
    grams, counts = li.ranked_grams(text, None)
    assert {decoded(int(g)): int(n) for g, n in zip(grams, counts)} == brute_grams(text)
    assert list(counts) == sorted(counts, reverse=True)


def test_nearest_as_brute_force(spark, docs_of):
    drawn = random.Random(2)
    rows = [(i, lang, " ".join("".join(drawn.choices(SYLLABLES[lang].split(), k=3)) for _ in range(40)))
            for i, lang in enumerate(list(SYLLABLES) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    profiles = li.learn(docs, length=50)
    more = [(900, None), (901, ""), (902, "12 34"), (903, "und"), (903, "und"), (None, "the thing")]
    got = li.identify(docs.select("doc_id", "text").unionByName(docs_of(more).select("doc_id", "text")), profiles).collect()
    assert len(got) == len(rows) + len(more)
    truth = {i: lang for i, lang, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    texts = {i: t for i, _, t in rows}
    for r in held[:10]:
        own = [g for g, _ in sorted(brute_grams(texts[r.doc_id]).items(), key=lambda x: (-x[1], code(x[0])))][:50]
        best = []
        for i, lang in enumerate(profiles.languages):
            places = {decoded(int(g)): int(p) for g, p in zip(profiles.grams, profiles.ranks[i]) if p < 50}
            best.append((sum(abs(places[g] - k) if g in places else 50 for k, g in enumerate(own)), lang))
        assert min(best)[1] == r.lang_pred and abs(r.score - (1 - min(best)[0] / (50 * len(own)))) < 1e-9


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_nothing_learned(spark, docs_of, no_docs):
    docs = docs_of([(1, "some words")], lang=None)
    profiles = li.learn(docs)
    assert [(r.lang_pred, r.score) for r in li.identify(docs, profiles).collect()] == [("und", 0.0)]
    assert li.identify(no_docs, li.learn(no_docs)).count() == 0
