import random
import re

from corpuslens.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def edited(text, seed, every):
    """One word in ``every`` dropped, doubled or replaced."""
    drawn = random.Random(seed)
    out = []
    for i, w in enumerate(text.split()):
        out += [w] if i % every != every // 2 else drawn.choice([[], [w, w], ["zz"]])
    return " ".join(out)


def case(prose):
    mit, gpl, ccsa = licenses.NOTICES["mit"], licenses.NOTICES["gpl"], licenses.NOTICES["cc-by-sa"]
    return [
        (0, prose(50, 0)), (1, None), (2, ""), (3, "Under the MIT License!"), (4, "cc-by-nc cc by nc CC BY NC."),
        (5, "under the mit licence; apache license, version 3"), (6, prose(9, 1) + " APACHE LICENSE Version 2.0 " + prose(9, 2)),
        (7, prose(30, 3) + " " + mit.upper() + ". " + prose(30, 4)), (8, edited(gpl, 1, 14)), (9, edited(gpl, 2, 3)),
        (10, "(" + gpl.replace(" ", ", ") + ") under the mit license " + mit), (11, " ".join(mit.split()[:20])),
        (12, ccsa), (13, "under the mit license under\x7fthe mit license"), (14, ("cc by nc " * 500) + mit),
        (15, "the under the mit license the"), (16, "cc by"), (17, "É under the mit license É cc by K nc"),
        (18, " ".join(random.Random(1).sample(mit.split(), len(mit.split())))), (3, "Under the MIT License!"), (None, "cc by nc"), (None, "cc by nc"),
        (3, "another text with the same id"),
    ]


def test_as_brute_force(docs_of, prose):
    pairs = case(prose)
    rows = licenses.scan(docs_of(pairs)).collect()
    assert len(rows) == len(pairs)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert got == sorted(((i, *brute_base(t)) for i, t in pairs), key=repr)
    labels = {r.doc_id: set(r.labels.split(",")) - {""} for r in rows if r.doc_id not in (3, None)}
    assert labels[7] == {"mit"} and labels[8] == {"gpl"} and labels[9] == set() and labels[10] == {"gpl", "mit"}
    assert labels[11] == labels[18] == labels[0] == labels[1] == set() and "cc-by-sa" in labels[12]
    assert labels[14] == {"cc-by-nc", "mit"}
    for r in rows:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
        assert r.labels == ",".join(sorted(r.labels.split(",")))


def test_native_and_empty(docs_of, no_docs, plan_of):
    assert licenses.scan(no_docs).count() == 0
    plan = plan_of(licenses.scan(docs_of([(1, "x")])))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_templates_that_differ_by_a_word(docs_of, prose):
    kinds = ["cc-by", "cc-by-sa", "cc-by-nc"]
    notices = [licenses.NOTICES[k] for k in kinds]
    pairs = [(i, n) for i, n in enumerate(notices)]
    pairs += [(10 + i, f"{prose(20, i)} {n.title()}. {prose(20, 9 + i)}") for i, n in enumerate(notices)]
    pairs += [(20 + i, n.replace("this work", "this fine work")) for i, n in enumerate(notices)]
    # Notices one after the other are told apart by their places.
    pairs += [(30, f"{notices[0]} {notices[1]}"), (31, " and ".join(notices)), (32, f"{notices[1]} {prose(40, 5)} {notices[2]}")]
    labels = {r.doc_id: r.labels for r in licenses.scan(docs_of(pairs)).collect()}
    assert labels == {i + j: k for i in (0, 10, 20) for j, k in enumerate(kinds)} | {
        30: "cc-by,cc-by-sa", 31: "cc-by,cc-by-nc,cc-by-sa", 32: "cc-by-nc,cc-by-sa"
    }
    assert {k: [licenses.NOTICES[k].split()[i] for i in v] for k, v in licenses.distinguishing(licenses.NOTICES).items() if v} == {
        "cc-by-sa": ["sharealike"], "cc-by-nc": ["noncommercial"], "cc-by-nd": ["noderivatives"], "cc-by-nc-sa": ["noncommercial", "sharealike"],
        "cc-by-nc-nd": ["noncommercial", "noderivatives"], "gpl": ["program"], "agpl": ["program", "affero"], "lgpl": ["library", "lesser"],
    }


def brute_labels(text, notices=licenses.NOTICES, cover=licenses.COVER, shift=licenses.SHIFT):
    """Labels of the notices and the best score: votes counted place by place."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    needed = licenses.distinguishing(notices)
    found = []
    for number, (label, notice) in enumerate(notices.items()):
        own = notice.split()
        votes = {}
        for i in range(len(words) - 2):
            for j in range(len(own) - 2):
                if words[i : i + 3] == own[j : j + 3]:
                    votes.setdefault(i - j, set()).add(j)
        bands = []
        for d in sorted(votes):
            if not bands or d - bands[-1][-1] > shift:
                bands.append([])
            bands[-1].append(d)
        for band in bands:
            places = {p + k for d in band for p in votes[d] for k in range(3)}
            ats = {d + p + k for d in band for p in votes[d] for k in range(3)}
            begin, end = min(ats), max(ats) + 1
            inserted = end - begin - len(ats)
            score = len(places) / (len(own) + inserted)
            if score >= cover and end - begin <= len(own) / cover + shift and set(needed[label]) <= places:
                found.append((len(own) - len(places) + inserted, begin, end, number, label, score))
    kept = []
    for x in sorted(found):
        if not any(x[1] < y[2] and y[1] < x[2] and y[0] < x[0] for y in kept):
            kept.append(x)
    return {x[4] for x in kept}, max((x[5] for x in kept), default=0.0)


def test_labels_as_brute_force(docs_of, prose):
    drawn = random.Random(9)
    pairs = []
    for i, (label, notice) in enumerate(licenses.NOTICES.items()):
        pairs += [(100 * i, notice), (100 * i + 1, f"{prose(15, i)} {notice.upper()} {prose(15, i + 50)}")]
        pairs += [(100 * i + 10 + every, edited(notice, i + every, every)) for every in (4, 6, 9, 14, 20)]
        other = drawn.choice(list(licenses.NOTICES.values()))
        pairs += [(100 * i + 50, f"{notice} {other}"), (100 * i + 51, f"{edited(notice, i, 15)} zz {edited(other, i, 15)} {notice}")]
    rows = licenses.scan(docs_of(pairs), phrases={}).collect()
    got = {r.doc_id: ({x for x in r.labels.split(",") if x}, round(r.score, 9)) for r in rows}
    wanted = {i: brute_labels(t) for i, t in pairs}
    assert got == {i: (labels, round(score, 9)) for i, (labels, score) in wanted.items()}
    # A notice is its own label and no other.
    assert all(got[100 * i] == ({label}, 1.0) and got[100 * i + 1][0] == {label} for i, label in enumerate(licenses.NOTICES))


def test_templates_are_an_argument(docs_of):
    own = {"house": "you may use this text in this house and nowhere else at all"}
    rows = licenses.scan(docs_of([(1, "Note: you may use this text in this house and nowhere else at all."), (2, "see my terms here"), (3, licenses.NOTICES["mit"])]),
                         phrases={"my terms here": "mine"}, notices=own).collect()
    assert {r.doc_id: (r.labels, r.base_labels) for r in rows} == {1: ("house", ""), 2: ("mine", "mine"), 3: ("", "")}
