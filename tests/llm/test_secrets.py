import hashlib
import random

from corpuslens.llm import secrets


def case(prose):
    drawn = random.Random(9)
    hexes = lambda n: "".join(drawn.choices("0123456789abcdef", k=n))
    pairs, truth = [], {}
    for i in range(400):
        words = prose(60, i).split()
        value, text = [
            (v := hexes(40), f'token = "{v}"'), (v := hexes(18), f"password={v}"), (v := "4" + "".join(drawn.choices("0123456789", k=15)), f"card {v}"),
            (v := "", f"bob{i}99@mail.example.com"), (v := f"{words[0]}{words[1]}{words[2]}1", f"token = {v}"), (v := hexes(32), f"key {v} of"),
        ][i % 6]
        words[10] = text
        pairs.append((i, " ".join(words)))
        truth[i] = value, (i % 6) in (0, 1)
    pairs += [(900, None), (901, ""), (902, "x" * 100_000), (903, "a1" * 50_000), (904, pairs[0][1]), (0, pairs[0][1]), (None, pairs[1][1])]
    return pairs, truth


def test_scan(docs_of, prose):
    pairs, truth = case(prose)
    texts = dict(pairs)
    rows = secrets.scan(docs_of(pairs)).collect()
    by_doc = {}
    for r in rows:
        value = texts[r.doc_id][r.start : r.end]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256 and 0 <= r.score <= 1 and r.secret == (r.score >= 0.5)
        by_doc.setdefault(r.doc_id, {})[value] = r.secret
    wrong = 0
    for i, (value, secret) in truth.items():
        if i % 6 in (0, 1, 2):
            assert value in by_doc[i]
        if i % 6 != 5:
            wrong += by_doc.get(i, {}).get(value, False) != secret
        wrong += sum(s for v, s in by_doc.get(i, {}).items() if v != value)
    assert wrong / len(truth) < 0.02
    assert 903 in by_doc and 902 not in by_doc and by_doc[904] == by_doc[0] and None in by_doc
    assert len(rows) == len({(r.doc_id, r.start) for r in rows})


def test_given_labels_teach(spark, docs_of, prose):
    pairs, _ = case(prose)
    pairs = [p for p in pairs if p[0] is not None and p[0] < 400]
    first = secrets.scan(docs_of(pairs))
    # Taught the other way round: hexadecimal values assigned to "token" are harmless, card numbers are not.
    labels = [(r.doc_id, r.start, int(r.end - r.start == 16)) for r in first.collect()]
    again = secrets.scan(docs_of(pairs), spark.createDataFrame(labels, "doc_id long, start long, label int")).collect()
    assert all(r.secret == (r.end - r.start == 16) for r in again)


def test_one_label_and_empty(docs_of, no_docs):
    assert secrets.scan(no_docs).count() == 0
    rows = secrets.scan(docs_of([(1, "number 1234567890123"), (2, "odd q1w2e3r4t5y6")])).collect()
    assert {(r.doc_id, r.score, r.secret) for r in rows} == {(1, 0.0, False), (2, 0.5, True)}


def test_native(docs_of, prose, plan_of):
    plan = plan_of(secrets.scan(docs_of(case(prose)[0])))
    assert "Python" not in plan and "Arrow" not in plan


def test_names_joined_to_words(docs_of):
    shapes = [
        ("DB_PASSWORD=", "correcthorse"), ('client_secret: "', "qwertzuiopasdfgh"), ('secret_key = "', "abcdefghijklmnop"),
        ("AWS_SECRET_ACCESS_KEY=", "AbCdEfGhIjKlMnOpQrSt"), ("db_password=", "hunt3r!"), ("my-api-key-value: '", "qwertzuiop"),
        ("dbPassword = ", "correcthorse"), ('"secretKey": "', "abcdefghijklmnop"), ("session_token_id=", "qwertzuiop"),
        ("password=", "correcthorse"), ("tokens: ", "qwertzuiop"),
    ]
    pairs = [(i, f"some words {name}{value} more words") for i, (name, value) in enumerate(shapes)]
    pairs += [(100, "a secret for you = none"), (101, "the secretary: somebody")]
    rows = secrets.scan(docs_of(pairs)).collect()
    texts = dict(pairs)
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in rows) == [(i, value) for i, (_, value) in enumerate(shapes)]
