"""Text expressions against plain Python."""

import hashlib
import math
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import text as tx

SAMPLES = [
    "", " ", "a", "  a  b\t\tc ", "x\r\ny\rz", "a\x0bb\x0cc", "one\n\n\n two \n", "a\x1cb\x1dc\x1ed\x1fe",
    "a\x85b c d", "  nbsp  inside ", "tab\tend\t", "a \t\xa0 b", "　wide　", "no-break​zero",
    "line one  \n\t line\ttwo\n   \n\tline three", "é\xa0\n\xa0ü", "\x1f\x1e", "a" * 50 + "\t" * 50,
]


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def py_clean(text):
    lines = [re.sub(r"[ \t]+", " ", line).strip() for line in text.splitlines()]
    return "\n".join(line for line in lines if line)


def py_windows(text, target, overlap):
    words = text.split()
    if len(words) <= target:
        return [text] if words else []
    out, start = [], 0
    while True:
        out.append(" ".join(words[start:start + target]))
        if start + target >= len(words):
            return out
        start += target - overlap


def test_cleaning(spark):
    s = F.col("s")
    assert column(spark, SAMPLES, tx.clean_text(s)) == [py_clean(t) for t in SAMPLES]
    assert column(spark, SAMPLES, tx.strip(s)) == [t.strip() for t in SAMPLES]
    assert column(spark, SAMPLES, tx.normalize_ws(s)) == [re.sub(r"\s+", " ", t).strip() for t in SAMPLES]
    assert column(spark, SAMPLES, tx.has_text(s)) == [bool(t.strip()) for t in SAMPLES]
    assert column(spark, SAMPLES, tx.words(s)) == [t.split() for t in SAMPLES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 é", max_size=30), min_size=20, max_size=40))
def test_cleaning_of_any_blanks(spark, texts):
    s = F.col("s")
    assert column(spark, texts, tx.clean_text(s)) == [py_clean(t) for t in texts]
    assert column(spark, texts, tx.words(s)) == [t.split() for t in texts]


def test_windows(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in [*range(0, 60), 299, 300, 301, 650, 651]]
    for target, overlap in ((10, 3), (7, 0), (5, 4), (300, 50)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
        df = df.withColumn("w", tx.words(F.col("s")))
        got = [r[0] for r in df.orderBy("i").select(tx.word_windows(F.col("s"), F.col("w"), target, overlap)).collect()]
        assert got == [py_windows(t, target, overlap) for t in texts]


def test_chunk_id_and_paths(spark):
    row = spark.createDataFrame([("u", ["a", " b ", " "], "t")], "u string, p array<string>, s string")
    path = tx.section_path(F.col("p"), F.lit("name"))
    got = row.select(path, tx.section_path(F.array(F.lit(" ")), F.lit("name")),
                     tx.chunk_id(F.col("u"), path, F.lit(2), F.col("s"))).first()
    digest = hashlib.sha256("u\na > b\n2\nt".encode()).hexdigest()[:24]
    assert list(got) == [["a", "b"], ["name"], fv.CHUNK_ID_PREFIX + digest]


def test_tokens_match_python_ignorecase(spark):
    pattern = re.compile(fv.TOKEN_PATTERN, re.IGNORECASE)
    texts = ["HER2/neu-positive", "a--b a-b_c+d", "Kelvin K, long ſ, İx ı", "été 5-FU 10+ -x- ", "", "x_/y"]
    assert column(spark, texts, tx.tokens(F.col("s"))) == [[t.lower() for t in pattern.findall(s)] for s in texts]


def test_run_lengths(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "a array<string>")
    df = df.withColumn("t", F.sort_array("a")).withColumn("s", tx.run_starts(F.col("t")))
    got = [[tuple(x) for x in r[0]] for r in df.select(tx.run_lengths(F.col("t"), F.col("s"))).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], []]


def test_slugify(spark):
    names = ["Stomach (Gastric) Cancer", "Émile  Ünïcode", "___", "", "ﬁne ① x", "a" * 119 + " b", "日本"]

    def slug(t):
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")[:120].rstrip("_") or "unnamed"

    assert column(spark, names, tx.slugify("s")) == [slug(n) for n in names]


def test_id_order(spark):
    ids = ["10", "9", "b", "a10", "002", "2", "99999999999999999999999999999999999999999999", "x1", ""]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    got = [r[0] for r in df.orderBy(*tx.sort_key(F.col("s"))).collect()]
    key = sorted(ids, key=lambda v: (0, int(v), v) if v.isdigit() else (1, math.inf, v))
    assert got == key


def test_dates(spark):
    texts = [
        "x Updated: March 5, 2024 y", "Reviewed: may 1, 2020", "reviewed: May 1, 2020 UPDATED: June 2, 2021",
        "Updated: Smarch 5, 2024", "NotUpdated: March 5, 2024", "Updated:March  15,  1999",
    ]
    assert column(spark, texts, tx.first_match_date(F.col("s"))) == [
        "March 5, 2024", "may 1, 2020", "June 2, 2021", None, None, "March 15, 1999",
    ]


def test_tokens_with_letters_that_fold_to_ascii(spark):
    texts = ["Kelvin A-B/c", "ſea iıİ X", "ÉTÉ Straße 3_4", "plain A1+b", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = df.orderBy("i").select(tx.tokens(F.col("s")), F.transform(tx.raw_tokens(F.col("s")), F.lower)).collect()
    assert all(a == b for a, b in got)
