from pyspark.sql import functions as F

from corpuslens.functions import web


def one(spark, values, *exprs):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)])
    df = df.toDF("i", *[f"c{k}" for k in range(1, len(df.columns))])
    return [tuple(r) for r in df.orderBy("i").select(*exprs).collect()]


def test_canonical_and_content_urls(spark):
    urls = [
        "https://cancer.gov/types//a/pdq?x=1#y", "HTTP://WWW.Cancer.GOV/a/PDQ", "https://www.cancer.gov",
        "https://www.cancer.gov/publications/pdq/information-summaries/genetics", "https://other.org/pdq", "//cancer.gov/x-pdq",
    ]
    got = one(spark, urls, web.canonical_url(F.col("c1")), web.is_content_url(F.col("c1")))
    assert got == [
        ("https://www.cancer.gov/types/a/pdq", True), ("http://www.cancer.gov/a/PDQ", True),
        ("https://www.cancer.gov", False),
        ("https://www.cancer.gov/publications/pdq/information-summaries/genetics", False),
        ("https://other.org/pdq", False), ("https://www.cancer.gov/x-pdq", True),
    ]


def test_audience_and_titles(spark):
    rows = [
        ("https://x/hp/a", "T – Patient Version"), ("https://x/Patient/a", "T"), ("https://x/a?/hp/", "T"),
        ("https://x/a", "T Health Professional Version"), ("https://x/a", "T (PDQ®)–Patient Version"),
    ]
    got = one(spark, rows, web.audience(F.col("c1"), F.col("c2")), web.strip_title_suffix(F.col("c2")))
    assert got == [
        ("health_professional", "T"), ("patient", "T"), ("unspecified", "T"),
        ("health_professional", "T Health Professional Version"), ("patient", "T"),
    ]


def test_topic_and_entity(spark):
    rows = [
        ("Gastric Cancer Treatment", ["screening", "adult_treatment"]), ("X Prevention Screening Treatment", ["prevention"]),
        ("X Treatment Screening", ["screening"]), ("Cancer Screening Overview", ["screening"]),
        ("BRCA Genetics", ["genetics"]), ("gastric cancer treatment", ["adult_treatment"]), ("Y", ["new"]),
        ("Y", []), ("Breast Cancer Treatment During Pregnancy", ["adult_treatment"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, c array<string>").orderBy("i")
    got = [tuple(r) for r in df.select(web.topic(F.col("c")), web.entity_name(F.col("n"), F.col("c"))).collect()]
    assert got == [
        ("adult_treatment", "Stomach (Gastric) Cancer"), ("prevention", "X"), ("screening", "X Treatment"),
        ("screening", None), ("genetics", None), ("adult_treatment", "gastric cancer"), ("new", None), ("unknown", None),
        ("adult_treatment", "Breast Cancer Treatment During Pregnancy"),
    ]


def test_boilerplate(spark):
    df = spark.createDataFrame([(["T", " Contact  Us "],), (["T", "Contact us today"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(web.is_boilerplate(F.col("p"))).collect()] == [True, False, False]
