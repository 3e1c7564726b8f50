"""HTML pages, link discovery, entity documents and the crawl."""

import hashlib
import json
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions.html_blocks import scan_page
from corpuslens.operators import discovery, grouping, html
from corpuslens.plans import crawl, retrieval
from corpuslens.sources import web as fetching
from corpuslens.sources import readers, writers

PAGE = """<!DOCTYPE html><html><head><title>Site  title</title></head><body>
<h1>Outside</h1><p>Before main</p>
<form><main><nav><a href="/menu">Menu</a><p>nav text</p></nav>
<p>Intro&nbsp;text<!-- note -->more</p>
<h1>Bladder Cancer Treatment (PDQ&reg;)&ndash;Patient Version</h1>
<p>One <b>bold</b>word.</p><p>One <b>bold</b>word.</p><p>One <b>bold</b> word.</p><p>  </p>
<h4>Deep</h4><ul><li>first<ul><li>inner <p>para</p></li></ul> tail</li><li></li></ul>
<h3></h3><p>after empty heading</p>
<h3>Table</h3><table><tr><th>A</th><td> </td><td><p>b</p><ul><li>c</li></ul></td></tr><tr><td></td></tr></table>
<blockquote>Quote <p>inside</p></blockquote>
<h2>Contact  Us</h2><p>boiler</p><h3>Child</h3><p>Updated: March 5, 2024<br>end</p>
<script>var p = "<p>no</p>";</script><aside><p>aside</p></aside>
<p>a</x>b &amp; &unknown; &#65; &lt;tag&gt;</p></main></form>
<p>After main</p><footer>foot</footer></body></html>"""


def sections(spark, markup):
    df = spark.createDataFrame([("https://e.org/patient/x", ["adult_treatment"], [], [], markup)],
                               "url string, collections array<string>, discovered_from array<string>, "
                               "index_link_labels array<string>, html string")
    return html.parse_pages(html.scan_pages(df)).first()


def test_page_record(spark):
    page = sections(spark, PAGE)
    title = "Bladder Cancer Treatment (PDQ®)–Patient Version"
    got = [(s["section"], s["section_path"], s["is_boilerplate"], s["text"]) for s in page["sections"]]
    assert got == [
        ("Document", [], False, "Intro text more"),
        (title, [title], False, "One bold word."),
        ("Deep", [title, "Deep"], False, "- first tail\n- inner para"),
        ("Deep", [title, "Deep"], False, "after empty heading"),
        ("Table", [title, "Deep", "Table"], False, "A | b c\nQuote inside\ninside"),
        ("Contact Us", [title, "Contact Us"], True, "boiler"),
        ("Child", [title, "Contact Us", "Child"], True,
         "Updated: March 5, 2024 end\nab & &unknown A <tag>"),
    ]
    assert [s["block_count"] for s in page["sections"]] == [1, 1, 2, 1, 3, 1, 2]
    assert (page["title"], page["summary_name"], page["cancer_type"]) == (title, "Bladder Cancer Treatment", "Bladder Cancer")
    assert (page["topic"], page["audience"], page["last_updated"]) == ("adult_treatment", "patient", "March 5, 2024")
    text = "\n\n".join(s["text"] for s in page["sections"])
    assert page["content_sha256"] == hashlib.sha256(text.encode()).hexdigest() and page["section_count"] == 7


def test_titles_and_lenient_markup(spark):
    assert sections(spark, "<title> A  b </title><p>x")["title"] == "A b"
    assert sections(spark, "<p>x")["title"] == fv.UNTITLED_PAGE
    assert sections(spark, "<title>t</title><h1> </h1>")["title"] == ""
    nested = sections(spark, "<article><h1>T</h1><p><b>lead<br><p>one</p><p>two</p></article><p>three")
    assert [s["text"] for s in nested["sections"]] == ["lead one two\none\ntwo\nthree"]
    assert sections(spark, "")["sections"] == []
    assert sections(spark, "<h2>only heading</h2>")["sections"] == []
    void = sections(spark, "<p>a<img src=x>b<br/>c</br></p><p/>tail<p>d</p>")
    assert [s["text"] for s in void["sections"]] == ["a b c\nd"]


def test_links_are_read_inside_main_also_in_dropped_parts():
    links = scan_page(PAGE)["links"]
    assert links == [{"href": "/menu", "label": "Menu"}]
    assert [x["href"] for x in scan_page("<a>no</a><a href>x</a><a href='b'>y<b>z</b></a>")["links"]] == ["", "b"]


def test_a_page_that_fails_is_reported(spark):
    df = spark.createDataFrame([("u1", ["c"], [], [], "<p>x"), ("u2", ["c"], [], [], None)],
                               "url string, collections array<string>, discovered_from array<string>, "
                               "index_link_labels array<string>, html string")
    pages, failed = crawl.parse(df)
    assert [r["url"] for r in pages.collect()] == ["u1"]
    assert [(r["url"], r["reason"].split(":")[0]) for r in failed.collect()] == [("u2", "TypeError")]


def test_discovery_merges_and_splits_long_lists(spark):
    rows = [("c1", "https://www.cancer.gov/i", f"https://cancer.gov//x-pdq?n={i}", f"label {i % 40}") for i in range(400)]
    rows += [("c2", "https://www.cancer.gov/j/", "../y-PDQ#top", ""), ("c1", "https://www.cancer.gov/j/", "https://other.org/pdq", "z")]
    scanned = spark.createDataFrame(rows, "collection string, url string, href string, label string").select(
        "collection", "url", F.struct(F.array(F.struct("href", "label")).alias("links")).alias("scan"))
    facts = discovery.link_facts(discovery.links(scanned))
    found = discovery.discover(facts)
    got = {r["url"]: r for r in found.collect()}
    assert set(got) == {"https://www.cancer.gov/x-pdq", "https://www.cancer.gov/y-PDQ"}
    assert got["https://www.cancer.gov/x-pdq"]["index_link_labels"] == sorted({f"label {i}" for i in range(40)})
    assert got["https://www.cancer.gov/y-PDQ"]["index_link_labels"] == []
    counts = {r["url"]: (r["collections"], r["labels"], r["origins"]) for r in discovery.link_counts(facts).collect()}
    assert counts == {"https://www.cancer.gov/x-pdq": (1, 40, 1), "https://www.cancer.gov/y-PDQ": (1, 0, 1)}


def test_url_linked_by_a_third_of_all_pages_is_one_row(spark):
    links = spark.range(100_000).select(
        F.lit("c").alias("collection"), F.concat(F.lit("https://h.org/"), F.col("id")).alias("index_url"),
        F.when(F.col("id") % 3 == 0, "https://h.org/hot").otherwise(F.concat(F.lit("https://h.org/p"), F.col("id") % 5000)).alias("url"),
        F.concat(F.lit("label "), F.col("id") % 9000).alias("label"))
    facts = discovery.link_facts(links, only_content=False)
    rows = {r["url"]: r for r in discovery.discover(facts).collect()}
    assert len(rows) == 5001
    assert len(rows["https://h.org/hot"]["index_link_labels"]) == 3000 and len(rows["https://h.org/hot"]["discovered_from"]) == 33_334
    assert discovery.link_counts(facts).where("url = 'https://h.org/hot'").first()["origins"] == 33_334


def test_robots_rules_by_columns(spark, plan_of):
    text = ("User-agent: a\nDisallow: /x\nAllow: /x/y\n\nUser-agent: b\nAllow: /x/y\nDisallow: /x\nDisallow: /q%20r\n\n"
            "User-agent: *\nDisallow: /only\n")
    urls = [f"https://h.org{p}" for p in ("", "/", "/x", "/x/y/z", "/xx", "/only/1", "/q%20r", "/q r", "/q+r", "/?x=1", "/é")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for agent in ("a", "b/2.0", "other"):
        rules = RobotFileParser()
        rules.parse(text.splitlines())
        found = discovery.allowed_by_robots(df, text, agent)
        assert {r["url"]: r["allowed"] for r in found.collect()} == {u: rules.can_fetch(agent, u) for u in urls}
        assert "Python" not in plan_of(found)


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000 % 300).alias("v"), "id")
    got = grouping.with_position(rows, [F.col("v"), F.col("id")]).collect()
    want = {(r["v"], r["id"]): i for i, r in enumerate(sorted(got, key=lambda r: (r["v"], r["id"])), 1)}
    assert {(r["v"], r["id"]): r["position"] for r in got} == want and len(want) == 1000


def pages_table(spark, n=10):
    rows = [(f"u{i}", "T" + str(i % 3), "A" if i % 2 else None, "screening" if i % 4 else "genetics", "patient", f"S{i % 5}", [])
            for i in range(n)]
    return spark.createDataFrame(
        rows, "url string, title string, cancer_type string, topic string, audience string, summary_name string, "
        "sections array<struct<section:string,section_path:array<string>,is_boilerplate:boolean,block_count:int,text:string>>")


def test_documents_by_entity_read_back_as_pages(spark, tmp_path):
    pages = pages_table(spark, 40)
    files = writers.write_page_documents(pages, str(tmp_path / "out"))
    assert files == ["cancers/a.json"] + [f"general_topics/s{i}.json" for i in range(5)]
    docs = {f: json.loads((tmp_path / "out" / f).read_text()) for f in files}
    assert all(d["page_count"] == len(d["pages"]) for d in docs.values())
    assert len(docs["cancers/a.json"]["pages"]) == 20
    keys = [(p["topic"], p["audience"], p["title"], p["url"]) for p in docs["cancers/a.json"]["pages"]]
    assert keys == sorted(keys)
    assert docs["cancers/a.json"]["cancer_type"] == "A" and "scope" not in docs["cancers/a.json"]
    assert docs["general_topics/s0.json"]["scope"] == fv.GENERAL_SCOPE
    read = readers.read_page_json(spark, [str(tmp_path / "out" / "cancers"), str(tmp_path / "out" / "general_topics")])
    assert sorted(r["url"] for r in read.collect()) == sorted(f"u{i}" for i in range(40))
    manifest = {r["entity"]: r for r in writers.entity_manifest(pages).collect()}
    assert (manifest["A"]["page_count"], manifest["A"]["file"], manifest["A"]["topics"]) == (20, "cancers/a.json", ["screening"])


def test_large_entities_have_several_documents(spark, tmp_path, monkeypatch):
    """One entity with a third of 100 000 pages: no task sees all of them, every page is read back once."""
    n = 100_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "Big").otherwise(F.concat(F.lit("E"), F.col("id") % 7)).alias("cancer_type"),
        F.lit(None).cast("string").alias("summary_name"), F.lit("t").alias("topic"), F.lit("a").alias("audience"), F.lit("x").alias("title"),
        F.format_string("u%06d", "id").alias("url"),
    )
    folder = str(tmp_path / "out")
    files = writers.write_page_documents(rows, folder)
    assert [f for f in files if "big" in f] == ["cancers/big.2.json", "cancers/big.3.json", "cancers/big.4.json", "cancers/big.json"]
    assert not list((tmp_path / "out").glob("_lines*"))
    documents = [json.loads((tmp_path / "out" / f).read_text()) for f in files]
    assert all(d["page_count"] == len(d["pages"]) <= writers.FILE_PAGES for d in documents)
    assert sorted(p["url"] for d in documents for p in d["pages"]) == [f"u{i:06d}" for i in range(n)]
    big = [json.loads((tmp_path / "out" / f).read_text())["pages"] for f in ("cancers/big.json", "cancers/big.2.json", "cancers/big.3.json", "cancers/big.4.json")]
    assert [p["url"] for part in big for p in part] == [f"u{i:06d}" for i in range(0, n, 3)]
    # Written again over what is there.
    assert writers.write_page_documents(rows.where("url < 'u000030'"), folder) == [f for f in files if f.count(".") == 1]


def test_names_that_share_a_file_are_refused(spark, tmp_path):
    pages = pages_table(spark, 2).withColumn("cancer_type", F.concat(F.lit("X"), F.when(F.col("url") == "u0", " ").otherwise("-"), F.lit("Y")))
    with pytest.raises(ValueError, match="cancers/x_y.json"):
        writers.write_page_documents(pages, str(tmp_path / "out"))


def test_fetch_retries():
    replies = [(503, {"Retry-After": "7"}, ""), OSError("lost"), (200, {}, "body")]
    waits = []

    def fetcher(address, timeout):
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert fetching.fetch_one("u", fetcher, 1, waits.append) == "body" and waits == [7.0, 2.0]
    with pytest.raises(RuntimeError, match="404"):
        fetching.fetch_one("u", lambda a, t: (404, {}, ""), 1, waits.append)
    with pytest.raises(RuntimeError, match="503"):
        fetching.fetch_one("u", lambda a, t: (503, {}, ""), 1, lambda s: None)


def test_crawl_from_index_to_chunks(spark, tmp_path):
    base, index = fv.SITE_BASE_URL, fv.INDEX_URLS["adult_treatment"]
    body = "<main><h1>{0} Treatment (PDQ®)–Patient Version</h1><p>{0} text</p></main>"
    site = {
        index: '<main><a href="/types/a/patient/a-pdq?x=1">A</a><a href="/types/a/patient/a-pdq">A again</a>'
               '<a href="/types/b/patient/b-pdq">B</a><a href="/about">no</a><a href="/secret/c-pdq">C</a></main>',
        f"{base}/types/a/patient/a-pdq": body.format("Alpha Cancer"),
    }

    def fetcher(address, timeout, site=site):
        return (200, {}, site[address]) if address in site else (404, {}, "")

    out = str(tmp_path / "crawl")
    options = dict(collections=["adult_treatment"], robots_text="User-agent: *\nDisallow: /secret/\n", fetcher=fetcher,
                   sleep=lambda s: None)
    manifest = crawl.crawl(spark, out, **options)
    assert (manifest["discovered_url_count"], manifest["success_count"], manifest["failure_count"]) == (3, 1, 2)
    assert (manifest["cancer_file_count"], manifest["general_topic_file_count"]) == (1, 0)
    reasons = {r["url"].rsplit("/", 1)[1]: r["reason"] for r in spark.read.json(f"{out}/failures").collect()}
    assert reasons == {"b-pdq": "RuntimeError: HTTP status 404", "c-pdq": "disallowed_by_robots_txt"}
    assert manifest["cancer_files"] == ["cancers/alpha_cancer.json"] and manifest["general_topic_files"] == []
    assert manifest["failures"] == {"RuntimeError": 1, "disallowed_by_robots_txt": 1}
    chunk = retrieval.load_chunks(spark, [f"{out}/cancers"]).first()
    assert (chunk["cancer_type"], chunk["text"], chunk["audience"]) == ("Alpha Cancer", "Alpha Cancer text", "patient")

    site.pop(f"{base}/types/a/patient/a-pdq")  # now only in the snapshots
    site[f"{base}/types/b/patient/b-pdq"] = body.format("Beta Cancer")
    again = crawl.crawl(spark, out, use_cache=True, keep_html=False, **options)
    assert (again["success_count"], again["cancer_file_count"]) == (2, 2)
    with pytest.raises(ValueError):
        crawl.select_collections(["nope"])
