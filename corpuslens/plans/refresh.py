"""Incremental refresh: a versioned corpus that is brought up to date by what changed.

A corpus folder holds tables in parts by version and bucket (hash of the URL):

    changes       url, kind (new, changed, removed), digest: also the tombstones
    chunks        chunk rows of new and changed pages
    postings      url, chunk_id, chunk_len, terms (token, tf) of these chunks
    term_changes  token, change: what the version adds to the chunk count of a token
    bases         buckets that the version holds whole, after ``compact``
    commits       one row per finished version

``refresh`` reconciles a crawl with the last version by a full outer join on URL and compares
digests. Only new and changed pages are chunked and tokenized, only their buckets get files, and
the term counts change by the difference: postings added less postings dropped. Nothing is
rewritten. A version counts once its commit row is there; what a failed run left is overwritten
by the next one. There is one writer at a time; readers may open any version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import bm25, chunks
from corpuslens.session import broadcast_if_small, bucket_count, source_bytes, store, store_bucketed, writing

KINDS = ("new", "changed", "removed")
# Parts of a bucket above which ``compact`` writes it anew.
MOST_PARTS = 8
PAGE_FIELDS = ["title", "summary_name", "cancer_type", "topic", "audience", "source_file", "sections"]

_TABLES = {
    "changes": "url string, kind string, digest string, version int, bucket int",
    "chunks": "chunk_id string, title string, cancer_type string, topic string, audience string, section string, "
              "section_path array<string>, url string, source_file string, text string, load_order long, section_index int, "
              "chunk_index int, version int, bucket int",
    "postings": "url string, chunk_id string, chunk_len long, terms array<struct<token:string,tf:long>>, version int, bucket int",
    "term_changes": "token string, change long, version int",
    "bases": "bucket int, version int",
    "commits": "n_chunks long, total_len long, new long, changed long, removed long, unchanged long, buckets long, n_buckets int, version int",
}


# --- reconcile ------------------------------------------------------------------
def page_digests(pages: DataFrame) -> DataFrame:
    """url, digest of everything chunks are made of, over all pages of the URL.

    Combined on the map side from sums of 120 bits of each page's SHA-256, so that a URL with many
    pages is no hot group; where there are several, their order counts as well.
    """
    def parts(name: str, value: Column) -> list[Column]:
        h = F.sha2(value, 256)
        return [F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)").alias(f"{name}{at}") for at in (1, 16)]

    page = F.to_json(F.struct(*PAGE_FIELDS))
    hashed = pages.where(F.coalesce("url", F.lit("")) != "").select(
        "url", *parts("page", page), *parts("placed", F.concat_ws("\n", F.col("load_order").cast("string"), page))
    )
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("page1", "page16", "placed1", "placed16")]
    summed = hashed.groupBy("url").agg(F.count("*").alias("n"), *sums)
    one = F.concat_ws(",", "n", "page1", "page16")
    return summed.select("url", F.sha2(F.when(F.col("n") == 1, one).otherwise(F.concat_ws(",", one, "placed1", "placed16")), 256).alias("digest"))


def reconcile(before: DataFrame, now: DataFrame) -> DataFrame:
    """url, kind (new, changed, removed or unchanged), digest (of ``now``; null if removed) of two (url, digest) tables."""
    old = before.select("url", F.col("digest").alias("old"))
    kind = (
        F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "removed")
        .when(F.col("old") != F.col("digest"), "changed").otherwise("unchanged")
    )
    return old.join(now, "url", "full_outer").select("url", kind.alias("kind"), "digest")


# --- the store ------------------------------------------------------------------
@dataclass(frozen=True)
class Corpus:
    """The corpus in ``folder`` at a version; 0 is the empty one."""

    spark: SparkSession
    folder: str
    version: int
    n_buckets: int

    @staticmethod
    def open(spark: SparkSession, folder: str, version: int | None = None, n_buckets: int = 64) -> Corpus:
        """The last committed version or the given one. ``n_buckets`` counts for a new folder only."""
        folder = folder.rstrip("/")
        commits = _read(spark, folder, "commits").select("version", "n_buckets").collect()
        known = {0: n_buckets} | {r.version: r.n_buckets for r in commits}
        chosen = max(known) if version is None else version
        if chosen not in known:
            raise ValueError(f"no version {chosen} in {folder}")
        return Corpus(spark, folder, chosen, known[chosen])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.n_buckets)).cast("int")

    def read(self, table: str) -> DataFrame:
        """Rows of all versions up to this one."""
        return _read(self.spark, self.folder, table).where(F.col("version") <= self.version)

    def commits(self) -> DataFrame:
        return self.read("commits")

    def urls(self) -> DataFrame:
        """url, digest of the pages there are."""
        last = self.read("changes").groupBy("url").agg(F.max_by(F.struct("kind", "digest"), "version").alias("last"))
        return last.where("last.kind <> 'removed'").select("url", "last.digest")

    def live(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of chunks or postings whose page has not changed since; of some buckets only, by partition pruning."""
        rows, gone, bases = self.read(table), self.read("changes").where("kind <> 'new'"), self.read("bases")
        if buckets is not None:
            rows, gone = rows.where(F.col("bucket").isin(buckets)), gone.where(F.col("bucket").isin(buckets))
        base = {r.bucket: r.version for r in bases.groupBy("bucket").agg(F.max("version").alias("version")).collect()}
        if base:
            # A row per bucket, of which there are n_buckets.
            held = F.broadcast(self.spark.createDataFrame(list(base.items()), "bucket int, base int"))
            rows = rows.join(held, "bucket", "left").where("version >= coalesce(base, 0)").drop("base")
            gone = gone.join(held, "bucket", "left").where("version > coalesce(base, 0)").drop("base")
        stones = store(gone.groupBy("url").agg(F.max("version").alias("gone_at")), "tombstones")
        if stones.isEmpty():
            return rows
        return rows.join(broadcast_if_small(stones), "url", "left").where("gone_at is null or version >= gone_at").drop("gone_at")

    def chunks(self) -> DataFrame:
        return self.live("chunks").drop("version", "bucket")

    def terms(self) -> DataFrame:
        """token, df."""
        return self.read("term_changes").groupBy("token").agg(F.sum("change").alias("df")).where("df > 0")

    def index(self) -> bm25.Bm25Index:
        """The BM25 index of this version, as a build from all its pages gives it."""
        counts = {r.version: r for r in self.commits().collect()}.get(self.version)
        if counts is None or not counts.n_chunks:
            raise ValueError("at least one chunk is required")
        terms = store(self.terms(), "terms")
        # Moved once, a row per chunk, so that no search has to shuffle its scored pairs.
        lists = store_bucketed(self.live("postings").select("chunk_id", "chunk_len", "terms"), "live_postings", "chunk_id")
        postings = lists.select("chunk_id", "chunk_len", F.inline("terms"))
        return bm25.Bm25Index(
            self.chunks(), postings, terms, counts.n_chunks, counts.total_len, bm25.average_idf(terms, counts.n_chunks), (lists,)
        )


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    path = f"{folder}/{table}"
    if not _exists(spark, path):
        return spark.createDataFrame([], _TABLES[table])
    return spark.read.schema(_TABLES[table]).parquet(path)


def _write(rows: DataFrame, corpus: Corpus, table: str, version: int, by_bucket: bool = True, moved: bool = True) -> DataFrame:
    """Write the version's part of a table, and read it back. Spark splits large buckets and joins small ones by itself.

    ``moved`` is False for rows that come from files of one bucket each: they stay where they are.
    """
    path = f"{corpus.folder}/{table}/version={version}"
    out = rows.hint("rebalance", "bucket") if by_bucket and moved else rows
    writer = out.write.mode("overwrite")
    with writing(corpus.spark, bucket_count(corpus.spark, source_bytes(rows))):
        (writer.partitionBy("bucket") if by_bucket else writer).parquet(path)
    return _read(corpus.spark, corpus.folder, table).where(F.col("version") == version)


def _counts(postings: DataFrame, sign: int) -> DataFrame:
    return postings.select(F.explode("terms.token").alias("token")).groupBy("token").agg((F.count("*") * sign).alias("change"))


def refresh(corpus: Corpus, pages: DataFrame) -> Corpus:
    """The next version, after a crawl that found ``pages`` (see ``chunks.usable_sections``)."""
    version = corpus.version + 1
    first = corpus.version == 0
    found = store(reconcile(corpus.urls(), page_digests(pages)).withColumn("bucket", corpus.bucket()), "reconciled")
    kinds = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    changes = _write(found.where("kind <> 'unchanged'"), corpus, "changes", version)
    buckets = sorted(r.bucket for r in changes.select("bucket").distinct().collect())  # at most n_buckets

    fresh = changes.where("kind <> 'removed'").select("url")
    read = pages if first else pages.join(broadcast_if_small(fresh), "url", "left_semi")
    made = _write(chunks.chunk_pages(read).withColumn("bucket", corpus.bucket()), corpus, "chunks", version)
    postings = _write(_postings(made), corpus, "postings", version, moved=False)

    gone = changes.where("kind <> 'new'").select("url")
    if first:
        dropped, dropped_chunks = postings.limit(0), made.limit(0)
    else:
        dropped = corpus.live("postings", buckets).join(broadcast_if_small(gone), "url", "left_semi")
        dropped_chunks = corpus.live("chunks", buckets).join(broadcast_if_small(gone), "url", "left_semi")
    difference = _counts(postings, 1).unionByName(_counts(dropped, -1)).groupBy("token").agg(F.sum("change").alias("change"))
    _write(difference.where("change <> 0"), corpus, "term_changes", version, by_bucket=False)

    before = {r.version: r for r in corpus.commits().collect()}.get(corpus.version)
    length = lambda rows: rows.agg(F.sum("chunk_len")).first()[0] or 0
    commit = Row(
        n_chunks=(before.n_chunks if before else 0) + made.count() - dropped_chunks.count(),
        total_len=(before.total_len if before else 0) + length(postings) - length(dropped),
        **{k: kinds.get(k, 0) for k in (*KINDS, "unchanged")}, buckets=len(buckets), n_buckets=corpus.n_buckets,
    )
    return _commit(corpus, version, commit)


def _postings(made: DataFrame) -> DataFrame:
    """Length and terms of each chunk, with its URL and bucket, in one narrow step."""
    rows = chunks.with_search_text(made).select("url", "chunk_id", "search_text", "bucket")
    listed = bm25.term_lists(rows, F.col("search_text"))
    return listed.select("url", "chunk_id", F.col("n_tokens").alias("chunk_len"), "terms", "bucket")


def _commit(corpus: Corpus, version: int, row: Row) -> Corpus:
    schema = _TABLES["commits"].removesuffix(", version int")
    _write(corpus.spark.createDataFrame([row], schema).coalesce(1), corpus, "commits", version, by_bucket=False)
    return Corpus(corpus.spark, corpus.folder, version, corpus.n_buckets)


def compact(corpus: Corpus, most_parts: int = MOST_PARTS) -> Corpus:
    """The next version, with the same pages: buckets in more than ``most_parts`` parts are written whole, without their dead rows."""
    base = corpus.read("bases").groupBy("bucket").agg(F.max("version").alias("base"))
    parts = (
        corpus.read("changes").select("version", "bucket").distinct().join(F.broadcast(base), "bucket", "left")
        .where("version > coalesce(base, 0)").groupBy("bucket").count().where(F.col("count") > most_parts)
    )
    buckets = sorted(r.bucket for r in parts.collect())
    if not buckets:
        return corpus
    version = corpus.version + 1
    for table in ("chunks", "postings"):
        _write(corpus.live(table, buckets).drop("version"), corpus, table, version)
    _write(corpus.spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1), corpus, "bases", version, by_bucket=False)
    last = corpus.commits().where(F.col("version") == corpus.version).drop("version").first()
    return _commit(corpus, version, Row(**(last.asDict() | dict.fromkeys(KINDS, 0) | {"buckets": len(buckets)})))

