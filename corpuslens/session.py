"""Session defaults, durable intermediate tables and the broadcast size check."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import finalize

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a side is never broadcast; at ~100 bytes a row this is far
# below the executor memory any cluster gives.
BROADCAST_ROWS = 500_000
# Data in one bucket of a stored table, where the number of buckets allows; what a task of a
# search holds (a score for each question and chunk of a bucket) hangs on it.
BUCKET_BYTES = 8 << 20
# Pages that go to a Python worker at once.
ARROW_ROWS = 500
# Partition files that a task keeps open, before it sorts its rows by file.
OPEN_FILES = 4
# Catalyst's size of a source whose size it does not know is above this.
UNKNOWN_BYTES = 1 << 60


def local_session(cores: int = 8, app: str = "corpuslens") -> SparkSession:
    """Session for tests and local runs; a cluster brings its own settings."""
    return ship_package(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLENS_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


_SHIPPED: set[str] = set()
# Catalog names of bucketed tables, by the id of their live DataFrame; stand-in folders of local sessions without spark.checkpoint.dir.
_TABLES: dict[int, str] = {}
_LOCAL_FOLDERS: dict[str, str] = {}


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="corpuslens-")) / "corpuslens"
        archive = shutil.make_archive(str(base), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    return spark


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_ROWS`` rows: Spark's own 10 000 are too many pages. A smaller number set is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, a temporary
    folder stands in for an unset one. On a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL_FOLDERS.get(context.applicationId) or tempfile.mkdtemp(prefix="corpuslens-")
        _LOCAL_FOLDERS[context.applicationId] = folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path, not used so far, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage durably: a lost executor costs a re-read, not a recompute, and
    later readers still get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets for ``size`` bytes: as many as shuffle partitions or, above that, one
    per ``BUCKET_BYTES``, within what Spark allows."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    wished = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    return min(wished, most)


def source_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads, as Catalyst knows it; sources of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


@contextmanager
def writing(spark: SparkSession, partitions: int, aligned: bool = False) -> Iterator[None]:
    """Plan the jobs inside with this many shuffle partitions, and write the files of a partitioned
    or bucketed table without sorting the rows by file where a task has few of them.

    ``aligned`` keeps a task to a partition or bucket: Spark would join small ones, whose files then are more than a task keeps open.
    """
    wanted = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}
    if aligned:
        wanted |= {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Like :func:`store`, but bucketed by ``key`` so that later joins and
    aggregations on ``key`` need no exchange.

    The number of buckets is given or follows from the size of the files read; where that is
    unknown, the number of shuffle partitions decides. The shuffles of ``df`` have as many
    partitions, so that one by ``key`` is not done again. :func:`drop_bucketed` takes the table away.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = bucket_count(spark, source_bytes(df))
    table = f"{name}_{uuid.uuid4().hex}"
    with writing(spark, buckets, aligned=True):
        (
            df.repartition(buckets, key)
            .write.format("parquet")
            .bucketBy(buckets, key)
            .option("path", f"{shared_dir(spark)}/{table}")
            .saveAsTable(table)
        )
    stored = spark.table(table)
    _TABLES[id(stored)] = table
    # An id may be given again once its owner is gone.
    finalize(stored, _TABLES.pop, id(stored), None)
    return stored


def drop_bucketed(stored: DataFrame) -> None:
    """Drop the catalog entry of a table that :func:`store_bucketed` made."""
    table = _TABLES.pop(id(stored), None)
    if table:
        stored.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows of a source with fewer splits than cores, by ``key``.

    For heavy per-row work on a small table kept in one file. Large inputs have
    more splits than cores and pass through unshuffled.
    """
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
    return df


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` provably has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast behind a size check; otherwise leave the join to
    Spark's shuffled joins and AQE's skew splitting."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df
