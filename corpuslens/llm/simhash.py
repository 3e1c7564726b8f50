"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The
Manhattan distance of two such vectors never exceeds the Hamming distance, so
links (3 bits or fewer) lie within Manhattan distance 3. The grid: the segments
form six blocks, of which at least three are equal for such a pair; a cell is
a choice of three blocks with their counts. Members of a cell are compared by
Manhattan distance first and then exactly. A cell yields a spanning forest of
its links, never all pairs: linear output, the same components.

Cells above a bound are not held by one task: they are cut into chunks, and each
pair of chunks is a task's work.

Defined results: null text and text without a word have fingerprint 0 and link
like any other; null ids are passed on and never name a component unless all its
ids are null; repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import attach, text_key, text_of, without
from corpuslens.llm.components import components
from corpuslens.session import store

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENTS = 32
BLOCKS = 6
# Members of a cell that one task compares in memory.
CELL = 4096

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HASHES = 1 << 16  # hashes whose bits are counted at once


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``shingle`` words, in order; of all words if there are fewer."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as a signed 64-bit integer."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES):
        part = hashes[i : i + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, fp (signed long)."""
    return docs.select("doc_id", text_key().alias("text_key"), F.pandas_udf(_fingerprints, "long")(text_of(F.col("text"))).alias("fp"))


def _cells(fps: DataFrame) -> DataFrame:
    """Per fingerprint one row for each cell it lies in: cell, counts, fp."""
    # The count of a two-bit segment, 0 to 2, in two bits: their XOR below, their AND above.
    even, odd = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (F.col("fp"), F.shiftrightunsigned("fp", 1)))
    counts = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    edges = [round(i * SEGMENTS / BLOCKS) for i in range(BLOCKS + 1)]
    masks = []
    for chosen in combinations(range(BLOCKS), BLOCKS - MOST_BITS):
        mask = sum(3 << 2 * s for b in chosen for s in range(edges[b], edges[b + 1]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    cell = F.explode(F.array(*[
        F.struct(F.lit(i).alias("cell"), F.col("counts").bitwiseAND(F.lit(m)).alias("counts")) for i, m in enumerate(masks)
    ]))
    return fps.withColumn("counts", counts).select("fp", cell.alias("c")).select("c.cell", "c.counts", "fp")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``fps``, as index pairs."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).reshape(len(fps), 8, 8)
    near = bits.sum(2, dtype=np.int8)  # coarser segments: still a lower bound
    fps = fps.view(np.uint64)  # bits of a negative number would be those of its absolute value
    left = np.arange(len(fps))
    out, todo = [], []
    while len(left) or todo:
        if todo:
            at = todo.pop()
        else:
            at, left = int(left[0]), left[1:]
        if not len(left):
            break
        found = left[np.abs(near[left] - near[at]).sum(1) <= MOST_BITS]
        found = found[np.bitwise_count(fps[found] ^ fps[at]) <= MOST_BITS]
        if len(found):
            out += [(at, int(x)) for x in found]
            todo += found.tolist()
            left = np.setdiff1d(left, found, assume_unique=True)
    return out


def _linked(most: int):
    """Rows sorted by cell -> links (u, v), or the cell and its size where it has more than ``most`` members."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, size = None, [], 0

        def close(out: list) -> None:
            if size > most:
                out.append((key[1], size, key[0]))
            elif size > 1:
                fps = np.concatenate(held)
                out += [(int(fps[a]), int(fps[b]), None) for a, b in _forest(fps)]

        for rows in batches:
            if rows.empty:
                continue
            cell, counts, fps = (rows[c].to_numpy() for c in ("cell", "counts", "fp"))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (counts[1:] != counts[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(rows)]))
            # Whole cells with one member need no work; the first and last may go on in other batches.
            many = set(np.flatnonzero(np.diff(bounds) > 1).tolist()) | {0, len(bounds) - 2}
            out: list[tuple] = []
            for i in sorted(many):
                a, b = int(bounds[i]), int(bounds[i + 1])
                if key != (cell[a], counts[a]):
                    close(out)
                    key, held, size = (cell[a], counts[a]), [], 0
                size += b - a
                held = [*held, fps[a:b]] if size <= most else []
            if out:
                yield _frame(out)
        out = []
        close(out)
        if out:
            yield _frame(out)

    return scan


def _frame(out: list[tuple]) -> pd.DataFrame:
    u, v, cell = zip(*out)
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64), "cell": pd.array(cell, "Int32")})


def links(fps: DataFrame, cell_members: int = CELL) -> DataFrame:
    """Links (u, v) that connect whatever pairs of distinct ``fp`` within 3 bits connect."""
    schema = "u long, v long, cell int"
    cells = _cells(fps)
    found = store(
        cells.repartition("cell", "counts").sortWithinPartitions("cell", "counts")
        .mapInPandas(_linked(cell_members), schema),
        "simhash-links",
    )
    large = found.where("cell is not null").select("cell", F.col("u").alias("counts"), F.col("v").alias("size"))
    small = found.where("cell is null").select("u", "v")
    if large.isEmpty():
        return small
    # Each pair of chunks of a large cell is a cell of its own, of at most about cell_members rows.
    chunks = F.ceil(F.col("size") / (cell_members // 4)).cast("int")
    dealt = (
        cells.join(large, ["cell", "counts"])
        .withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .select("cell", "counts", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select(F.xxhash64("cell", "counts", F.least("mine", "other"), F.greatest("mine", "other")).alias("counts"), "fp",
                "cell")
    )
    again = (
        dealt.repartition("cell", "counts").sortWithinPartitions("cell", "counts")
        .mapInPandas(_linked(2**62), schema)
    )
    return small.unionByName(again.select("u", "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, fp, component_id (smallest doc_id reachable)."""
    rows = store(fingerprints(docs), "simhash")
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size")), "simhash-classes")
    roots = store(components(links(classes.select("fp"))).withColumnRenamed("node", "fp"), "simhash-roots")
    named = roots.join(classes, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    lookup = store(
        classes.join(roots.join(named, "root").drop("root"), "fp", "left")
        .select("fp", "size", F.coalesce("component_id", "least_id").alias("component_id")),
        "simhash-components",
    )
    return attach(rows, lookup, "fp", "size").select("doc_id", "text_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of a component other than that of its smallest doc_id.

    A row without an id goes if a row with one stands for it, and stays if none does.
    """
    return without(docs, near_duplicates(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
