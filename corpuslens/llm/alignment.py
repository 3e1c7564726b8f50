"""Alignment of two tokenizers over the same texts, in Arrow arrays.

Byte offsets at which a token of either side ends cut a text into groups; tokens of
one group are linked. Texts are taken with one space in front, which side B adds itself.

1. ``blocks``: each task cuts its rows into blocks of bounded size. In a block, token
   lists are flattened with their parent indices, byte ends are segmented cumulative
   sums of token lengths, an Acero hash join on (document, end) finds the cuts, another on
   the group the linked id pairs. ``Table.group_by`` counts the documents of each pair.
2. ``pair_counts``: Spark merges the blocks' partial counts.
3. ``document_links``: each block gets the counts of its own pairs back and sums them up
   per document in Arrow. A pair is one row a block, however many documents hold it, so
   no common pair makes a hot key, and texts are encoded once.

Side A is read from the rank file of its vocabulary, which gives the ids of
``byte_bpe_50k.json`` (tests compare them over all characters) in a third of the time.

Defined results: texts that are null or empty, or whose joined token bytes on either
side are not the spaced text (such as texts with U+2581), have no tokens; a repeated row
counts as a document of its own; null ids are passed on; an empty table gives an
empty result; other columns are ignored. A text is held whole by one task, beside
a few arrays as long as its tokens; the pairs of its groups are formed in parts of
at most ``PAIR_ROWS`` rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import store

SIDE_A, SIDE_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
# Bytes of text in a block, but for a single longer text.
BLOCK_BYTES = 2 << 20
# Rows of linked pairs formed at once, but for those of one id.
PAIR_ROWS = 1 << 21
# Bits of a byte offset in a join key: texts are below 2 GB, blocks below 2 ** 31 rows.
END_BITS = 32
# Segments encoded as one text; longer texts take more time a letter.
TOGETHER = 64
# A space after a visible character, other than the letter side B writes spaces with.
_CUT = re.compile(r" (?<=[^\s▁] )")


class Side:
    """A tokenizer with the bytes of each of its ids.

    No token of either kind holds a visible character and, after it, a space, so texts are
    encoded in segments cut there, each once a block; other models are not taken.
    """

    def __init__(self, encode: Callable[[str], list[int]], spelled: list[bytes], names: list[str]) -> None:
        if any(_CUT.search(name) for name in names):
            raise ValueError("the vocabulary has tokens that go on after a space")
        self.encode = encode
        self.token_bytes = pa.array(spelled, pa.large_binary())
        self.lengths = pa.array([len(s) for s in spelled], pa.int64())

    def segment_ids(self, segments: list[str]) -> pa.ListArray:
        """Token ids of each segment, a space in front."""
        # A space may follow these: many are encoded as one text and told apart by their ends.
        plain = [i for i, s in enumerate(segments) if s and not s[-1].isspace() and "▁" not in s]
        texts = [" ".join([segments[i] for i in plain[at : at + TOGETHER]]) for at in range(0, len(plain), TOGETHER)]
        ids = np.fromiter(chain.from_iterable(map(self.encode, texts)), np.int32)
        ends = np.cumsum(_numbers(self.lengths)[ids])
        wanted = np.cumsum(_numbers(pc.binary_length(pa.array([segments[i] for i in plain], pa.large_string()))) + 1)
        places = np.searchsorted(ends, wanted)
        if len(plain) and not (ends[-1] == wanted[-1] and (ends[places] == wanted).all()):
            plain, ids, places = [], ids[:0], places[:0]
        rest = np.setdiff1d(np.arange(len(segments)), plain).tolist()
        others = pa.array([self.encode(segments[i]) for i in rest], pa.list_(pa.int32()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], places + 1)), pa.int32()), pa.array(ids))
        return pa.concat_arrays([lists, others]).take(pa.array(np.argsort(np.concatenate((plain, rest)))))


@dataclass
class Segments:
    """The texts of a block, cut: the different segments, which of them follow each other, the first of each text."""

    different: list[str]
    codes: pa.Array
    first: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Segments:
        cut = []
        for t in texts:
            visible = t.rstrip()
            cut.append(_CUT.split(visible))
            cut[-1][-1] += t[len(visible):]
        coded = pa.array([s for c in cut for s in c], pa.large_string()).dictionary_encode()
        return Segments(coded.dictionary.to_pylist(), coded.indices, np.concatenate(([0], np.cumsum([len(c) for c in cut], dtype=np.int64))))

    def ids(self, own: Side) -> pa.ListArray:
        """Token ids of each text."""
        parts = own.segment_ids(self.different).take(self.codes)
        ends = np.concatenate(([0], np.cumsum(_numbers(pc.list_value_length(parts)), dtype=np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends[self.first].astype(np.int32)), pc.list_flatten(parts))


def _ranked(path: str) -> Side:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spelled[rank] = token
    return Side(lambda segment: encoding.encode_ordinary(" " + segment), spelled, [s.decode(errors="replace") for s in spelled])


def _pieces(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size())]
    spelled = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.encode() for i, name in enumerate(names)]
    return Side(model.encode, spelled, names)


@cache
def side(name: str) -> Side:
    """One of each tokenizer per worker process."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    return _ranked(path) if name.endswith(".tiktoken") else _pieces(path)


def _numbers(array) -> np.ndarray:
    return (array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array).to_numpy(zero_copy_only=False)


def _whole(own: Side, ids: pa.ListArray, spaced: pa.LargeStringArray) -> np.ndarray:
    """Whether each text's token bytes join to it."""
    joined = own.token_bytes.take(ids.flatten())
    ends, wanted = _offsets(joined)[_numbers(ids.offsets)], _offsets(spaced)
    own_bytes, text_bytes = joined.buffers()[2], spaced.buffers()[2]
    same = np.diff(ends) == np.diff(wanted)
    for i in np.flatnonzero(same).tolist():
        n = int(ends[i + 1] - ends[i])
        same[i] = n == 0 or own_bytes.slice(int(ends[i]), n).equals(text_bytes.slice(int(wanted[i]), n))
    return same


def _offsets(array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8 * array.offset)


@dataclass
class Tokens:
    """Flat arrays over the tokens of one side."""

    ids: pa.Array
    doc: pa.Array
    end: pa.Array
    first: np.ndarray  # first token of each document, and the end
    cut: np.ndarray | None = None  # whether the other side has a token that ends here
    group: pa.Array | None = None

    def set_cuts(self, places: np.ndarray) -> None:
        self.cut = np.zeros(len(self.ids), bool)
        self.cut[places] = True
        before = pa.array(self.cut).cast(pa.int64())
        self.group = pc.subtract(pc.cumulative_sum(before), before)


def _tokens(own: Side, ids: pa.ListArray, kept: np.ndarray) -> Tokens:
    ids = pc.if_else(pa.array(kept), ids, pa.scalar([], ids.type))
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    first = np.concatenate(([0], np.cumsum(_numbers(pc.list_value_length(ids)), dtype=np.int64)))
    running = pc.cumulative_sum(own.lengths.take(flat))
    before = np.concatenate(([0], _numbers(running)))[first[:-1]]
    return Tokens(flat, doc, pc.subtract(running, pa.array(before).take(doc)), first)


def _aligned(texts: list[str], a: Side, b: Side) -> tuple[Tokens, Tokens]:
    """Tokens of both sides with their groups, numbered through all ``texts``."""
    spaced = pa.array([" " + t for t in texts], pa.large_string())
    segments = Segments.of(texts)
    ids_a, ids_b = segments.ids(a), segments.ids(b)
    kept = np.array([bool(t) for t in texts], bool) & _whole(a, ids_a, spaced) & _whole(b, ids_b, spaced)
    first, second = _tokens(a, ids_a, kept), _tokens(b, ids_b, kept)
    # Document in the upper bits, end in the lower: one key column.
    keyed = [
        pa.table({"key": pc.add(pc.shift_left(t.doc.cast(pa.int64()), pa.scalar(END_BITS, pa.int64())), t.end), place: pa.array(np.arange(len(t.ids)))})
        for t, place in ((first, "place_a"), (second, "place_b"))
    ]
    cuts = keyed[0].join(keyed[1], "key", join_type="inner", use_threads=False)
    first.set_cuts(_numbers(cuts["place_a"]))
    second.set_cuts(_numbers(cuts["place_b"]))
    return first, second


def _grouped(tokens: Tokens, kept: np.ndarray, name: str) -> pa.Table:
    """group, id and how often, of the ``kept`` tokens."""
    kept = pa.array(kept)
    return (
        pa.table({"group": tokens.group.filter(kept), name: tokens.ids.filter(kept)}).group_by(["group", name], use_threads=False)
        .aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"])
    )


def _pair(a, b):
    return pc.bit_wise_or(pc.shift_left(a.cast(pa.int64()), pa.scalar(32, pa.int64())), b.cast(pa.int64()))


def _pairs(first: Tokens, second: Tokens) -> pa.Table:
    """doc, pair (id of A above 32 bits, id of B below) and times: all links, counted."""
    group_a, group_b = _numbers(first.group), _numbers(second.group)
    doc_of = first.doc.filter(pa.array(first.cut))
    # Most groups are one token a side: these pair up in order, the others are joined.
    single = (np.bincount(group_a, minlength=len(doc_of)) == 1) & (np.bincount(group_b, minlength=len(doc_of)) == 1)
    single_a, single_b = single[group_a], single[group_b]
    pair = _pair(first.ids.filter(pa.array(single_a)), second.ids.filter(pa.array(single_b)))
    out = [_summed(pa.table({"doc": first.doc.filter(pa.array(single_a)), "pair": pair, "times": pa.array(np.ones(len(pair), np.int64))}))]
    a, b = _grouped(first, ~single_a, "a"), _grouped(second, ~single_b, "b")
    a = a.append_column("doc", doc_of.take(a["group"]))
    # Each row of a meets the ids of its group in b.
    part = np.cumsum(np.bincount(_numbers(b["group"]), minlength=len(doc_of))[_numbers(a["group"])]) // PAIR_ROWS
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for low, high in zip(bounds, bounds[1:]):
        met = a.slice(low, high - low).join(b, "group", join_type="inner", use_threads=False)
        out.append(_summed(pa.table({"doc": met["doc"], "pair": _pair(met["a"], met["b"]), "times": pc.multiply(met["n_a"], met["n_b"])})))
    return _summed(pa.concat_tables(out))


def _summed(links: pa.Table) -> pa.Table:
    summed = links.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])
    return pa.table({"doc": summed["doc"], "pair": summed["pair"], "times": summed["times_sum"]})


def _per_doc(doc, values, n: int) -> np.ndarray:
    """Sums of ``values`` per document, 0 where it has none."""
    summed = pa.table({"doc": doc, "value": values}).group_by("doc", use_threads=False).aggregate([("value", "sum")])
    out = np.zeros(n, np.int64)
    out[_numbers(summed["doc"])] = _numbers(summed["value_sum"])
    return out


def _places(first: Tokens, second: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens when each group's ids of A are followed by those of B."""
    group_a, group_b = _numbers(first.group), _numbers(second.group)
    groups = int(first.cut.sum())
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=groups))))
    until_a = np.cumsum(np.bincount(group_a, minlength=groups))
    return np.arange(len(group_a)) + before_b[group_a], np.arange(len(group_b)) + until_a[group_b]


def _digests(first: Tokens, second: Tokens) -> list[str]:
    """SHA-256 of the groups of each document as text, '' without tokens."""
    at_a, at_b = _places(first, second)
    ids, mark = np.zeros(len(at_a) + len(at_b), np.int32), np.zeros(len(at_a) + len(at_b), np.int8)
    ids[at_a], ids[at_b] = _numbers(first.ids), _numbers(second.ids)
    mark[at_a[first.cut]], mark[at_b[second.cut]] = 1, 2
    marks = pa.array([",", "|", ";"], pa.large_string()).take(pa.array(mark))
    text = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), marks, pa.scalar("", pa.large_string()))
    ends = _offsets(text)[first.first + second.first].tolist()
    written = memoryview(text.buffers()[2] or b"")
    return [hashlib.sha256(written[low : high - 1]).hexdigest() if high > low else "" for low, high in zip(ends, ends[1:])]


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    with pa.ipc.open_stream(packed) as stream:
        return stream.read_all()


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        low = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            if size and size + n > most:
                yield pa.Table.from_batches([*held, batch.slice(low, i - low)])
                held, size, low = [], 0, i
            size += n
        held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def blocks(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored table, a row per block of documents.

    Columns: block; documents (Arrow stream of doc_id, n_a, n_b, n_groups, n_links, groups_sha256);
    links (Arrow stream of doc, slot, times); pairs and n_docs, both by slot.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        own_a, own_b = side(a), side(b)
        start = TaskContext.get().partitionId() << 32
        for i, rows in enumerate(_cut(batches, block_bytes)):
            texts = [t or "" for t in rows["text"].to_pylist()]
            first, second = _aligned(texts, own_a, own_b)
            linked = _pairs(first, second)
            coded = linked["pair"].combine_chunks().dictionary_encode()
            links = pa.table({"doc": linked["doc"].cast(pa.int32()), "slot": coded.indices, "times": linked["times"]}).sort_by(
                [("doc", "ascending"), ("slot", "ascending")]
            )
            counted = links.group_by("slot", use_threads=False).aggregate([([], "count_all")]).sort_by("slot")
            documents = pa.table({
                "doc_id": rows["doc_id"], "n_a": np.diff(first.first), "n_b": np.diff(second.first),
                "n_groups": _per_doc(first.doc, pa.array(first.cut.astype(np.int64)), len(texts)),
                "n_links": _per_doc(linked["doc"], linked["times"], len(texts)), "groups_sha256": _digests(first, second),
            })
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([start + i]), "documents": pa.array([_packed(documents)], pa.binary()),
                "links": pa.array([_packed(links)], pa.binary()),
                "pairs": pa.array([_numbers(coded.dictionary)], pa.list_(pa.int64())),
                "n_docs": pa.array([_numbers(counted["count_all"])], pa.list_(pa.int64())),
            })

    schema = "block long, documents binary, links binary, pairs array<long>, n_docs array<long>"
    return store(docs.select("doc_id", "text").mapInArrow(align, schema), "aligned-blocks")


def _block_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("slot", "p")).select(
        "block", "slot", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n_docs")
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n_docs (documents that hold the pair linked), best (no b of this a has more) from ``blocks``. A stored table."""
    counts = store(_block_pairs(aligned).groupBy("pair").agg(F.sum("n_docs").alias("n_docs")), "pair-counts")
    # A row per id of A: bounded by its vocabulary.
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(most), "a").select(
        "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best"), "pair"
    )


def document_links(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = blocks(docs, a, b, block_bytes)
    known = pair_counts(aligned).select("pair", "n_docs", "best")
    own = _block_pairs(aligned).drop("n_docs").join(known, "pair").select(F.col("block").alias("own_block"), "slot", "n_docs", "best")

    def finish(block: pa.Table, counts: pa.Table) -> pa.Table:
        pa.set_cpu_count(1)
        out = []
        for packed_documents, packed_links in zip(block["documents"].to_pylist(), block["links"].to_pylist()):
            documents, links = _unpacked(packed_documents), _unpacked(packed_links)
            links = links.join(counts.select(["slot", "n_docs", "best"]), "slot", join_type="inner", use_threads=False)
            n = documents.num_rows
            best = pc.multiply(links["times"], links["best"].cast(pa.int64()))
            out.append(
                documents.append_column("n_best", pa.array(_per_doc(links["doc"], best, n)))
                .append_column("count_sum", pa.array(_per_doc(links["doc"], pc.multiply(links["times"], links["n_docs"]), n)))
            )
        return pa.concat_tables(out).select(names)

    counted = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    names = ["doc_id", *counted, "groups_sha256"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counted)}, groups_sha256 string"
    return aligned.select("block", "documents", "links").groupBy("block").cogroup(own.groupBy("own_block")).applyInArrow(finish, schema)


def groups(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per group of each row of ``docs``: doc_id, place (from 0), start, end (bytes of the spaced text), a, b (ids in order)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        for rows in _cut(batches, block_bytes):
            first, second = _aligned([t or "" for t in rows["text"].to_pylist()], side(a), side(b))
            if not first.cut.any():
                continue
            cut = pa.array(first.cut)
            doc, end = first.doc.filter(cut), first.end.filter(cut)
            own = np.diff(_numbers(doc), prepend=-1) > 0
            place = np.arange(len(own)) - np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))
            start = np.where(own, 0, np.concatenate(([0], _numbers(end)[:-1])))

            def listed(t: Tokens) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.flatnonzero(t.cut) + 1)), pa.int32()), t.ids)

            yield from pa.table({
                "doc_id": rows["doc_id"].combine_chunks().take(doc), "place": pa.array(place), "start": pa.array(start, pa.int64()),
                "end": end, "a": listed(first), "b": listed(second),
            }).to_batches(10_000)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(align, f"doc_id {kind}, place long, start long, end long, a array<int>, b array<int>")
