"""Sum-of-squares packing of documents into token sequences.

A document's tokens end with a separator; documents longer than a sequence are
cut into full pieces and a rest. Pieces are dealt into shards of bounded size by
hash; in a shard each piece, the longest first, goes to the open sequence
(or a new one) that makes the sum over residual gaps of the squared number of open
sequences with that gap smallest. Ties go to the smallest gap. A shard leaves
a few part-filled sequences, against tens of thousands of pieces.

Tokens come from a public tokenizer file. A text's pre-tokens are encoded once
per worker and reused (same ids: the tokenizer works on each pre-token alone);
texts with characters outside printable Latin-1 or with special-token marks are
encoded whole.

Defined results: null text counts as empty, so it is the separator alone; repeated
rows are packed as often as they occur; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import text_of
from corpuslens.session import store

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "word_bpe_49k.json"
SHARD_PIECES = 50_000
_CACHED = 200_000

# Fixed values of the tokenizer file: its pre-token pattern, here with its classes spelled
# out for Latin-1. Lower-casing comes first.
_LETTERS = "a-zªµºß-öø-ÿ"
_DIGITS = "0-9²³¹¼-¾"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_USUAL = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies (public rule)."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in printable else next(others) for b in range(256)}


class _Bounded(dict):
    """A cache that starts anew when it is full."""

    def __init__(self, make, most: int = _CACHED) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


class Encoder:
    """Token ids of texts, little-endian unsigned 32 bit, with caches of words and of their pre-tokens."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.plain = name == TOKENIZER
        self.pretokens = _Bounded(self._pretoken)
        self.words = _Bounded(lambda word: b"".join(map(self.pretokens.__getitem__, _PRETOKEN.findall(word.lower()))))

    def _pretoken(self, pretoken: str) -> bytes:
        # Visible ASCII letters stand for themselves.
        spelled = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _usual(self, text: str) -> bool:
        try:
            return self.plain and "<|" not in text and not text.encode("latin-1").translate(None, _USUAL)
        except UnicodeEncodeError:
            return False

    def ids(self, text: str) -> bytes:
        if self._usual(text):
            return b"".join(map(self.words.__getitem__, text.split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """One per worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Per piece of each row of ``docs``: doc_id, piece, start, length, ids (binary, little-endian unsigned 32 bit)."""
    end = np.array([separator], "<u4").tobytes()

    def encode(texts: pd.Series) -> pd.Series:
        own = encoder(tokenizer)
        return pd.Series([own.ids(t) + end for t in texts], dtype=object)

    ids = F.pandas_udf(encode, "binary")
    width = 4 * capacity
    return (
        docs.select("doc_id", ids(text_of(F.col("text"))).alias("all_ids"))
        .select("doc_id", "all_ids", F.posexplode(
            F.sequence(F.lit(1), F.length("all_ids"), F.lit(width))
        ).alias("piece", "at"))
        .select(
            "doc_id", "piece", ((F.col("at") - 1) / 4).cast("long").alias("start"),
            F.substring("all_ids", F.col("at"), F.lit(width)).alias("ids"),
        )
        .withColumn("length", (F.length("ids") / 4).cast("long"))
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by level
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        # From level h to h + size; full sequences are closed and no longer count.
        change = 2 * (count[size:] - count[: capacity + 1 - size]) + 2
        change[-1] = 1 - 2 * count[capacity - size]
        change[count[: capacity + 1 - size] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * count[size] + 1 if size < capacity else 0  # a new one
        level = len(change) - 1 - int(change[::-1].argmin())
        if level:
            chosen = open_at[level].pop()
            count[level] -= 1
        else:
            chosen, used = used, used + 1
        sequence[i], offset[i] = chosen, level
        if level + size < capacity:
            open_at[level + size].append(chosen)
            count[level + size] += 1
    return sequence, offset


def packed(rows: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``rows``, a stored table (doc_id, piece, length, any others), with sequence_id and offset."""
    shards = max(1, -(-rows.count() // shard_pieces))
    names = rows.columns
    kind = rows.schema
    # By the row's place in the stored table, so that shards are even whatever the ids.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def pack(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sequence, shard["offset"] = sum_of_squares(shard["length"].to_numpy(), capacity)
        shard["sequence_id"] = sequence * shards + key[0]
        return shard[[*names, "sequence_id", "offset"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return dealt.groupBy("shard").applyInPandas(pack, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = store(
        pieces(docs, capacity, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")),
        "pieces",
    )
    return packed(rows, capacity, shard_pieces)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (array<int>), doc_ids (in order of place)."""
    rows = store(pieces(docs, capacity, tokenizer), "piece-ids")
    placed = packed(rows, capacity, shard_pieces)

    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in parts], dtype=object)

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (
        placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
        .select("sequence_id", "length", F.pandas_udf(joined, "array<int>")("parts.ids").alias("ids"),
                F.col("parts.doc_id").alias("doc_ids"))
    )
