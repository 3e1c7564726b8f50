import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslens.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB'sS tll <|endoftext>é#12ßÀ \u0085\x1cİ", max_size=40)))
def test_same_ids_as_the_tokenizer(text):
    assert np.frombuffer(packing.encoder().ids(text), "<u4").tolist() == plain_ids(text)


def brute_sum_of_squares(sizes, capacity):
    """The rule itself: try every place, count the squares."""
    levels, out = [], []
    for size in sizes:
        best = None
        for at in [None, *range(len(levels))]:
            level = 0 if at is None else levels[at]
            if level + size > capacity or level == capacity:
                continue
            after = [*levels, size] if at is None else [x + size * (i == at) for i, x in enumerate(levels)]
            gaps = [capacity - x for x in after if x < capacity]
            cost = sum(gaps.count(g) ** 2 for g in set(gaps))
            if best is None or (cost, -level) < best[:2]:
                best = (cost, -level, after, level)
        levels = best[2]
        out.append((best[3], best[0]))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_sum_of_squares_as_brute_force(sizes):
    sequence, offset = packing.sum_of_squares(np.array(sizes, np.int64), 12)
    assert offset.tolist() == [level for level, _ in brute_sum_of_squares(sizes, 12)]
    check_packing(sequence, offset, sizes, 12)


def check_packing(sequence, offset, sizes, capacity):
    for s in set(np.asarray(sequence).tolist()):
        parts = sorted((o, n) for q, o, n in zip(sequence, offset, sizes) if q == s)
        at = 0
        for o, n in parts:
            assert o == at
            at += n
        assert at <= capacity


@pytest.fixture
def pairs(prose):
    drawn = np.random.default_rng(5)
    out = [(i, prose(int(n), i)) for i, n in enumerate(drawn.integers(1, 60, 300))]
    return out + [(900, None), (901, ""), (902, prose(2000, 7)), (903, "twice"), (903, "twice"), (None, "no id <|endoftext|>"), (904, "Éİ x")]


def test_pieces_and_places(docs_of, pairs):
    rows = packing.pack_documents(docs_of(pairs), capacity=128, shard_pieces=100).collect()
    wanted = []
    for i, t in pairs:
        ids = np.array([*plain_ids(t), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            wanted.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(wanted, key=repr)
    check_packing([r.sequence_id for r in rows], [r.offset for r in rows], [r.length for r in rows], 128)


def test_few_sequences(docs_of, pairs):
    rows = packing.pack_documents(docs_of(pairs * 4), capacity=256).collect()
    least = -(-sum(r.length for r in rows) // 256)
    assert len({r.sequence_id for r in rows}) <= least * 1.03 + 1


def test_sequences_round_trip(docs_of, pairs):
    found = {}
    for r in packing.sequences(docs_of(pairs), capacity=4096).collect():
        assert len(r.ids) == r.length <= 4096
        ends = [-1, *[i for i, x in enumerate(r.ids) if x == 0]]
        for a, b, doc in zip(ends, ends[1:], r.doc_ids):
            found.setdefault(doc, []).append(r.ids[a + 1 : b])
    for i, t in pairs:
        if i not in (902, 903):
            assert found[i] == [plain_ids(t)]


def test_empty(no_docs):
    assert packing.pack_documents(no_docs).count() == 0
