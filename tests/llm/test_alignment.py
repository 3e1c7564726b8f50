import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslens.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """The letter that stands for each byte in byte-level vocabularies."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


LETTERS = byte_letters()
SPELLED = {i: bytes(LETTERS[c] for c in t) for t, i in A.get_vocab(with_added_tokens=False).items() if all(c in LETTERS for c in t)}


def tokens_a(text):
    ids = A.encode(" " + text, add_special_tokens=False).ids
    return ids, [SPELLED[i] for i in ids]


def tokens_b(text):
    ids = B.encode(text)
    names = [B.id_to_piece(i) for i in ids]
    return ids, [bytes([int(n[3:5], 16)]) if B.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids, names)]


def ends(parts):
    at, out = 0, []
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def brute_groups(text):
    """Groups ([ids of A], [ids of B]) of a text, token by token."""
    if not text:
        return []
    (ids_a, parts_a), (ids_b, parts_b) = tokens_a(text), tokens_b(text)
    spaced = (" " + text).encode()
    if b"".join(parts_a) != spaced or b"".join(parts_b) != spaced:
        return []
    cuts = sorted(set(ends(parts_a)) & set(ends(parts_b)))
    out, low = [], 0
    for cut in cuts:
        out.append((
            [i for i, e in zip(ids_a, ends(parts_a)) if low < e <= cut], [i for i, e in zip(ids_b, ends(parts_b)) if low < e <= cut],
        ))
        low = cut
    return out


def brute(pairs):
    groups = [(i, brute_groups(t)) for i, t in pairs]
    links = [Counter((a, b) for g in own for a in g[0] for b in g[1]) for _, own in groups]
    held = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (i, own), found in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((
            i, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), sum(found.values()),
            sum(n for p, n in found.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in found.items()),
            hashlib.sha256(text.encode()).hexdigest() if own else "",
        ))
    return sorted(out, key=repr)


@pytest.fixture
def pairs(prose):
    out = [(i, prose(20 + 7 * i, i)) for i in range(12)]
    out += [(20, None), (21, ""), (22, " "), (23, "\n\n  x \t y  "), (24, "a▁b"), (25, "<|endoftext|> <s> </s> <0x41> <unk>"), (26, "日本語 текст 🙂🙃 é é")]
    return out + [(27, "x" * 5000 + " " + "=-" * 3000), (28, "a\0b\x1c \x85 c d\r\n e"), (None, "no id"), (3, out[3][1]), (3, out[3][1]), (29, prose(4000, 99) + "  ")]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block_bytes, pair_rows", [(1 << 20, 1 << 21), (2000, 40)])
def test_as_brute_force(docs_of, pairs, monkeypatch, block_bytes, pair_rows):
    monkeypatch.setattr(alignment, "PAIR_ROWS", pair_rows)
    rows = alignment.document_links(docs_of(pairs), block_bytes=block_bytes).collect()
    assert rows[0].__fields__ == COLUMNS
    assert sorted((tuple(r) for r in rows), key=repr) == brute(pairs)


def test_groups_and_counts(docs_of, pairs):
    rows = alignment.groups(docs_of(pairs)).orderBy("doc_id", "place").collect()
    wanted = dict(p for p in pairs if p[0] != 3)
    for i in wanted:
        own = [r for r in rows if r.doc_id == i]
        assert [(r.a, r.b) for r in own] == brute_groups(wanted[i])
        assert [r.place for r in own] == list(range(len(own))) and all(x.end == y.start for x, y in zip(own, own[1:]))
        if own:
            assert (own[0].start, own[-1].end) == (0, len((" " + wanted[i]).encode()))
    held = Counter(p for _, t in pairs for p in {(a, b) for g in brute_groups(t) for a in g[0] for b in g[1]})
    counted = alignment.pair_counts(alignment.blocks(docs_of(pairs), block_bytes=500)).collect()
    assert {(r.a, r.b): r.n_docs for r in counted} == dict(held)
    assert all(r.best == (r.n_docs == max(n for (a, _), n in held.items() if a == r.a)) for r in counted)


def test_empty_table(no_docs):
    assert alignment.document_links(no_docs).count() == 0
    assert alignment.groups(no_docs).count() == 0


def ids_of(side, texts):
    return alignment.Segments.of(texts).ids(alignment.side(side)).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab. \n\t\x1c\x85 é▁'s1", max_size=30)), max_size=4))
def test_same_ids_as_the_tokenizers(texts):
    texts = [t for t in texts if t]
    assert ids_of(alignment.SIDE_A, texts) == [tokens_a(t)[0] for t in texts]
    assert ids_of(alignment.SIDE_B, texts) == [B.encode(t) for t in texts]


def test_every_character():
    """The rank file splits and merges as the tokenizer does, at every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 60_000):
        texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}" for c in points[at : at + 60_000]]
        wanted = [e.ids for e in A.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        assert alignment.side(alignment.SIDE_A).encode("x") == tokens_a("x")[0]
        assert [alignment.side(alignment.SIDE_A).encode(t) for t in texts] == wanted


def test_blocks_are_bounded():
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": ["x" * 40] * 9 + ["y" * 1000]})] * 3
    cut = list(alignment._cut(iter(batches), 100))
    assert sum(t.num_rows for t in cut) == 30
    assert all(sum(map(len, t["text"].to_pylist())) <= 100 or t.num_rows == 1 for t in cut)
