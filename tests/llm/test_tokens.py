import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import ODD, frame, prose
from veilscan.llm.queries import vocabulary
from veilscan.llm.textbytes import prefix_hash, slices, span_hash, words
from veilscan.llm.tokens import BLOCK, Encoder, Plane, cut_pieces, read_documents, read_shard, write_shard, write_shards


@pytest.mark.parametrize("n,most", [(0, 5), (1, 1), (7, 3), (1000, 49408), (5000, 70000), (4096, 2)])
def test_wavelet_matrix_answers_like_the_ids(n, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), most - 1) if n % 2 else rng.integers(0, most, n)
    lengths, matrix = read_shard(write_shard(np.array([n]), ids.astype(np.uint32)))
    assert lengths.tolist() == [n] and matrix.decode().tolist() == ids.tolist()
    assert matrix.access(np.arange(n)).tolist() == ids.tolist()
    for token in [*np.unique(ids)[:20].tolist(), most, most + 1, 1 << 20, -1]:
        places = np.flatnonzero(ids == token)
        assert matrix.rank(token) == len(places)
        for before in (0, n // 3, n):
            assert matrix.rank(token, before) == (places < before).sum()
        for k in {0, len(places) // 2, len(places) - 1} & set(range(len(places))):
            assert matrix.select(token, k) == places[k]
        assert matrix.select(token, len(places)) == -1


def test_a_question_inflates_few_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 9, 9 * 8 * BLOCK + 77)
    _, matrix = read_shard(write_shard(np.array([len(ids)]), ids))
    inflated = []
    inflate = Plane._inflate
    monkeypatch.setattr(Plane, "_inflate", lambda self, b: inflated.append(b) or inflate(self, b))
    places = np.array([0, 8 * BLOCK - 1, 8 * BLOCK, len(ids) - 1])
    assert matrix.access(places[-1:]).tolist() == ids[-1:].tolist() and len(inflated) <= 9
    assert matrix.access(places).tolist() == ids[places].tolist()
    for token in (0, int(ids[8 * BLOCK]), 511):
        found = np.flatnonzero(ids == token)
        inflated.clear()
        assert matrix.rank(token, 8 * BLOCK) == (found < 8 * BLOCK).sum() and len(inflated) <= 18
        assert [matrix.select(token, k) for k in (0, len(found) // 2, len(found) - 1)] == found[[0, len(found) // 2, -1]].tolist()
        assert matrix.select(token, len(found)) == -1
    assert (matrix.decode() == ids).all()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        read_shard(b"PAR1" + bytes(40))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


def as_arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


ODD_TEXT = st.text(st.one_of(st.sampled_from(" \n\tabzAZ'sSdDtTrRvVeElLmM09.,!?<|>-_éñüßÄÊ…\x1c\x85  ǅΣİ́²⅕٠٣ªº"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_TEXT, max_size=5))
def test_ids_are_the_library_s(encoder, texts):
    ids, counts = encoder.encode(*as_arrays(texts), 2)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_ids_of_special_and_long_words(encoder, monkeypatch):
    texts = ["<|endoftext|> a", "x<|startoftext|>y", "don't I'LL they're 'still", "a" * 3000, "", "der Größe, naïve café"] * 2
    monkeypatch.setattr(Encoder, "MOST", 2)
    for _ in range(3):
        ids, _ = encoder.encode(*as_arrays(texts), 2)
        assert ids.tolist() == sum(([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts), [])


def test_documents_come_back_from_the_shards(spark, encoder):
    rows = [(i * 7 % 501, prose(i, i % 40)) for i in range(501)] + ODD
    docs = frame(spark, rows, extra=True)
    shards = write_shards(docs, vocabulary(), shard_tokens=1500)
    assert shards.count() > 3
    found = read_documents(shards, tokens=True).orderBy("start").collect()
    assert len(found) == len(rows)
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.tokens) and r.tokens[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    by_id = {i: t for i, t in rows}
    for r in found:
        if r.doc_id is not None and r.doc_id > 10:
            assert r.tokens[:-1] == encoder.tokenizer.encode(by_id[r.doc_id], add_special_tokens=False).ids


def test_tokens_of_nothing(spark):
    assert read_documents(write_shards(frame(spark, []), vocabulary())).collect() == []


def test_words_and_slices():
    texts = ["", " a  b\n", "x", "\t", "é ñ\x0bz\x1cq"]
    data, offsets = as_arrays(texts)
    starts, ends, counts = words(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["a", "b", "x", "é", "ñ", "z\x1cq"]
    assert counts.tolist() == [0, 2, 1, 0, 3]
    assert list(slices(np.array([0, 3, 3, 10, 11]), 4)) == [(0, 2), (2, 3), (3, 4)]
    prefix = prefix_hash(np.frombuffer(b"abcabc", np.uint8))
    assert span_hash(prefix, np.array([0]), np.array([3])) == span_hash(prefix, np.array([3]), np.array([6]))




def test_files_with_another_chain_go_through_the_library(encoder):
    import public_tokenizers

    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.by_piece and not other.by_piece
    texts = ["Don't  STOP\n", "", "naïve 123 日本 x" * 3]
    ids, counts = other.encode(*as_arrays(texts), 50256)
    want = [[*other.tokenizer.encode(t, add_special_tokens=False).ids, 50256] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pieces_of_quotes_and_digits():
    texts = ["'S're ,'s a''t x'l 'LLy", "'", "s12É'T"]
    low, starts, ends, left_whole, counts = cut_pieces(*as_arrays(texts))
    raw = low.tobytes()
    pieces = [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert pieces == ["'s", "'re", ",'", "s", "a", "''", "t", "x", "'", "l", "'ll", "y", "'", "s", "1", "2", "é", "'t"]
    assert counts.tolist() == [12, 1, 5] and not left_whole.any()
    whole = cut_pieces(*as_arrays(["A <|B É…'s Q"]))
    assert whole[3].tolist() == [False, True, True, False]
    assert whole[0].tobytes().decode() == "a <|B É…'s q"
