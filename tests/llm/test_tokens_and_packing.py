"""Token ids, Simple-8b files and packing: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conceptloom.llm import packing, token_files, tokens

TEXTS = ["Hello, World!! don't 3.14 É.é", "", None, "<|endoftext|> a\x0bb\x1cc", "日本語 テスト。 x", "word " * 5000, "a b c", "a b c", "ÀÉÎ### \t\n tabs\r\nx", "%%% &&&"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, tokens.END_ID], "<u4") for x in texts]


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, (1 << 64) - 1)), max_size=300), st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(ids, zeros):
    x = np.array(ids + [0] * zeros + ids, np.uint64)
    words, blocks = token_files.encode(x)
    assert np.array_equal(token_files.decode(words, blocks), x)
    assert len(words) <= 2 * len(x)


def test_blocks_decode_alone_and_files_check():
    x = np.random.default_rng(3).integers(0, 49408, 10_000).astype(np.uint64)
    words, blocks = token_files.encode(x)
    assert np.array_equal(token_files.decode_block(words, blocks, 2), x[8192:])
    payload = token_files.to_file([5], [10_000], x, 7)
    doc_ids, counts, ids, before = token_files.from_file(payload)
    assert doc_ids.tolist() == [5] and counts.tolist() == [10_000] and before == 7 and np.array_equal(ids, x)
    with pytest.raises(ValueError):
        token_files.from_file(b"\0" * len(payload))


def test_encoder_equals_the_tokenizer(corpus):
    texts = [*TEXTS, *corpus.text.head(60)]
    coder = tokens.TextEncoder(tokens.tokenizer_path())
    for size in (3, len(texts)):
        got = [x for k in range(0, len(texts), size) for x in coder.encode([(t or "").encode() for t in texts[k : k + size]])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x[:-1].tolist() for x in reference_ids(texts)]


def test_token_files(documents, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    got = token_files.token_digest(documents(TEXTS)).orderBy("doc_id").collect()
    at = 0
    for r, ids in zip(got, reference_ids(TEXTS), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_digest(documents([]).limit(0)).isEmpty()


def test_packing(documents):
    texts = [*TEXTS, *["same length here"] * 400]
    got = packing.pack_documents(documents(texts), with_ids=True).collect()
    expected = reference_ids(texts)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, ids in enumerate(expected):
        parts = sorted(by_doc[k], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == ids.tobytes()
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids) for r in parts)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        assert sum(r.length for r in rows) <= packing.SEQUENCE
    total = sum(map(len, expected))
    assert sorted(by_sequence) == list(range(len(by_sequence))) and len(by_sequence) <= -(-total // packing.SEQUENCE) + 1


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
@settings(max_examples=100, deadline=None)
def test_histogram_packing_places_every_piece_once(counts):
    slots = packing.pack_histogram(counts, 64)
    used = {}
    for length, n in counts.items():
        sequence, offset = slots.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            for k in range(o, o + length):
                assert (s, k) not in used and k < 64
                used[s, k] = True
    assert len({s for s, _ in used}) == slots.sequences


def test_hot_length_is_packed_densely():
    slots = packing.pack_histogram({100: 1_000_000, 3: 7}, 2048)
    assert slots.sequences == 50_000


def test_words_that_differ_by_case_or_marks_are_encoded_once():
    coder = tokens.TextEncoder(tokens.tokenizer_path())
    odd = ["The the THE the. The...", "don't 're 'S A's <|endoftext|> <|ENDOFTEXT|> x<|endoftext|>y", "\u0130I h\u0331 H\u0331 \u212a \xc9...\xc0\xc9,", "\x1c a\x1cb \x85 ~ ^^ a_b 12.5", "", " .,!? "]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode([x.encode() for x in odd])] == [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]
    coder = tokens.TextEncoder(tokens.tokenizer_path())
    coder.encode([odd[0].encode()])
    assert len(coder.words) == 3 and set(coder.parts) == {b"", b"the", b".", b"..."}


def test_accented_words_are_encoded_together():
    """Each by itself takes the tokenizer twice as long."""
    from conceptloom.llm import tokens

    words = [f"é{a}{b}ñà{'.' * (k % 2)}" for k, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqrst")]
    coder, asked = tokens.TextEncoder(tokens.tokenizer_path()), []

    class Told:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    whole = coder.tokenizer
    coder.tokenizer = Told(whole)
    text = " ".join([*words, "plain", "Straße!", "<unk>", "a1É", "日本"])
    assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(asked) < 10


def test_a_worker_gives_its_encoder_back_before_it_does_anything_else(spark):
    """Kept on, its words fill an executor that goes on to near duplicates."""
    import gc

    import pyarrow as pa

    from conceptloom.llm.common import lean
    from conceptloom.llm.tokens import encoder, TextEncoder, tokenizer_path

    path = tokenizer_path()

    def encoded(batches):
        for batch in batches:
            coder = encoder(path)
            coder.encode([b"some words"])
            yield pa.RecordBatch.from_arrays([pa.array([len(coder.words)] * batch.num_rows, pa.int64())], names=["n"])

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, TextEncoder) for x in gc.get_objects())] * batch.num_rows, pa.int64())], names=["n"])

    rows = spark.range(8).repartition(2)
    told = lambda task, keeps: {r["n"] for r in rows.mapInArrow(lean(task, keeps), "n long").collect()}
    assert min(told(encoded, True)) >= 2  # a worker of earlier tests has more words
    assert 1 in told(held, True)
    assert told(held, False) == {0}
