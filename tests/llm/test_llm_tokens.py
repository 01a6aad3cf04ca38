"""Operators 3, 6 and 7 against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import ODD_TEXTS, rows_of

from sweepledger.llm.byte_pairs import BytePairs
from sweepledger.llm.catalog import BYTE_PAIRS, PIECES
from sweepledger.llm.checksums import crc32c_many, masked
from sweepledger.llm.length_histogram import at_limits, context_answers, encoded_lengths, length_histogram, quantile_length
from sweepledger.llm.piece_rounds import Pieces, encode_pieces, piece_digest
from sweepledger.llm.record_files import frame, record_digest, token_records, unframe


def random_texts():
    rng = random.Random(5)
    for alphabet in ("ab ", "ab 's", "the in▁ \n\n.,!", "éèa \n.,!|'²…", "漢字かな a 1", "<>0x41s/ \t\r\x0b\x1d "):
        yield from ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 250))) for _ in range(120))
    yield from ("ab" * 50_000, " " * 50_000, "".join(rng.choice("abcdefghij/+") for _ in range(20_000)))
    yield "<|endoftext|> x"


def texts_of(documents):
    return [t or "" for t in ODD_TEXTS] + list(random_texts()) + [r["text"] for r in documents.collect()]


def test_piece_ids_equal_the_library(documents):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), Pieces(PIECES)
    texts = texts_of(documents)
    for text, (ids, decoded) in zip(texts, own.encode(texts)):
        want = library.encode(text) if text else []
        assert np.frombuffer(ids, np.int32).tolist() == want, text[:80]
        assert decoded.decode() == library.decode(want)


def test_piece_digest(spark, odd_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    encoded = encode_pieces(odd_docs, PIECES)
    assert encoded.columns == [c for c in odd_docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    assert rows_of(piece_digest(encoded)) == sorted(want, key=str)
    assert piece_digest(encode_pieces(odd_docs.limit(0), PIECES)).count() == 0


def test_ids_from_elsewhere_decode_as_by_the_library(spark):
    import sentencepiece

    from sweepledger.llm.piece_rounds import decode_pieces

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng, size = random.Random(6), library.get_piece_size()
    byte = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    lists = [[rng.randrange(size) for _ in range(rng.randrange(30))] for _ in range(300)] + [[i] for i in range(0, size, 37)]
    lists += [[byte[b] for b in data] for data in ("é😀".encode(), b"\xf0\x9f", b"\x98\x80a", b"\xe2\x82", b"a\xff")]
    lists += [[], [0], [1], [2], [1, *library.encode("a b")], [*library.encode("x"), 2]]
    docs = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in decode_pieces(docs, PIECES).collect()}
    assert got == {i: library.decode(ids) for i, ids in enumerate(lists)} | {-1: None}
    with pytest.raises(Exception, match="not of the model"):
        decode_pieces(spark.createDataFrame([(1, [size])], "doc_id long, ids array<int>"), PIECES).collect()


def test_a_model_with_a_normaliser_is_refused():
    with pytest.raises(Exception):
        Pieces(public_tokenizers.path("byte_bpe_50k.json"))


def test_byte_pairs_equal_the_library(documents):
    own = BytePairs(BYTE_PAIRS)
    texts = texts_of(documents)
    for text, ids, want in zip(texts, own.encode(texts), own.library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<i4").tolist() == want.ids, text[:80]
    with pytest.raises(ValueError):
        BytePairs(public_tokenizers.path("word_bpe_49k.json"))


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c_many([b"123456789"]).tolist() == [0xE3069283]
    records = [random.Random(n).randbytes(n) for n in (0, 1, 2, 3, 4, 63, 64, 65, 127, 128, 129, 1000, 4097)]
    assert crc32c_many(records).tolist() == [slow_crc32c(r) for r in records]
    assert masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def test_damaged_records_are_found():
    framed = frame([b"abcd", b"", b"xyz" * 100])
    assert unframe(framed) == [b"abcd", b"", b"xyz" * 100]
    for at in (0, 9, 13, len(framed[2]) - 1):
        broken = bytearray(framed[2])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            unframe([framed[0], bytes(broken)])


@pytest.mark.parametrize("which", ["odd", "tables"])
def test_records_read_back(documents, odd_docs, which):
    docs = odd_docs if which == "odd" else documents
    own = BytePairs(BYTE_PAIRS)
    got = record_digest(token_records(docs, BYTE_PAIRS)).orderBy("start").collect()
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        tokens = own.library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        ids.setdefault(r["doc_id"], []).append((len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    before = 0
    for r in got:
        assert r["start"] == before
        ids[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        before += r["n_tokens"]
    assert not any(ids.values())
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_records_of_an_empty_table(documents):
    assert record_digest(token_records(documents.limit(0), BYTE_PAIRS)).count() == 0


def test_context_answers(spark, documents, odd_docs):
    for docs in (documents, odd_docs):
        own = BytePairs(BYTE_PAIRS)
        lengths = [len(own.library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.select("text").collect()]
        histogram = length_histogram(encoded_lengths(docs, BYTE_PAIRS))
        rows = {r["length"]: r for r in context_answers(histogram).collect()}
        assert set(rows) == set(lengths)
        for n, r in rows.items():
            longer = [x for x in lengths if x >= n]
            assert (r["n_docs"], r["n_tokens"]) == (lengths.count(n), n * lengths.count(n))
            assert (r["docs_from"], r["tokens_from"]) == (len(longer), sum(longer))
            assert r["fitting_docs"] == sum(x <= n for x in lengths) and r["quantile"] == r["fitting_docs"] / len(lengths)
            assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        for r in at_limits(histogram, [0, 100, 5000]).collect():
            assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in lengths)
            assert r["fitting_docs"] == sum(x <= r["context_limit"] for x in lengths)
        middle = sorted(lengths)[-(-len(lengths) // 2) - 1]
        assert quantile_length(histogram, 0.5).first()["length"] == middle
    assert context_answers(histogram.limit(0)).count() == 0


def test_long_unbroken_texts_are_not_kept(documents):
    """Runs without spaces, such as base64 or Chinese, are encoded as the libraries do and leave nothing behind."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("AZaz09+/"), 3000)) + tail for tail in ("", " end", "\n")]
    texts += ["".join(map(chr, rng.integers(0x4E00, 0x4E40, 2000))) + "。" + "a b" for _ in range(3)]
    pairs, known = BytePairs(BYTE_PAIRS), Pieces(PIECES)
    want = [e.ids for e in pairs.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in pairs.encode(texts)] == want
    assert max(map(len, [*pairs.words, *pairs.parts])) <= 64 and pairs.words.held + pairs.parts.held < 1 << 14
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [np.frombuffer(x, np.int32).tolist() for x in known.encode_ids(texts)] == [library.encode(t) for t in texts]
    assert all(len(w) <= 64 for w in known.known)


def test_word_tables_are_emptied(documents, monkeypatch):
    texts = [r[0] for r in documents.select("text").limit(60).collect()]
    monkeypatch.setattr("sweepledger.llm.byte_pairs.HELD_BYTES", 20_000)
    pairs = BytePairs(BYTE_PAIRS)
    for i in range(0, len(texts), 10):
        some = texts[i : i + 10]
        want = [e.ids for e in pairs.library.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<i4").tolist() for x in pairs.encode(some)] == want


def test_words_met_last_stay_when_tables_are_full(monkeypatch):
    """F-op3: full tables keep what the last texts held, and rows of words, parts, long words and whole texts do not mix."""
    monkeypatch.setattr("sweepledger.llm.byte_pairs.HELD_BYTES", 20_000)
    pairs = BytePairs(BYTE_PAIRS)
    words = [f"w{i}x," for i in range(120)]
    for some in (words[:60], words[60:100], words[100:]):
        texts = [" ".join(["First", *some, "y" * 100 + str(len(some))]), "two  spaces\n\nhere ", "", " ", "<|endoftext|> " + some[0], "First"]
        want = [e.ids for e in pairs.library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<i4").tolist() for x in pairs.encode(texts)] == want
        ids, sizes = pairs.encode_flat(texts * 2)
        assert ids.tolist() == 2 * sum(want, []) and sizes.tolist() == 2 * [len(w) for w in want]
    assert set(words[100:]) <= set(pairs.words) and not set(words[:100]) & set(pairs.words)
    assert pairs.encode([]) == []


def test_histogram_is_encoded_once(spark, documents):
    """One pass over the texts: the answers come from the stored histogram."""
    plan = context_answers(length_histogram(encoded_lengths(documents, BYTE_PAIRS)))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
