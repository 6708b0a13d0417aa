"""Token files and SentencePiece against the libraries, on whole and odd texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gradus.llm import piece_bpe, token_files

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def words():
    return token_files.ChunkEncoder(WORD)


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.PieceBpe(PIECE)


def test_chunks_encode_like_the_library(words, edge_rows):
    odd = ["", "á éx ́", "İstanbul ΣΑΣ", "x<|endoftext|>y  <|startoftext|>", " a\u0085b c", "'S 's I'LL", "日本 ١٢ ½ ²", "ß ẞ ﬁ"]
    for t in [*odd, *(t[:5000] for _, t in edge_rows if t)]:
        assert words.encode(t) == words._bytes(words.ids([t])[0]), t[:50]


def test_words_in_use_outlive_a_full_cache(monkeypatch):
    enc = token_files.ChunkEncoder(WORD)
    enc.cache.most = enc.words.most = 5_000
    made, plain = [], enc._plain
    monkeypatch.setattr(enc, "_plain", lambda c: made.append(c) or plain(c))
    for i in range(300):
        text = "again Ünder " + " ".join(f"w{i}x{k}" for k in range(10))
        assert enc.encode(text) == enc._bytes(enc.ids([text])[0])
    assert made.count("again") == made.count("Ünder") == 1 and made.count("w7x7") == 1


def test_agenda_and_decoding_like_the_library(pieces, edge_rows):
    r = random.Random(1)
    odd = ["".join(r.choice("ab  ▁é日\n\t\x00😀<s>x.12 ") for _ in range(r.randint(0, 12))) for _ in range(500)]
    texts = odd + [t[:5000] for _, t in edge_rows if t]
    for t, ids in zip(texts, pieces.encode_batch(texts), strict=True):
        assert pieces.library.encode(t) == ids.tolist()
        assert pieces.library.decode(ids.tolist()) == pieces.decode(ids.tolist())
    for _ in range(500):
        ids = [r.choice([r.randint(0, 258), r.randint(0, 31999)]) for _ in range(r.randint(1, 8))]
        assert pieces.library.decode(ids) == pieces.decode(ids), ids


@pytest.mark.parametrize("block", [8_192, 3])
def test_words_of_a_block_merge_like_single_agendas(pieces, block, monkeypatch):
    monkeypatch.setattr(piece_bpe, "BLOCK_WORDS", block)
    r = random.Random(2)
    words = ["▁" + "".join(r.choice("abcdeinrst▁é日😀\x00ẞ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for made in (pieces.made, np.where(np.arange(len(pieces.made)) % 50 == 0, -1, pieces.made)):  # some pairs as if tied
        monkeypatch.setattr(pieces, "made", made)
        ids, n = pieces.encode_words(words)
        assert np.split(ids, np.cumsum(n)[:-1])[7].tolist() == pieces.agenda(words[7])
        assert ids.tolist() == [i for w in words for i in pieces.agenda(w)]


def test_token_files_round_trip(spark, edge_docs, no_docs, edge_rows, words):
    folder, index = token_files.write(edge_docs, WORD, 2, 4)
    got = sorted(map(tuple, token_files.documents(spark, folder, 4).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in edge_rows), key=lambda i: (i is not None, i or 0))
    assert index.count() > 1
    start = 0
    want = {}
    for i, t in edge_rows:
        ids = words.ids([t or ""])[0] + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for i, at, n, crc in got:
        assert at == start and (n, crc) in want[i]
        start += n
    folder, _ = token_files.write(no_docs, WORD, 2, 3)
    assert token_files.documents(spark, folder, 3).count() == 0


def test_piece_digests_and_columns(spark, edge_docs, no_docs, edge_rows, pieces):
    got = sorted(map(tuple, piece_bpe.round_trip(edge_docs, PIECE).collect()), key=str)
    want = []
    for i, t in edge_rows:
        ids = pieces.library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    both = piece_bpe.decode(piece_bpe.encode(edge_docs, PIECE), PIECE)
    assert both.columns == [*edge_docs.columns, "token_ids", "n_tokens", "decoded"]
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in both.collect())
    assert piece_bpe.round_trip(no_docs, PIECE).count() == 0


def test_encoding_and_decoding_take_one_worker(edge_docs, no_docs):
    model = PIECE
    both = piece_bpe.encode_and_decode(edge_docs, model)
    apart = piece_bpe.decode(piece_bpe.encode(edge_docs, model), model)
    assert both.schema == apart.schema
    assert sorted(both.collect(), key=str) == sorted(apart.collect(), key=str)
    assert piece_bpe.encode_and_decode(no_docs, model).count() == 0
