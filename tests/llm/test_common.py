"""State of worker processes and caches."""

from gradus.llm import common, kn_quality
from gradus.llm.piece_bpe import PieceBpe
from gradus.llm.token_files import ChunkEncoder


def test_state_goes_when_another_operator_asks():
    made = []
    make = lambda: made.append(1) or object()
    one = common.worker_state("a", 1, make, 2)
    assert common.worker_state("a", 1, make, 2) is one and len(made) == 1
    common.worker_state("a", 2, make, 2)
    common.worker_state("a", 1, make, 2)
    common.worker_state("a", 3, make, 2)  # 2 was used longest ago
    assert list(common._STATE["kept"]) == [1, 3]
    common.worker_state("b")
    assert not common._STATE["kept"] and common.worker_state("a", 1, make) is not one


def test_caches_are_bounded_by_bytes_and_leave_out_long_words():
    cache = common.WordCache(most=1000, longest=5)
    cache.put([("abc", b"12"), ("abcdef", b"1")])
    assert list(cache) == ["abc"]
    cache.put((str(i), b"x") for i in range(10))
    cache.trim()
    assert not cache and cache.held == 0


def test_words_left_out_of_the_caches_are_encoded(prose):
    import public_tokenizers

    bpe, chunks = PieceBpe(public_tokenizers.path("piece_bpe_32k.model")), ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = prose(1, 30) + " " + "ab" * 900 + "  " + prose(2, 10)
    for _ in range(2):
        assert bpe.encode_batch([text, "", text])[2].tolist() == bpe.library.encode(text)
        assert chunks.encode(text) == chunks._bytes(chunks.ids([text])[0])
    assert max(map(len, [*bpe.cache, *chunks.cache, *chunks.words])) <= 1000


def test_counting_drops_what_another_operator_left():
    common.worker_state("piece_bpe", 1, object)
    assert list(kn_quality._count(iter([]), 5)) == []
    assert not common._STATE["kept"]


def test_changing_operators_gives_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1), raising=False)
    for owner in ("c", "c", "d"):
        common.worker_state(owner, 1, object)
    assert len(done) == 2


def test_aged_cache_keeps_used_words_and_stays_bounded():
    cache = common.AgedCache(most=8_000)
    for i in range(1000):
        assert i == 0 or cache.get("used") or cache.aged("used")
        cache.put([("used", b"1")] * (i == 0) + [(f"new{i}", b"2")])
        cache.trim()
        assert len(cache) + len(cache.older) < 60
