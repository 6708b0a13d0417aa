import random

import pytest

EXTRA = "id long, th long, key long, node long, part int, h long, m int, n int, ranges string, count long"


def _prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(80)]
    return " ".join(r.choice(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return _prose


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeats, shared passages."""
    a, shared = _prose(1, 120), _prose(7, 60)
    near = a.split()
    near[60] = "zzz"
    return [(1, a), (2, a), (2, a), (3, " ".join(near)), (4, a.upper()), (5, None), (6, ""), (7, " \t\n "), (8, "one two"),
            (9, "One\ttwo"), (10, _prose(2, 90) + " " + shared), (11, shared + " " + _prose(3, 90)),
            (12, "é▁日本 😀 \x00 <s> <|endoftext|>  x\x1cy"), (13, "ab" * 400), (14, _prose(4, 30_000)),
            (15, "\n".join([_prose(5, 40)] * 6)), (None, _prose(6, 50)), (None, None), (16, "a"), (17, "d" * 250)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows under columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", *[None] * 10) for i, t in edge_rows],
                                 f"doc_id long, text string, lang string, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
