"""Every stage on the smallest table, against brute force on its own input."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from gradus.llm import leaks
from gradus.llm.common import stored

from .test_dedup import groups, removed, shingles
from .test_leaks import brute


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(stored(f(spark, out[-1], sf_small), "test-stage"))
    return [(d.columns, {r["doc_id"]: r for r in d.collect()}) for d in out]


def test_columns(stages):
    assert all(c == stages[0][0] for c, _ in stages[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "repeated passages",
                                                     "benchmark decontamination", "token ids"]


def test_quality_keeps_clean_documents(spark, stages, sf_small):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    good = [i for i in stages[0][1] if labels.get(i) == 1]
    assert sum(i in stages[1][1] for i in good) >= 0.97 * len(good)
    assert len(stages[1][1]) < len(stages[0][1])


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1][1].items())
    sets = [shingles(r["text"], 5) for _, r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(len(rows), links)
    assert sorted(stages[2][1]) == [i for k, (i, _) in enumerate(rows) if root[k] == k or not sets[k]]


def test_passages_lose_later_copies(stages):
    rows = [(i, r["text"]) for i, r in sorted(stages[2][1].items())]
    for (i, b), gone in zip(*removed(rows, "first", 200), strict=True):
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        got = stages[3][1][i]["text"].encode()
        assert len(rest) <= len(got) <= len(rest) + 6 * b"\0\1\0".join([gone]).count(b"\0\1") + 6
        assert stages[3][1][i]["n_chars"] == len(stages[3][1][i]["text"])


def test_leaks_go(spark, stages, sf_small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    for i, r in stages[3][1].items():
        n, hit, _ = brute(r["text"], items, leaks.WINDOW)
        if hit > 0.5 * n:
            assert i not in stages[4][1]
        else:
            left = stages[4][1][i]["text"]
            assert (left == r["text"]) == (hit == 0)
            assert len(leaks.words_of(left.encode())) <= n - hit + 0 if hit else True


def test_token_ids(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert stages[5][0] == [*stages[0][0], "token_ids", "n_tokens", "lossless"]
    assert stages[5][1].keys() == stages[4][1].keys()
    for r in stages[5][1].values():
        assert r["token_ids"] == sp.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"]) and r["lossless"]


def test_stages_on_odd_documents(spark, edge_docs, no_docs, sf_small):
    n = edge_docs.count()
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, no_docs, sf_small).count() == 0
        got = f(spark, edge_docs, sf_small)
        assert got.columns[:len(edge_docs.columns)] == edge_docs.columns
        assert 0 < got.count() <= n


def test_a_task_of_token_ids_takes_one_worker_process(spark, edge_docs, sf_small):
    plan = corpus_pipeline.tokenise(spark, edge_docs, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
