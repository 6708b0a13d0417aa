"""The automaton against plain window search."""

import hashlib
import random

import pytest

from gradus.llm import leaks


def brute(text, items, window):
    w = leaks.words_of((text or "").encode())
    hit, found = set(), set()
    for name, t in items:
        words = leaks.words_of((t or "").encode())
        k = min(window, len(words))
        grams = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(name or "")
    return len(w), len(hit), sorted(found)


def test_random_words_against_windows():
    r = random.Random(2)
    draw = lambda n: " ".join(r.choice("abc") for _ in range(n))
    for _ in range(60):
        items = [(f"i{k}", draw(r.choice([0, 1, 2, 3, 6, 9]))) for k in range(r.randint(0, 5))]
        auto = leaks.Automaton([(n, leaks.words_of(t.encode())) for n, t in items if t], 4)
        for _ in range(10):
            text = draw(r.randint(0, 25))
            spans, found = auto.scan(leaks.words_of(text.encode()))
            n, hit, names = brute(text, items, 4)
            assert len({p for a, b in spans for p in range(a, b)}) == hit
            assert sorted(auto.names[i] for i in found) == names


@pytest.mark.parametrize("shard", [100_000, 20])
def test_documents(spark, edge_docs, no_docs, edge_rows, prose, shard, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    items = [("a", prose(7, 60)), ("b", "One TWO"), ("c", None), (None, prose(1, 30)), ("d", ""), ("b", "One TWO")]
    bench = spark.createDataFrame([(n, t, 1) for n, t in items], "item_id string, text string, id int")
    got = {}
    for r in leaks.judge(edge_docs, bench).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, t in edge_rows:
        n, hit, names = brute(t, items, 10)
        assert (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0) in got[i]
    assert leaks.judge(no_docs, bench).count() == 0
    assert leaks.judge(edge_docs, bench.limit(0)).where("contaminated").count() == 0


def test_clean_cuts_spans_and_drops_mostly_leaked(spark, edge_docs, prose):
    bench = spark.createDataFrame([("a", prose(7, 60))], "item_id string, text string")
    got = {r["doc_id"]: r["text"] for r in leaks.clean(edge_docs, bench, max_coverage=0.5).collect() if r["doc_id"]}
    assert got[10] == prose(2, 90) + " " and got[11] == " " + prose(3, 90)
    bare = leaks.clean(edge_docs, bench, max_coverage=0.1)
    assert {10, 11}.isdisjoint(r["doc_id"] for r in bare.collect())
    assert got[1] == prose(1, 120) and bare.columns == edge_docs.columns


def test_each_shard_is_built_once_a_task(spark, prose, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(leaks, "SHARD_WORDS", 160)
    items = [(f"i{k}", prose(100 + k, 40)) for k in range(8)] + [("long", prose(7, 300))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    path, shards = leaks._shards(bench, "item_id", "text", 10)
    assert shards >= 3 and max(len(w) for s in range(shards) for _, w in leaks._items(path, s)) <= 20
    built = []
    monkeypatch.setattr(leaks, "Automaton", lambda *a, real=leaks.Automaton: built.append(1) or real(*a))
    texts = [prose(i, 50) + " " + items[i % 9][1] for i in range(1300)]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(s, s + 650)), "text": [t.encode() for t in texts[s:s + 650]]}) for s in (0, 650)]
    got = [r for b in leaks._judge(iter(batches), path, shards, 10) for r in b.to_pylist()]
    assert len(built) == shards and len(got) == 1300
    for r in got[::97]:
        n, hit, names = brute(texts[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
