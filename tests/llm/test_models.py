"""Quality model against a plain Kneser-Ney; toxicity by held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pytest

from gradus.llm import kn_quality, toxicity


def plain_kn(texts, order):
    """log p of each byte, straight from the definition."""
    count = {order: Counter()}
    for t in texts:
        s = b"\0" * (order - 1) + t
        count[order].update(s[i:i + order] for i in range(len(t)))
    for m in range(order - 1, 0, -1):
        count[m] = Counter(g[1:] for g in count[m + 1])
    disc, ctx = {}, {}
    for m, c in count.items():
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        disc[m] = [0.0] + [min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k - 0.5))
                           for k in (1, 2, 3)]
        ctx[m] = {}
        for g, v in c.items():
            a = ctx[m].setdefault(g[:-1], [0, 0.0])
            a[0] += v
            a[1] += disc[m][min(v, 3)]

    def p(g):
        m = len(g)
        if not m:
            return 1 / 256
        total, cut = ctx[m].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        v = count[m].get(g, 0)
        return (v - disc[m][min(v, 3)]) / total + cut / total * p(g[1:])

    return lambda t: sum(math.log(p((b"\0" * (order - 1) + t)[i:i + order])) for i in range(len(t)))


@pytest.mark.parametrize("shard", [4_000_000, 300])
def test_perplexity_is_plain_kneser_ney(spark, prose, shard, monkeypatch):
    monkeypatch.setattr(kn_quality, "SHARD", shard)
    texts = {x: [prose(s, 60) + "." for s in seeds] for x, seeds in (("en", range(3)), ("fr", range(10, 14)))}
    rows = [(x, t.encode()) for x, ts in texts.items() for t in ts]
    grams = (spark.createDataFrame(rows, "lang string, text binary").repartition(3)
             .mapInArrow(lambda b: kn_quality._count(b, 4), "lang string, g long, c long")
             .groupBy("lang", "g").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c"))
    model = kn_quality.Model(kn_quality.save(kn_quality.tables(grams, 4)))
    for x, ts in texts.items():
        lp = plain_kn([t.encode() for t in ts], 4)
        new = [b"abc fg hed", b"XYZ! \xc3\xa9", b"a", ts[0].encode()]
        assert np.allclose(model.sums(x, new, 4), [lp(t) for t in new])
    assert model.sums("de", [b"a"], 4) is None


def test_quality_edges(spark, edge_docs, no_docs, prose):
    good = [(100 + i, prose(i, 200), "en") for i in range(40)]
    junk = [(200 + i, "#!@ %%% " * 50, "en") for i in range(5)] + [(300, "#!@ %%% " * 50, "xx")]
    docs = edge_docs.select("doc_id", "text", "lang").union(spark.createDataFrame(good + junk, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(None, 1), (200, 0), (201, None)], "doc_id long, quality int")
    got = {r["id"]: r for r in kn_quality.classify(docs, labels).collect()}
    assert not any(got[i]["kept"] for i in range(200, 205))
    assert all(got[i]["kept"] for i, _, _ in good)
    assert got[5]["kept"] and got[6]["kept"] and got[5]["perplexity"] is None
    assert got[300]["kept"] and got[300]["perplexity"] is None
    none = kn_quality.classify(docs, labels.limit(0))
    assert none.where("kept").count() == docs.count()
    assert kn_quality.classify(no_docs, labels).count() == 0


def test_low_quality_goes_at_the_quantile(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few held-out texts
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = kn_quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    seen = {r["perplexity"] for r in got}
    assert all(r["threshold"] in seen for r in got if r["threshold"] is not None)  # a text's own perplexity, no multiple
    low = [r["kept"] for r in got if quality.get(r["id"]) == 0 and r["threshold"] is not None]
    assert low.count(False) >= 0.87 * len(low)


def test_nnpu_gradient_is_the_risk_s():
    rng = np.random.default_rng(0)
    g, positive = rng.normal(size=12), np.arange(12) < 4
    risk, d = toxicity.nnpu_gradient(g, positive, 0.3)
    if risk >= toxicity.nnpu_gradient(g, positive, 0.3)[0]:
        for i in range(12):
            h = g.copy()
            h[i] += 1e-6
            assert abs((toxicity.nnpu_gradient(h, positive, 0.3)[0] - risk) / 1e-6 - d[i]) < 1e-4
    far = np.where(positive, 5.0, -9.0)  # the unlabelled part of the risk is negative: go upwards
    assert (toxicity.nnpu_gradient(far, positive, 0.5)[1][~positive] < 0).all()


def test_toxicity_on_held_out_texts(spark, edge_docs, no_docs, prose):
    rows = [(1000 + i, prose(i, 60) + (" scumbag " if i % 5 == 0 else " ") + prose(i + 5000, 40)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("scumbag" in t)) for i, t in rows] + [(None, 1), (99, 1), (1001, None)],
                                   "doc_id long, toxic int")
    prior, model = toxicity.fit(docs, labels, members=2)
    got = toxicity.score(docs, prior, model).toPandas()
    held = got[got.held_out]
    assert len(held) > 50
    want = held.doc_id.map(lambda i: "scumbag" in dict(rows)[i])
    assert ((held.score >= 0.3) == want).mean() >= 0.95
    edge = toxicity.score(edge_docs, prior, model).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert not any(r["held_out"] for r in edge if r["doc_id"] is None)
    prior, model = toxicity.fit(docs, labels.limit(0))
    assert model == [] and {r["score"] for r in toxicity.score(edge_docs, prior, model).collect()} == {prior}
    assert toxicity.score(no_docs, prior, model).count() == 0
