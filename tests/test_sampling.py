"""Split, folds and weights: exact counts and partition independence."""

import math

from pyspark.sql import functions as F

from gradus.operators import sampling as SA


def _frame(spark, parts):
    rows = [(i, 0 if i % 10 else (1 if i % 20 else 2)) for i in range(1, 4001)]
    return spark.createDataFrame(rows, "incident_id long, label int").repartition(parts)


def test_split_counts_are_exact_and_partition_independent(spark):
    results = []
    for parts in (1, 8):
        out = SA.split_stratified(_frame(spark, parts), "label", 0.2, 42, "incident_id")
        results.append(sorted((r["incident_id"], r["is_test"]) for r in out.collect()))
        counts = {r["label"]: r["n"] for r in out.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
        assert sum(counts.values()) == math.ceil(0.2 * 4000)
        assert counts == {0: 720, 1: 40, 2: 40}
    assert results[0] == results[1]


def test_approximate_mode_sums_exactly():
    alloc = SA.approximate_mode({0: 13527, 1: 873, 2: 458, 3: 142}, 12000)
    assert sum(alloc.values()) == 12000
    assert all(abs(alloc[c] - n * 12000 / 15000) < 1 for c, n in {0: 13527, 1: 873, 2: 458, 3: 142}.items())


def test_kfold_sizes(spark):
    out = SA.kfold(_frame(spark, 3).limit(4003 - 3), 5)
    sizes = sorted(r["n"] for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sizes == [800, 800, 800, 800, 800]


def test_class_weights_balanced(spark):
    out = SA.class_weights(_frame(spark, 2), "label")
    w = {r["label"]: r["weight"] for r in out.select("label", "weight").distinct().collect()}
    assert abs(w[0] - 4000 / (3 * 3600)) < 1e-12
    assert abs(w[1] - 4000 / (3 * 200)) < 1e-12


def test_hash_folds_are_a_projection(spark):
    out = SA.kfold(_frame(spark, 3), 5, exact_sizes=False)
    sizes = [r["n"] for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and sum(sizes) == 4000 and min(sizes) > 600
