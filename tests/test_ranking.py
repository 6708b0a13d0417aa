"""Distributed running sums / ranks equal the window form, for any partitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.operators.ranking import cut_points, cuts, exact_percentiles, first_rows, rank_rows, running_sums
from gradus.operators.sampling import kfold, split_stratified


def _data(spark, parts):
    rows = [(i % 3, (i * 7919) % 1009, i, float(i % 13)) for i in range(3000)]
    return spark.createDataFrame(rows, "g int, h int, id int, v double").repartition(parts)


def test_running_sums_equal_a_window(spark):
    for parts in (1, 8):
        df = _data(spark, parts)
        a = running_sums(df, ["g"], ["h", "id"], ["v"], num_partitions=7)
        w = Window.partitionBy("g").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
        b = df.withColumn("cum_v", F.sum("v").over(w))
        assert sorted((r["id"], r["cum_v"]) for r in a.collect()) == sorted((r["id"], r["cum_v"]) for r in b.collect())


def test_groups_with_nulls(spark):
    df = spark.createDataFrame([(None if i % 2 else "a'b.c", i, 1) for i in range(50)], "g string, id int, v int")
    got = {r["id"]: r["cum_v"] for r in running_sums(df, ["g"], ["id"], ["v"], num_partitions=5).collect()}
    assert got == {i: i // 2 + 1 for i in range(50)}


def test_rank_without_groups_and_descending(spark):
    df = _data(spark, 4)
    r = rank_rows(df, [], [F.col("h").desc(), "id"], "rk")
    ranks = sorted(x["rk"] for x in r.collect())
    assert ranks == list(range(1, 3001))
    top = r.where("rk = 1").first()
    assert top["h"] == max(x["h"] for x in df.collect())


def test_cut_points_are_order_statistics(spark):
    for key in (F.xxhash64("id"), F.col("h").cast("long") - 500, F.col("id").cast("long")):
        df = _data(spark, 3).withColumn("k", key)
        by = {}
        for r in df.collect():
            by.setdefault(r["g"], []).append(r["k"])
        want = {g: 1 + 137 * (g + 1) for g in by}
        for g, (value, below, equal) in cut_points(df, F.col("g"), F.col("k"), want).items():
            ks = sorted(by[g])
            assert value == ks[want[g] - 1] and below == sum(x < value for x in ks) and equal == ks.count(value)


def test_first_rows_break_ties_by_key(spark):
    df = _data(spark, 3)
    cond = first_rows(df, F.col("g"), (F.col("h") % 5).cast("long"), F.col("id").cast("long"), {0: 333, 1: 1, 2: 0})
    got = {(r["g"], r["id"]) for r in df.where(cond).collect()}
    rows = sorted((r["g"], r["h"] % 5, r["id"]) for r in df.collect())
    assert got == {(g, i) for n, want in ((0, 333), (1, 1)) for g, _, i in [r for r in rows if r[0] == n][:want]}


def test_split_and_fold_plans_move_no_rows(spark):
    df = _data(spark, 2).withColumn("label", F.col("g"))
    for out in (split_stratified(df, "label", key="id"), kfold(df, 5, key="id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "Exchange hash", "Exchange range", "Sort", "MapInPandas"))


def test_grouped_percentiles_equal_sparks(spark):
    df = _data(spark, 3)
    a = exact_percentiles(df, "v", [0.25, 0.5, 0.75], ["g"], ["q1", "m", "q3"]).select("g", "q1", "m", "q3")
    b = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).select(
        "g", *[F.col("q")[i] for i in range(3)])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_many_ranks_in_one_search(spark):
    df = _data(spark, 3)
    keys = sorted(r["k"] for r in df.select(F.xxhash64("id").alias("k")).collect())
    want = [1, 2, 700, 701, 2999, 3000]
    assert {t: v for (_, t), (v, _, _) in cuts(df, F.lit(0), F.xxhash64("id"), {0: want}).items()} == {t: keys[t - 1] for t in want}


def test_folds_of_tied_keys_keep_their_sizes(spark):
    df = _data(spark, 3)
    out = kfold(df, 7, key="id", order=F.col("h") % 3)
    rows = sorted((r["h"] % 3, r["id"], r["fold"]) for r in out.collect())
    assert [f for *_, f in rows] == sorted(f for *_, f in rows)
    assert sorted(sum(f == i for *_, f in rows) for i in range(7)) == [428] * 3 + [429] * 4


def test_percentiles_of_wide_ranges(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    wide = [*(rng.standard_normal(200) * 10.0 ** rng.integers(-300, 300, 200)), 0.0, -0.0, 5e-324, -1.7e308, 1.7e308, float("nan"), None]
    df = spark.createDataFrame([("a", None if v is None else float(v)) for v in wide] + [("b", 2.0)] * 3 + [(None, float(v)) for v in range(4)]
                               + [("c", float("-inf")), ("c", 1.0), ("c", 2.0), ("c", 4.0), ("c", float("inf"))], "g string, v double")
    got = {r["g"]: (r["p25"], r["p50"], r["p90"]) for r in exact_percentiles(df, "v", [0.25, 0.5, 0.9], ["g"]).collect()}
    clean = [v for v in wide if v is not None and v == v]
    assert np.allclose(got["a"], np.quantile(clean, [0.25, 0.5, 0.9]), rtol=1e-12, atol=0)
    assert got["b"] == (2.0, 2.0, 2.0) and got[None] == (0.75, 1.5, 2.7) and got["c"][:2] == (1.0, 2.0)
    assert exact_percentiles(df.limit(0), "v", [0.5], ["g"]).collect() == []
