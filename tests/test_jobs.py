"""Report sink and version pointers."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gradus.plans.jobs import current_version
from gradus.sources.reports import read_report, write_reports


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    index = write_reports(spark, {"t": df}, str(tmp_path / "r"))
    assert index.first()["rows"] == 2
    assert sorted(r["v"] for r in read_report(spark, str(tmp_path / "r"), "t").collect()) == [1, 2]


def test_current_version_is_latest_pointer(spark, tmp_path):
    root = str(tmp_path)
    assert current_version(spark, root) is None
    for v in ("20260101T000000-aaaa", "20260102T000000-bbbb"):
        spark.createDataFrame([(v, "x")], "version string, path string").write.json(f"{root}/pointers/{v}")
    assert current_version(spark, root) == "20260102T000000-bbbb"


def test_rows_that_cannot_be_trained_on(spark, sf_small):
    from gradus.plans import training as TR
    from gradus.plans.fixtures import incidents
    inc = incidents(spark, sf_small).withColumn("severity", F.when(F.col("incident_id") % 50 == 0, "odd").otherwise(F.col("severity")))
    with pytest.raises(ValueError, match="severity"):
        TR.prepare(spark, inc)
    prep = TR.prepare(spark, inc, on_missing="drop")
    assert prep.split.count() <= inc.where("severity <> 'odd'").count()


def test_current_version_reports_other_errors(spark, tmp_path):
    (tmp_path / "pointers" / "v").mkdir(parents=True)
    (tmp_path / "pointers" / "v" / "part.json").write_text('{"other": 1}')
    with pytest.raises(AnalysisException):
        current_version(spark, str(tmp_path))


def test_kernel_machine_is_fitted_at_full_size(monkeypatch):
    from types import SimpleNamespace
    from gradus.plans import QUERIES, training as TR
    monkeypatch.setattr(TR, "cached_training", lambda spark, sf, sizes, which: SimpleNamespace(predictions=(sizes, which)))
    assert QUERIES["fit_svm_rbf"](None, "") == (TR.FULL, ("SVM",))
    assert (TR.FULL.svm_components, TR.FULL.svm_iter) == (300, 100)


def test_retrain_job_fits_at_full_size(monkeypatch):
    from gradus.plans import QUERIES, jobs, q_models, training as TR
    monkeypatch.setattr(q_models, "scratch_path", lambda spark, name: name)
    monkeypatch.setattr(q_models, "incidents", lambda spark, sf: sf)
    monkeypatch.setattr(jobs, "retrain", lambda spark, inc, root, sizes, on_missing: sizes)
    assert QUERIES["job_retrain"](None, "") == TR.FULL
