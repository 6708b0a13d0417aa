"""Structured Streaming scorer for scenario requests.

Stateless: each micro-batch is the same projection as the batch scorer
(feature projection → saved model → corrections), so no state store,
watermark or shuffle is involved and the stream scales with its sources.
``follow_versions`` asks for the current version as a batch begins, so a retrain
job that publishes meanwhile is picked up by the next batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..models.classifiers import FittedClassifier
from ..operators import features as FE
from ..operators import scoring as SC
from ..sources.models import load_model

STREAM_MODEL_TAG = "Random Forest + Domain Corrections (stream)"


def score_stream(stream: DataFrame, model: FittedClassifier, fmodel: FE.FeatureModel,
                 model_tag: str = STREAM_MODEL_TAG) -> DataFrame:
    """Streaming (or batch) scenario rows → corrected probabilities, risk, class."""
    feats = FE.scenario_features(stream, fmodel)
    pred = model.predict(feats).drop(*fmodel.feature_names, "features", "prediction")
    return SC.finalize_scores(SC.apply_corrections(pred), model_tag)


def score_stream_once(spark: SparkSession, inbox: str, model_dir: str, out: str, checkpoint: str,
                      schema=None) -> DataFrame:
    """Score every file in ``inbox`` with an available-now trigger, append to
    ``out`` (Parquet, exactly-once via the checkpoint) and return the output."""
    model, fmodel = load_model(spark, model_dir)
    schema = schema or spark.read.parquet(inbox).schema
    stream = spark.readStream.schema(schema).parquet(inbox)
    q = (score_stream(stream, model, fmodel).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


def follow_versions(stream: DataFrame, root: str, out: str, checkpoint: str, model: str = "RF",
                    model_tag: str = STREAM_MODEL_TAG, **trigger) -> StreamingQuery:
    """Scores a stream with the version of ``model`` that is current as each batch begins.

    Versions are those that ``plans.jobs`` publishes under ``root``; a version without its
    pointer is not seen.  Every row names its ``version``.  A batch is written to a folder
    of its own, which a repeated batch overwrites, so each request is scored once; a batch
    before the first publication fails and is repeated when the stream is restarted.
    Read the output with ``scored``.
    """
    from ..plans.jobs import current_version
    held: dict = {}

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        version = current_version(spark, root)
        if version is None:
            raise RuntimeError(f"no version is published under {root}")
        if version not in held:
            held.clear()
            held[version] = load_model(spark, os.path.join(root, "versions", version, "models", model))
        fitted, fmodel = held[version]
        (score_stream(rows, fitted, fmodel, model_tag).withColumn("version", F.lit(version))
         .write.mode("overwrite").parquet(os.path.join(out, f"batch={number}")))

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def scored(spark: SparkSession, out: str) -> DataFrame:
    """All batches that ``follow_versions`` wrote, with their number in ``batch``."""
    return spark.read.parquet(out)
