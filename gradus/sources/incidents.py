"""Incident table sources.

``read_incidents`` reads a stored incident table with an explicit schema (no
inference).  ``incident_view`` derives the incident table from the
order/customer/nation tables of the test data so that its size grows with
them; ``scenario_requests`` derives scenario-request rows from incidents.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INCIDENT_SCHEMA = T.StructType([
    T.StructField("incident_id", T.LongType(), False),
    T.StructField("reported_at", T.TimestampNTZType(), True),
    T.StructField("incident_date", T.StringType(), True),
    T.StructField("incident_time", T.StringType(), True),
    T.StructField("roadway_type", T.StringType(), True),
    T.StructField("roadway_surface", T.StringType(), True),
    T.StructField("lighting", T.StringType(), True),
    T.StructField("weather", T.StringType(), True),
    T.StructField("crash_with", T.StringType(), True),
    T.StructField("air_bag", T.StringType(), True),
    T.StructField("posted_speed_limit", T.StringType(), True),
    T.StructField("precrash_speed", T.StringType(), True),
    T.StructField("mileage", T.DoubleType(), True),
    T.StructField("model_year", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
])

SCENARIO_SCHEMA = T.StructType([
    T.StructField("speedLimit", T.DoubleType(), True),
    T.StructField("precrashSpeed", T.DoubleType(), True),
    T.StructField("mileage", T.DoubleType(), True),
    T.StructField("isNight", T.IntegerType(), True),
    T.StructField("isWet", T.IntegerType(), True),
    T.StructField("isHighway", T.IntegerType(), True),
    T.StructField("isDark", T.IntegerType(), True),
    T.StructField("isBadWeather", T.IntegerType(), True),
    T.StructField("airbag", T.IntegerType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_incidents(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType = INCIDENT_SCHEMA) -> DataFrame:
    """Read a stored incident table with a fixed schema.

    CSV is read in PERMISSIVE mode: a malformed field becomes null and the
    cleaning operators decide what a null means.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return reader.format(fmt).load(path)


def _case(col: Column, mapping: list, default) -> Column:
    expr = None
    for key, value in mapping:
        cond = col == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default))


def incident_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident table derived from orders ⋈ customer ⋈ nation.

    Nulls and bad values are planted by modular rules on the keys (see
    FIXTURES.md §2).  ``orders`` ⋈ ``customer`` is a shuffle join on the
    customer key (both sides grow with the data); ``nation`` has a fixed 25
    rows and is broadcast.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    base = (o.join(c, o.o_custkey == c.c_custkey)
            .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice")
    latent = (price / F.lit(500000)
              + F.when(F.col("o_orderstatus") == "F", F.lit(0.15)).otherwise(F.lit(0.0))
              + F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0.15)).otherwise(F.lit(0.0))
              + ((key * 7919) % 1000) / F.lit(4000.0))
    return base.select(
        key.alias("incident_id"),
        F.col("o_orderdate").alias("reported_at"),
        F.when(key % 50 == 0, F.lit("not a date"))
         .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("incident_date"),
        _case(F.col("o_orderstatus"), [("F", "Night"), ("O", "Day")], "Dawn").alias("incident_time"),
        _case(F.col("c_mktsegment"), [("AUTOMOBILE", "Highway"), ("BUILDING", "Intersection"),
                                      ("FURNITURE", "Parking Lot")], "Street").alias("roadway_type"),
        F.when(key % 41 == 0, F.lit(None).cast("string"))
         .when(F.col("o_orderpriority") == "1-URGENT", F.lit("Wet"))
         .otherwise(F.lit("Dry")).alias("roadway_surface"),
        _case(F.col("n_regionkey"), [(0, "Daylight"), (1, "Dark/Lighted"), (2, "Dark/Not Lighted"),
                                     (3, "Dawn/Dusk")], None).cast("string").alias("lighting"),
        _case(cust % 5, [(0, "Clear"), (1, "Cloudy/Fog"), (2, "Snow/rain"), (3, "Unknown")],
              None).cast("string").alias("weather"),
        _case(cust % 4, [(0, "Car"), (1, "Pedestrian"), (2, "Cyclist")], "Fixed Object").alias("crash_with"),
        F.when((price > 420000) & (key % 3 != 0), F.lit("Yes"))
         .when(key % 37 == 0, F.lit("Unknown")).otherwise(F.lit("No")).alias("air_bag"),
        F.when(key % 23 == 0, F.lit("Unknown"))
         .when(key % 97 == 0, F.lit("0"))
         .otherwise((F.lit(25) + F.lit(5) * (cust % 9)).cast("string")).alias("posted_speed_limit"),
        F.when(key % 19 == 0, F.lit("Unknown"))
         .otherwise(F.floor(price / F.lit(5000)).cast("int").cast("string")).alias("precrash_speed"),
        (F.col("c_acctbal") * 10 + 10000).alias("mileage"),
        F.when(key % 31 == 0, F.lit(None).cast("string"))
         .otherwise((F.lit(2010) + cust % 14).cast("string")).alias("model_year"),
        F.when(latent >= 1.33, F.lit("Serious")).when(latent >= 1.22, F.lit("Moderate"))
         .when(latent >= 1.12, F.lit("Minor")).otherwise(F.lit("POD")).alias("severity"),
    )


def scenario_choices(incidents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Raw scenario-form rows (text fields and choices) derived from incidents."""
    return incidents.select(
        F.col("incident_id"), *[F.col(c) for c in (keep or [])],
        F.col("posted_speed_limit").alias("speed_limit_text"),
        F.col("precrash_speed").alias("precrash_text"),
        F.col("mileage").cast("string").alias("mileage_text"),
        F.coalesce(F.col("incident_time") == "Night", F.lit(False)).alias("night_checked"),
        F.coalesce(F.col("roadway_surface") == "Wet", F.lit(False)).alias("wet_checked"),
        F.lower(F.col("roadway_type")).alias("roadway_choice"),
        F.lower(F.col("lighting")).alias("lighting_choice"),
        F.lower(F.col("weather")).alias("weather_choice"),
        F.coalesce(F.col("air_bag") == "Yes", F.lit(False)).alias("airbag_checked"),
    )
