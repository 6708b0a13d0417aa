"""Cleaning and feature projections.

Each operator is a projection (``withColumns``), so Catalyst fuses the whole
feature pipeline into one whole-stage-codegen span over the scan.  Operators
that need a statistic of the data (median, categories, mean/std) are split
into a ``fit_*`` step that runs one aggregation and returns a handful of
numbers, and a projection that uses them as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from .ranking import exact_medians


# ---------------------------------------------------------------- encoding
def encode_ordinal(df: DataFrame, col: str, labels: list[str], out: str = "label") -> DataFrame:
    """Position of ``col`` in the ordered ``labels``; unmapped or null -> null."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col))
    return df.withColumn(out, (F.nullif(pos, F.lit(0)) - 1).cast("int"))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; unparseable (and NaN) -> null."""
    return df.withColumns({c: X.to_double(c) for c in cols})


def fit_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median of every column (nulls ignored; even count averages the middle two)."""
    return exact_medians(df, cols)


def impute_median(df: DataFrame, cols: list[str], medians: dict | None = None) -> DataFrame:
    """Null -> exact column median.  Coerce first: text columns become doubles."""
    medians = medians or fit_medians(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double"))
                           for c in cols})


# ------------------------------------------------------------------- flags
def flag_equals(df: DataFrame, out: str, col: str, value) -> DataFrame:
    return df.withColumn(out, X.equals_flag(col, value))


def flag_contains(df: DataFrame, out: str, col: str, sub: str) -> DataFrame:
    return df.withColumn(out, X.contains_flag(col, sub))


def flag_not_in(df: DataFrame, out: str, col: str, values: list) -> DataFrame:
    return df.withColumn(out, X.not_in_flag(col, values))


def safe_ratio(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
    return df.withColumn(out, X.safe_ratio(a, b))


def interaction(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
    return df.withColumn(out, (F.col(a) * F.col(b)).cast("double"))


def date_parts(df: DataFrame, col: str, year_out: str = "incident_year",
               month_out: str = "incident_month", year_default: int = C.DEFAULT_YEAR,
               month_default: int = C.DEFAULT_MONTH, formats: list[str] | None = None) -> DataFrame:
    ts = X.parse_timestamp(col, formats)
    return df.withColumns({
        year_out: F.coalesce(F.year(ts), F.lit(year_default)).cast("int"),
        month_out: F.coalesce(F.month(ts), F.lit(month_default)).cast("int"),
    })


def flag_below_median(df: DataFrame, out: str, col: str, median: float | None = None) -> DataFrame:
    """1 when the (numeric) value is strictly below the column median; null -> 0."""
    if median is None:
        median = fit_medians(df, [col])[col]
    x = X.to_double(col)
    return df.withColumn(out, X.flag(x < F.lit(median).cast("double")))


# ----------------------------------------------------------------- one-hot
def fit_categories(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column (one distributed pass).

    Every level becomes a column of the result, so the levels are collected.
    """
    agg = df.agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"c{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: list(agg[f"c{i}"] or []) for i, c in enumerate(cols)}


def dummy_name(col: str, value: str) -> str:
    """Column of a level.  A dot would be read as a field path by the assembler, so it
    becomes the one-dot leader, which looks alike and keeps levels apart."""
    return f"{col}_{value}".replace(".", "\u2024")


def one_hot(df: DataFrame, cols: list[str], categories: dict | None = None,
            drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """0/1 column per level (levels sorted, first dropped); null -> all zero."""
    categories = categories or fit_categories(df, cols)
    new, names = {}, []
    for c in cols:
        levels = categories[c][1:] if drop_first else categories[c]
        for v in levels:
            nm = dummy_name(c, v)
            new[nm] = X.equals_flag(c, v)
            names.append(nm)
    return df.withColumns(new), names


# ------------------------------------------------------------ standardize
def fit_standardize(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column; zero variance -> scale 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        s = row[f"s_{i}"]
        out[c] = (row[f"m_{i}"], 1.0 if (s is None or s == 0.0) else s)
    return out


def standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: ((F.col(c) - F.lit(m)) / F.lit(s)).cast("double")
                           for c, (m, s) in params.items()})


def assemble(df: DataFrame, feature_cols: list[str], out: str = "features") -> DataFrame:
    cast = df.withColumns({c: F.col(c).cast("double") for c in feature_cols})
    return VectorAssembler(inputCols=feature_cols, outputCol=out, handleInvalid="error").transform(cast)


# ------------------------------------------------------ incident pipeline
@dataclass
class FeatureModel:
    """Fitted parameters of the incident feature pipeline (a few numbers)."""

    medians: dict
    model_year_median: float | None
    categories: dict
    scaler: dict
    feature_names: list = field(default_factory=list)
    task: C.TaskConfig = field(default_factory=lambda: C.DEFAULT_TASK)


def clean_incidents(df: DataFrame, task: C.TaskConfig = C.DEFAULT_TASK,
                    medians: dict | None = None, model_year_median=None):
    """Label encoding, numeric coercion + median imputation and all flags."""
    speed_cols = [C.SPEED_LIMIT, C.PRECRASH]
    out = encode_ordinal(df, task.label_col, task.labels, "label")
    out = coerce_numeric(out, speed_cols)
    if medians is None or model_year_median is None:
        # all three medians in one pass over the coerced values
        fitted = fit_medians(out.withColumn("_my", X.to_double("model_year")), speed_cols + ["_my"])
        medians = medians or {c: fitted[c] for c in speed_cols}
        model_year_median = fitted["_my"] if model_year_median is None else model_year_median
    out = impute_median(out, speed_cols, medians)
    out = out.withColumns({
        "is_night": X.equals_flag("incident_time", C.NIGHT_VALUE),
        "is_wet": X.equals_flag("roadway_surface", C.WET_VALUE),
        "is_highway": X.equals_flag("roadway_type", C.HIGHWAY_VALUE),
        "is_dark": X.contains_flag("lighting", C.DARK_SUBSTRING),
        "is_bad_weather": X.not_in_flag("weather", C.GOOD_WEATHER_VALUES),
        "airbag_deployed": X.equals_flag("air_bag", C.AIRBAG_VALUE),
        "speed_ratio": X.safe_ratio(C.PRECRASH, C.SPEED_LIMIT),
    })
    out = date_parts(out, "incident_date")
    out = flag_below_median(out, "is_old_vehicle", "model_year", model_year_median)
    out = out.withColumn("speed_night", (F.col(C.PRECRASH) * F.col("is_night")).cast("double"))
    return out, medians, model_year_median


def fit_features(df: DataFrame, task: C.TaskConfig = C.DEFAULT_TASK,
                 scale_on: DataFrame | None = None) -> tuple[DataFrame, FeatureModel]:
    """Fit and apply the incident feature pipeline.

    Returns the feature frame (id, label, every feature column, ``features``
    vector) and the fitted parameters.  The scaler is fitted on all rows by
    default, as the analysed application does; pass ``scale_on`` to fit it on
    a subset (e.g. the training part).
    """
    cleaned, medians, my_median = clean_incidents(df, task)
    categories = fit_categories(cleaned, task.one_hot)
    encoded, dummies = one_hot(cleaned, task.one_hot, categories)
    names = task.numeric + task.engineered + dummies
    scaler = fit_standardize(scale_on if scale_on is not None else encoded, task.numeric)
    model = FeatureModel(medians, my_median, categories, scaler, names, task)
    return transform_features(encoded, model, already_encoded=True), model


def transform_features(df: DataFrame, model: FeatureModel, already_encoded: bool = False) -> DataFrame:
    task = model.task
    out = df
    if not already_encoded:
        out, _, _ = clean_incidents(df, task, model.medians, model.model_year_median)
        out, _ = one_hot(out, task.one_hot, model.categories)
    out = standardize(out, model.scaler)
    out = out.select(task.id_col, "label",
                     *[F.col(c).cast("double").alias(c) for c in model.feature_names])
    return assemble(out, model.feature_names)


# ----------------------------------------------------------------- scenarios
def scenario_encode(df: DataFrame) -> DataFrame:
    """Scenario form fields -> request columns.

    A number that fails to parse, or is 0, takes the default (35 / 10 / 500);
    highway is an equality test, dark a prefix test, bad weather anything but
    'clear' (a missing choice counts as bad weather).
    """
    d = C.SCENARIO_DEFAULTS

    def num(c, default):
        return F.coalesce(F.nullif(X.to_double(c), F.lit(0.0)), F.lit(float(default)))

    form = {"speed_limit_text", "precrash_text", "mileage_text", "night_checked", "wet_checked",
            "roadway_choice", "lighting_choice", "weather_choice", "airbag_checked"}
    return df.select(
        *[c for c in df.columns if c not in form],
        num("speed_limit_text", d["speedLimit"]).alias("speedLimit"),
        num("precrash_text", d["precrashSpeed"]).alias("precrashSpeed"),
        num("mileage_text", d["mileage"]).alias("mileage"),
        X.flag(F.col("night_checked")).alias("isNight"),
        X.flag(F.col("wet_checked")).alias("isWet"),
        X.equals_flag("roadway_choice", "highway").alias("isHighway"),
        X.flag(F.startswith(F.col("lighting_choice"), F.lit("dark"))).alias("isDark"),
        (F.lit(1) - X.equals_flag("weather_choice", "clear")).cast("int").alias("isBadWeather"),
        X.flag(F.col("airbag_checked")).alias("airbag"),
    )


def validate_flags(df: DataFrame, cols=("isNight", "isWet", "isHighway", "isDark",
                                         "isBadWeather", "airbag")) -> DataFrame:
    """Fail any row whose flag is not 0/1 (raises at execution time)."""
    return df.withColumns({c: F.when(F.col(c).isin(0, 1), F.col(c))
                           .otherwise(F.raise_error(F.lit(f"{c} must be 0 or 1")))
                           for c in cols})


def scenario_features(df: DataFrame, model: FeatureModel, assemble_vector: bool = True) -> DataFrame:
    """Scenario request rows -> model feature rows.

    Ratio uses the scoring rule (limit > 0, else 0), the five numeric columns
    are scaled with the stored parameters, year/month/old-vehicle are fixed
    and every dummy is 0 (the highway flag is set, the roadway dummy is not).
    """
    limit, pre, mil = F.col("speedLimit"), F.col("precrashSpeed"), F.col("mileage")
    raw = {
        C.SPEED_LIMIT: limit, C.MILEAGE: mil, C.PRECRASH: pre,
        "speed_ratio": X.positive_ratio(pre, limit),
        "speed_night": pre * F.col("isNight"),
    }
    values = {}
    for c in model.task.numeric:
        m, s = model.scaler[c]
        values[c] = ((raw[c] - F.lit(m)) / F.lit(s)).cast("double")
    fixed = {
        "is_night": F.col("isNight"), "is_wet": F.col("isWet"), "is_highway": F.col("isHighway"),
        "is_dark": F.col("isDark"), "is_bad_weather": F.col("isBadWeather"),
        "airbag_deployed": F.col("airbag"), "incident_year": F.lit(C.SCENARIO_YEAR),
        "incident_month": F.lit(C.SCENARIO_MONTH), "is_old_vehicle": F.lit(C.SCENARIO_OLD_VEHICLE),
    }
    cols = []
    for name in model.feature_names:
        if name in values:
            e = values[name]
        elif name in fixed:
            e = fixed[name]
        else:
            e = F.lit(0.0)
        cols.append(e.cast("double").alias(name))
    keep = [c for c in df.columns if c not in set(model.feature_names)]
    out = df.select(*keep, *cols)
    return assemble(out, model.feature_names) if assemble_vector else out
