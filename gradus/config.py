"""Fixed values and default configuration.

Everything here is configuration: operators take label lists, column names
and constants as arguments, and these are only the defaults for the incident
severity use case.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the analysed application's for equal results.
# ---------------------------------------------------------------------------

# Ordered severity labels, least to most severe (position = ordinal code).
SEVERITY_LABELS = ["POD", "Minor", "Moderate", "Serious"]

# Literals the cleaning rules compare against.
NIGHT_VALUE = "Night"
WET_VALUE = "Wet"
HIGHWAY_VALUE = "Highway"
DARK_SUBSTRING = "Dark"
GOOD_WEATHER_VALUES = ["Clear", "Unknown"]
AIRBAG_VALUE = "Yes"

# Defaults for unparseable incident dates.
DEFAULT_YEAR = 2023
DEFAULT_MONTH = 6

# Feature values a scenario row gets for columns a scenario does not carry.
SCENARIO_YEAR = 2024
SCENARIO_MONTH = 6
SCENARIO_OLD_VEHICLE = 0

# Scenario request defaults: speed limit, pre-crash speed, mileage.
SCENARIO_DEFAULTS = {"speedLimit": 35.0, "precrashSpeed": 10.0, "mileage": 500.0}

# Risk conditions for the Bayes table: (column, value, name).
RISK_CONDITIONS = [
    ("incident_time", "Night", "Night-time driving"),
    ("roadway_surface", "Wet", "Wet road surface"),
    ("roadway_type", "Highway", "Highway driving"),
    ("weather", "Snow/rain", "Snow/Rain weather"),
    ("lighting", "Dark/Not Lighted", "Dark/Not Lighted"),
]

# Preset scenarios: name, limit, precrash speed, mileage, night, wet,
# highway, dark, bad weather, airbag.
PRESET_SCENARIOS = [
    ("Low-risk:  Day / Dry  / 25 mph", 25, 5, 1000, 0, 0, 0, 0, 0, 0),
    ("Moderate:  Night/ Dry / 35 mph", 35, 10, 500, 1, 0, 0, 1, 0, 0),
    ("High-risk: Night/ Wet / 65 mph", 65, 50, 200, 1, 1, 1, 1, 1, 0),
    ("Worst-case:Wet / Hwy  / 65 mph", 65, 55, 100, 1, 1, 1, 1, 1, 1),
]

# Columns tested for independence from severity (chi-square).
CHI_SQUARE_COLUMNS = [
    "weather", "lighting", "roadway_type", "crash_with", "roadway_surface",
    "incident_time", "air_bag",
]

# Significance stars: (upper p bound, label), checked in order; else "ns".
SIGNIFICANCE_LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]

# Risk bands for the risk index and for Bayes cells: (upper bound, label).
RISK_INDEX_BANDS = [(0.3, "low"), (1.0, "medium")]
RISK_INDEX_TOP = "high"

# Probability-correction constants (scenario scoring).
OVERSPEED_RAMP = 3.0          # ratio 1 -> 4 ramps the factor from 0 to 1
OVERSPEED_TAKE = 0.7          # share of p0 moved at full factor
OVERSPEED_SPLIT = (0.35, 0.40, 0.25)
ZERO_LIMIT_FALLBACK = 35.0    # limit used by the corrections when limit <= 0
EXTREME_SPEED = 80.0
EXTREME_RAMP = 120.0
EXTREME_POWER = 0.7
EXTREME_TAKE_P0 = 0.85
EXTREME_TAKE_P1 = 0.5
EXTREME_SPLIT = (0.35, 0.65)
COMPOUND_MIN = 3              # hazards needed before the compound stage fires
COMPOUND_RATIO = 1.5          # speed ratio counted as a hazard above this
COMPOUND_DIVISOR = 4.0
COMPOUND_CAP = 0.6
COMPOUND_SPLIT = (0.3, 0.4, 0.3)
AIRBAG_P0_ABOVE = 0.5
AIRBAG_P0_FLOOR = 0.3
AIRBAG_SHARE = 0.5
AIRBAG_SPLIT = (0.5, 0.35, 0.15)

# Odds-ratio interpretation templates.
ODDS_UP = "↑ {:.2f}x higher severity"
ODDS_DOWN = "↓ {:.2f}x lower severity"
ODDS_NONE = "No effect"

# Model sizes of the analysed application (library defaults).
RF_TREES, RF_DEPTH = 500, 10
GBT_ROUNDS, GBT_DEPTH, GBT_STEP, GBT_SUBSAMPLE = 300, 5, 0.1, 0.8
MLP_HIDDEN = [128, 64, 32]
MLP_MAX_ITER = 500
MLP_ALPHA, MLP_VALIDATION = 0.001, 0.15
ORDINAL_MAX_ITER, ORDINAL_FTOL = 800, 1e-8
ORDINAL_PROB_FLOOR = 1e-9
LR_MAX_ITER = 1000
CV_FOLDS = 5
PERMUTATION_REPEATS = 10
SPLIT_TEST_FRACTION = 0.2
SEED = 42
SMOTE_K = 5
WILSON_Z = 1.96
HIST_BINS = 12
ROC_MAX_POINTS = 50

# ---------------------------------------------------------------------------
# Column layout of the incident table (snake-case names).
# ---------------------------------------------------------------------------

LABEL_COL = "severity"
ID_COL = "incident_id"
SPEED_LIMIT = "posted_speed_limit"
PRECRASH = "precrash_speed"
MILEAGE = "mileage"

NUMERIC_FEATURES = [SPEED_LIMIT, MILEAGE, PRECRASH, "speed_ratio", "speed_night"]
ENGINEERED_FEATURES = [
    "is_night", "is_wet", "is_highway", "is_dark", "is_bad_weather",
    "airbag_deployed", "incident_year", "incident_month", "is_old_vehicle",
]
ONE_HOT_COLUMNS = ["roadway_type", "weather", "lighting", "crash_with"]


@dataclass(frozen=True)
class TaskConfig:
    """Generic classification task: label column, ordered labels, features."""

    label_col: str = LABEL_COL
    labels: list = field(default_factory=lambda: list(SEVERITY_LABELS))
    id_col: str = ID_COL
    numeric: list = field(default_factory=lambda: list(NUMERIC_FEATURES))
    engineered: list = field(default_factory=lambda: list(ENGINEERED_FEATURES))
    one_hot: list = field(default_factory=lambda: list(ONE_HOT_COLUMNS))

    @property
    def k(self) -> int:
        return len(self.labels)


DEFAULT_TASK = TaskConfig()
