"""Thresholds, words, patterns and message formats.

They decide results, so they are stated here once, in plain text.
"""

# Cleaning
SPARSE_THRESHOLD = 0.50
IQR_MULTIPLIER = 1.5
DATE_PATTERN = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
DATE_MATCH_THRESHOLD = 0.80
DATE_FAILURE_LIMIT = 0.20
DATE_SAMPLE_SIZE = 20
# date formats in order of preference, each with the shape of the texts it can read: day alone, then with a time
_TIMES = {"H:m:s[.SSSSSSSSS]": r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]{1,9})?", "H:m": "[0-9]{1,2}:[0-9]{1,2}"}
_ZONES = {"": "", "[XXX][XX]": "(Z|[+-][0-9]{2}:?[0-9]{2})"}
DATE_FORMATS = {f"yyyy{mark}M{mark}d": f"^[0-9]{{4}}{mark}[0-9]{{1,2}}{mark}[0-9]{{1,2}}$" for mark in "-/"} | {
    f"yyyy{mark}M{mark}d{between}{time}{zone}":
        f"^[0-9]{{4}}{mark}[0-9]{{1,2}}{mark}[0-9]{{1,2}}{between[:2].strip(chr(39)) or ' '}{time_shape}{zone_shape}$"
    for zone, zone_shape in _ZONES.items() for time, time_shape in _TIMES.items() for between in (" ", "'T'") for mark in "-/"}
FILL_WORD = "Unknown"

# Profile
TOP_CATEGORIES = 5
CORRELATION_THRESHOLD = 0.30
SKEW_FLAG = 1.0

# Baseline model
TEST_SHARE = 0.20
SEED = 42
TREES = 100
TOP_FEATURES = 10
MAX_CARDINALITY = 50
MIN_ROWS = 20

# Charts
SPEC_CHART_TYPES = ("bar", "line", "scatter", "histogram", "box", "heatmap", "pie", "area")
DRAWN_CHART_TYPES = SPEC_CHART_TYPES + ("violin",)

# Report texts
CHART_TAG = "CHARTS:"
BULLET_MODES = ("content", "chart", "recommendations")
# the last one is part of each of the others
RECOMMENDATION_HEADINGS = ("Actionable Business Recommendations", "Recommendations")

# Words read as a missing value in text files (the defaults of pandas.read_csv)
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")

# Cleaning report: message formats
DUPLICATES_ISSUE = "Found {n} duplicate rows."
DUPLICATES_ACTION = "Dropped {n} exact duplicate row{s}."
SPARSE_ISSUE = "Column '{column}' has {share:.0%} missing values — will be dropped."
SPARSE_ACTION = "Dropped column '{column}' ({share:.0%} null)."
MISSING_ISSUE = "Column '{column}' has {n} missing value(s) ({share:.1%})."
MEDIAN_ACTION = "Filled {n} null(s) in numeric column '{column}' with median ({value})."
MODE_ACTION = "Filled {n} null(s) in categorical column '{column}' with mode ({value!r})."
OUTLIER_ISSUE = "Column '{column}' has {n} outlier(s) beyond IQR fence."
OUTLIER_ACTION = "Clipped {n} outlier(s) in '{column}' to fence [{lower}, {upper}]."
DATE_ACTION = "Parsed column '{column}' as datetime ({share:.0%} pattern match rate)."
SUMMARY_COUNTERS = ("rows_removed", "columns_removed", "nulls_filled", "outliers_clipped")

# Other message formats and titles
FILE_MISSING = "Dataset not found: {path!r}"
SUFFIX_UNKNOWN = "Unsupported file extension {suffix!r}. Expected one of: {expected}"
NO_FEATURES = ("Could not prepare features. Check that the dataset has usable "
               "numeric or low-cardinality categorical columns.")
TOO_FEW_ROWS = "Dataset has only {n} rows after preprocessing — too few for a reliable train/test split."
NOT_NUMERIC = ("Target column '{column}' is not numeric. "
               "Choose a numeric column for Regression or switch to Classification.")
HISTOGRAM_TITLE = "Distribution of {x}"
BAR_TITLE = "{y} by {x}"
HEATMAP_TITLE = "Numeric Correlation Heatmap"
SCATTER_TITLE = "{x} vs {y}"
BOX_TITLE = "{y} Distribution by {x}"
LINE_TITLE = "{y} Over Time ({x})"
DEFAULT_CHART_TITLE = "Chart"
DEFAULT_SLIDE_TITLE = "Slide"

# Profile as text: headings and line formats
CONTEXT_START = "=== Data Context: {name} ==="
CONTEXT_END = "=== End of Data Context ==="
SHAPE_LINE = "Shape: {rows} rows × {columns} columns"
COLUMNS_LINE = "Columns: {names}"
TYPES_HEADING = "Data Types:"
NUMERIC_HEADING = "Numeric Summary (mean | std | min | max | skew):"
NUMERIC_NONE = "Numeric Summary: none"
MISSING_HEADING = "Missing Values:"
MISSING_NONE = "Missing Values: none"
CORRELATIONS_HEADING = "Correlations (|r| > {threshold:.2f}):"
CORRELATIONS_NONE = "Correlations: no pairs with |r| > {threshold}"
CORRELATIONS_TOO_FEW = "Correlations: insufficient numeric columns"
CATEGORIES_HEADING = "Categorical Columns (top {k} values each):"
CATEGORIES_NONE = "Categorical Columns: none"
