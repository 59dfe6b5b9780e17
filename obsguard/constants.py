"""Fixed values that must equal the reference application's for equal results.

Fixed values (names, codes, defaults, attribute lists), stated as text in natural order:
"""

# --- fixed values: observation table naming convention ---
ID_COL = "ado_id"
TIME_COL = "timestamp"
VALUE_SUFFIX = "_value"
STATUS_SUFFIX = "_status"
STATUS_PREFIX_LEN = 8

# --- fixed values: labelled point columns ---
LABEL_COL = "label"
FEATURES_COL = "features"
PREDICTION_COL = "prediction"

# --- fixed values: status codes ---
STATUS_SUSPECT = 2
STATUS_IGNORED_BIT = 64
STATUS_SUSPECT_FROM = 128
LABEL_SUSPECT = 0.0
LABEL_NORMAL = 1.0

# --- fixed values: anomaly injection defaults ---
DEFAULT_MAGNITUDE = 2.0
DEFAULT_RATIO = 0.25
HILO_ATTRIBUTES = (
    "re_ua_high", "re_ua_low", "re_ua_open", "re_ua_close2", "re_ua_ask", "re_ua_bid", "re_ua_mid",
)
HILO_HIGH = "re_ua_high"
HILO_LOW = "re_ua_low"
SPREAD_ATTRIBUTES = ("re_ua_ask", "re_ua_bid", "re_ua_mid")

# --- fixed values: job defaults ---
DEFAULT_NULL_THRESHOLD = 0.0
DEFAULT_MAX_CATEGORIES = 32
DEFAULT_TRAIN_RATIO = 0.8
DEFAULT_CLASSIFICATION_METRIC = "accuracy"
DEFAULT_REGRESSION_METRIC = "rmse"
