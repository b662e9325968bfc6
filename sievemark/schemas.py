"""Table schemas and the fixed values that decide results."""

from pyspark.sql import types as T

# --- Fixed values: these decide results and are stated once, here. ----------

# Splits of the model partition, in pool order.
MODEL_SPLITS = ("train", "val", "test")

# Catalog splits for records outside the model partition.
EXTERNAL_SPLIT = "external"   # added from outside the data set
EXCLUDED_SPLIT = "excluded"   # removed by deduplication

# Menu order of splits; anything else sorts last.
SPLIT_MENU_ORDER = ("train", "val", "validation", "test", "excluded", "external")

# Class names and the label spellings that stand for them.
NEGATIVE_CLASS = "normal"
POSITIVE_CLASS = "pneumonia"
POSITIVE_SPELLINGS = ("1", "1.0", "pneumonia", "positive", "true")
NEGATIVE_SPELLINGS = ("0", "0.0", "normal", "negative", "false")

# File extension -> decoded format.
EXTENSION_FORMATS = {
    ".png": "PNG",
    ".jpg": "JPEG",
    ".jpeg": "JPEG",
    ".bmp": "BMP",
    ".tif": "TIFF",
    ".tiff": "TIFF",
    ".webp": "WEBP",
}

MAX_FILE_BYTES = 25 * 1024 * 1024
MAX_PIXELS = 25_000_000
PIPELINE_VERSION = "1"

DEFAULT_SEED = 42
LOW_VARIANCE_QUANTILE = 0.01
SEARCH_ITERATIONS = 8
CV_FOLDS = 3
BACKGROUND_SIZE = 100

LABEL_CONFLICT_POLICIES = ("drop", "keep_first")
MODEL_NAMES = ("logistic", "svm", "xgboost")
SCORE_TYPES = {"logistic": "probability", "svm": "margin", "xgboost": "probability"}

# Search grids, one list of values per setting.
LOGISTIC_GRID = {
    "C": [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0],
    "penalty": ["l1", "l2"],
    "class_weight": [None, "balanced"],
}
MARGIN_GRID = {
    "C": [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 25.0],
    "gamma": ["scale", 0.0005, 0.001, 0.005, 0.01],
    "class_weight": [None, "balanced"],
}
BOOSTED_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [2, 3, 4, 6],
    "learning_rate": [0.03, 0.05, 0.1, 0.2],
    "subsample": [0.7, 0.85, 1.0],
    "colsample_bytree": [0.7, 0.85, 1.0],
    "min_child_weight": [1, 3, 5],
}

# --- Fixed values as well: the columns of the tables, in order. ---------------

SAMPLES = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("split_index", T.LongType()),
    T.StructField("label", T.LongType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])

MODEL_METRICS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("logged_at", T.TimestampType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("balanced_accuracy", T.DoubleType()),
    T.StructField("sensitivity", T.DoubleType()),
    T.StructField("specificity", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("tuning_roc_auc", T.DoubleType()),
    T.StructField("training_cv_roc_auc", T.DoubleType()),
    T.StructField("validation_roc_auc", T.DoubleType()),
    T.StructField("validation_youden_j", T.DoubleType()),
])

CONTENT = T.StructType([
    T.StructField("content_id", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("format", T.StringType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("aspect_ratio", T.DoubleType()),
    T.StructField("color_mode", T.StringType()),
    T.StructField("megapixels", T.DoubleType()),
    T.StructField("exif", T.StringType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("processing_status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("predicted_class", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("positive_score", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("pipeline_version", T.StringType()),
])

SOURCES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("content_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("label", T.LongType()),
    T.StructField("source_status", T.StringType()),
    T.StructField("source_error", T.StringType()),
    T.StructField("seen_at", T.TimestampType()),
])

PROVENANCE = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("provenance_available", T.BooleanType()),
    T.StructField("model_source", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("tracking_uri", T.StringType()),
    T.StructField("experiment_name", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("model_uri", T.StringType()),
])
