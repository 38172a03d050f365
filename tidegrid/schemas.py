"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T

from tidegrid import constants as C


def text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TELEMETRY = T.StructType([T.StructField(n, T.DoubleType()) for n in C.TELEMETRY_HEADER])
FEATURE_INDEX = "sample_id string, path string, status string, sha256 string, feature_version string, T bigint, D bigint"
LABEL_SCHEME = "label_scheme string, class_names array<string>, task_to_class map<string,int>"
SUBJECT_SPLITS = "splits map<string,string>"
BUNDLE = (
    "feature_path string, length bigint, actual_sha256 string, "
    "x array<array<float>>, time_s array<double>, valid_mask array<boolean>, "
    "support_s array<struct<start:double,end:double>>, observed_fraction array<float>, "
    "read_error string"
)
PREDICTION_LINE = (
    "sample_id string, subject_id string, label bigint, prediction bigint, seed bigint, split string, probabilities array<double>"
)
CLIP_FACTS = (
    "source_file string, samplerate int, channels int, sample_width_bytes int, nframes bigint, "
    "samples bigint, nonzero_samples bigint, clipped_ratio double, decode_error string"
)
