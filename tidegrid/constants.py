"""Fixed values of the data contract.

Everything here has to equal the published contract for results to agree, so
the values are stated as they are; no logic lives in this module.
"""

# -- splits, seeds and window geometry (fixed values) ------------------------
SPLITS = ("train", "val", "test")
SEEDS = (11, 22, 33)
WINDOW_MS = 30_000
STRIDE_MS = 30_000
PARENT_MS = 240_000
WINDOWS_PER_PARENT = 8
SUBWINDOW_MS = 5_000
SUBWINDOWS_PER_WINDOW = 6
SESSION_GRID_MS = 2_400_000
CLIP_MS = 10_000

# -- label classes (fixed values) --------------------------------------------
FATIGUE_CLASSES = ("low", "medium", "high")
CLIP_CLASSES_9 = (
    "No task", "Watching video", "Playing game", "Messaging", "Phone call",
    "Listening to radio", "Reading", "Eating", "Chatting with passenger",
)
CLIP_TASKS_6 = ("01", "03", "04", "05", "07", "08")
CLIP_CLASSES_6 = (
    "No task", "Playing game", "Messaging", "Phone call", "Reading", "Eating",
)
CLIP_SCHEME = "dcpt_video_6c_v1"
TASK_MODALITIES = {"fatigue": ("video", "can"), "distraction": ("video", "audio")}

# -- fixed subject split for the fatigue task (fixed values) -----------------
FATIGUE_SUBJECTS = {
    "train": ("D", "F", "G", "J", "K", "L", "N", "Q", "R", "S"),
    "val": ("A", "E", "O"),
    "test": ("C", "H", "P"),
}

# -- telemetry contract (fixed values) ---------------------------------------
TELEMETRY_HEADER = (
    "timestamp[us]", "raw rendering timestamp[us]", "raw simulation timestamp[us]",
    "raw paused simulation timestamp[us]", "heading[deg]", "pitch[deg]",
    "roll[deg]", "speed[m/s]", "rpm", "gear",
)
TELEMETRY_FEATURES = (
    "heading_sin", "heading_cos", "pitch_sin", "pitch_cos", "roll_sin",
    "roll_cos", "speed_mps", "rpm", "gear",
)
CONDITION_NAMES = {"A": "Alert", "D": "Drowsy"}
NOMINAL_TELEMETRY_HZ = 60.0

# -- reason codes (fixed values) ---------------------------------------------
SOURCE_MISSING = "SOURCE_TELEMETRY_MISSING"
CLOCK_PENDING = "CLOCK_MAPPING_PENDING_AFTER_DISCONTINUITY"
RAW_COVERAGE_LOW = "RAW_COVERAGE_BELOW_95_PERCENT"
FEATURE_COVERAGE_LOW = "FEATURE_COVERAGE_BELOW_95_PERCENT"
UNUSABLE_GAP = "CONTINUOUS_UNUSABLE_GAP_EXCEEDS_1S"
WINDOW_REASONS = (SOURCE_MISSING, CLOCK_PENDING, RAW_COVERAGE_LOW, FEATURE_COVERAGE_LOW, UNUSABLE_GAP)

SYNC_ALIGNED = "provider_documented_aligned"
SYNC_MISMATCH = "unverified_duration_mismatch"
SYNC_NO_VIDEO = "unverified_missing_unique_ir_video"

NO_FEATURES = "NO_FEATURES_YET"
INDEX_NOT_OK = "FEATURE_INDEX_NOT_OK"
FILE_INVALID = "FEATURE_FILE_INVALID"
COVERAGE_LOW = "FEATURE_COVERAGE_BELOW_THRESHOLD"
NOT_VERIFIED = "FEATURE_NOT_VERIFIED"
FILE_MISSING = "FEATURE_FILE_MISSING"
COVERAGE_BELOW = "coverage_below_0.95"

# -- clip quality limits and codes (fixed values) ----------------------------
CLIP_SECONDS = 10.0
CLIP_TAIL_S = 0.10
CLIP_SLACK_S = 0.05
CLIP_RATE = 44_100
CLIP_CHANNELS = 2
CLIP_WIDTH = 2
CLIP_PEAK = 32_767
CLIP_PEAK_RATIO = 1e-4
MIN_COVERAGE = 0.95

# -- manifest columns (fixed values) -----------------------------------------
COMMON_FIELDS = (
    "sample_id", "modality", "subject_id", "session_id", "split", "source_file",
    "window_index", "window_start_ms", "window_end_ms", "duration_ms",
    "label_class", "label_id", "valid", "valid_ratio", "mask", "feature_path",
    "feature_shape", "feature_dtype", "extractor_name", "extractor_version", "error",
)
FATIGUE_FIELDS = (
    "sample_id", "modality", "subject_id", "session_id", "split", "source_file",
    "window_index", "window_start_ms", "window_end_ms", "duration_ms",
    "label_start_ms", "label_end_ms", "kss_score",
    "label_class", "label_id", "valid", "valid_ratio", "mask", "feature_path",
    "feature_shape", "feature_dtype", "extractor_name", "extractor_version", "error",
)
CLIP_6_FIELDS = (
    "sample_id", "modality", "subject_id", "session_id", "split", "source_file",
    "window_index", "window_start_ms", "window_end_ms", "duration_ms",
    "label_class", "label_id", "label_scheme", "valid", "valid_ratio", "mask",
    "feature_path", "feature_shape", "feature_dtype", "extractor_name",
    "extractor_version", "error",
)
BUNDLE_DTYPES = {
    "x": "float32", "time_s": "float64", "valid_mask": "bool",
    "support_s": "float64", "observed_fraction": "float32",
}
TELEMETRY_SHAPE = (300, 9)
VIDEO_SHAPE = (6, 96)
CLIP_VIDEO_SHAPE = (10, 512)
CLIP_AUDIO_SHAPE = (5, 2048)

# -- identity fields compared across modalities (fixed values) ---------------
PAIR_KEY = ("subject_id", "session_id", "window_start_ms", "window_end_ms")
PAIR_LABEL_FIELDS = (
    "split", "label_start_ms", "label_end_ms", "kss_score", "label_class", "label_id",
)
CHILD_FIELDS = (
    "subject_id", "session_id", "split", "label_start_ms", "label_end_ms",
    "kss_score", "label_class", "label_id",
)
PAIR_WINDOW_FIELDS = (
    "subject_id", "session_id", "split", "window_start_ms", "window_end_ms",
    "label_start_ms", "label_end_ms", "kss_score", "label_class", "label_id",
)
REQUEST_FIELDS = (
    "sample_id", "subject_id", "session_id", "window_start_ms", "window_end_ms",
    "source_feature", "source_time_reference",
)
FORBIDDEN_NAME_PARTS = ("label", "kss", "prob", "prediction", "metric")
TEXT_SIZE_LIMIT = 10 * 1024 * 1024
STATE_VERSION = "masked_zscore_v1"
