"""Table layouts shared by sources and operators."""

from pyspark.sql import types as T

# The manifest columns in file order.
MANIFEST_COLUMNS = [
    "subject_id",
    "split",
    "frame_dir",
    "num_frames",
    "gait_system",
    "speed",
    "clothing",
    "direction",
    "recording_id",
    "source_video_id",
]

# The metadata columns carried beside every feature vector.
METADATA_COLUMNS = [
    "subject_id",
    "split",
    "gait_system",
    "speed",
    "clothing",
    "direction",
    "recording_id",
    "source_video_id",
    "window_start",
]

# The columns of one probe result row.
PROBE_COLUMNS = [
    "model",
    "task",
    "train_examples",
    "val_examples",
    "num_classes",
    "majority_baseline",
    "accuracy",
    "balanced_accuracy",
    "macro_f1",
]

MANIFEST_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_COLUMNS])

FRAME_FILES = "path string, length bigint"
PIXEL_FRAMES = "recording_id string, frame_no int, height int, width int, pixels binary"

HISTORY = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("train_cosine", T.DoubleType()),
        T.StructField("epoch_seconds", T.DoubleType()),
        T.StructField(
            "tune",
            T.StructType(
                [
                    T.StructField("loss", T.DoubleType()),
                    T.StructField("cosine", T.DoubleType()),
                ]
            ),
        ),
    ]
)
