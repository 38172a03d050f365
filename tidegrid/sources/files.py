"""Binary files: inventory, feature bundles and clips.

Only decoding runs in Python, once per file and in Arrow batches; the result is
a table and all rules stay in columns.
"""

from __future__ import annotations

import io
import wave
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid import schemas


def _files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def _below(root: str):
    """Path relative to ``root``; the scheme in front of it does not matter."""
    tail = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(F.col("path"), tail, -1)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, size, sha256 and modification time of every file but ``.tmp``."""
    return (
        _files(spark, root).where(~F.col("path").endswith(".tmp"))
        .select(_below(root).alias("path"), F.col("length").alias("size_bytes"),
                F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))
    )


def _bundle(payload: bytes) -> dict:
    import numpy as np

    blank = dict.fromkeys(C.BUNDLE_DTYPES)
    try:
        with np.load(io.BytesIO(payload), allow_pickle=False) as archive:
            if set(archive.files) != set(C.BUNDLE_DTYPES):
                return blank | {"read_error": "arrays"}
            arrays = {name: archive[name] for name in C.BUNDLE_DTYPES}
    except (OSError, ValueError, EOFError, KeyError, zipfile.BadZipFile):
        return blank | {"read_error": "unreadable"}
    if any(str(arrays[n].dtype) != d for n, d in C.BUNDLE_DTYPES.items()):
        return blank | {"read_error": "dtype"}
    flat = all(arrays[n].ndim == 1 for n in ("time_s", "valid_mask", "observed_fraction"))
    if not flat or arrays["x"].ndim != 2 or arrays["support_s"].ndim != 2 or arrays["support_s"].shape[1] != 2:
        return blank | {"read_error": "shape"}
    out = {n: arrays[n].tolist() for n in C.BUNDLE_DTYPES if n != "support_s"}
    out["support_s"] = [{"start": a, "end": b} for a, b in arrays["support_s"].tolist()]
    return out | {"read_error": ""}


def _bundles(batches):
    import pandas as pd

    for batch in batches:
        rows = [_bundle(payload) for payload in batch["content"]]
        yield pd.concat([batch.drop(columns="content").reset_index(drop=True), pd.DataFrame(rows)], axis=1)[
            ["feature_path", "length", "actual_sha256", *C.BUNDLE_DTYPES, "read_error"]]


def ingest_feature_bundles(spark: SparkSession, root: str) -> DataFrame:
    """One row of arrays per NPZ file, with its hash and a read error if any."""
    files = _files(spark, root, "*.npz").select(
        _below(root).alias("feature_path"), "length", F.sha2("content", 256).alias("actual_sha256"), "content")
    return files.mapInPandas(_bundles, schemas.BUNDLE)


def _clip(payload: bytes) -> dict:
    import numpy as np

    facts = {"samplerate": 0, "channels": 0, "sample_width_bytes": 0, "nframes": 0, "samples": 0,
             "nonzero_samples": 0, "clipped_ratio": 0.0, "decode_error": ""}
    try:
        with wave.open(io.BytesIO(payload), "rb") as reader:
            facts |= {"channels": reader.getnchannels(), "sample_width_bytes": reader.getsampwidth(),
                      "samplerate": reader.getframerate(), "nframes": reader.getnframes()}
            raw = reader.readframes(facts["nframes"])
    except (wave.Error, EOFError):
        return facts | {"decode_error": "UNSUPPORTED_CONTAINER"}
    if facts["sample_width_bytes"] == C.CLIP_WIDTH and raw:
        samples = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2")
        peaks = np.abs(samples.astype(np.int32)) >= C.CLIP_PEAK
        facts |= {"samples": len(samples), "nonzero_samples": int(np.count_nonzero(samples)), "clipped_ratio": float(peaks.mean())}
    return facts


def _clips(batches):
    import pandas as pd

    for batch in batches:
        rows = pd.DataFrame([_clip(payload) for payload in batch["content"]])
        yield pd.concat([batch[["source_file"]].reset_index(drop=True), rows], axis=1)


def ingest_clip_facts(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Format facts of every file below ``root``; undecodable ones get a code."""
    files = _files(spark, root, glob).select(_below(root).alias("source_file"), "content")
    return files.mapInPandas(_clips, schemas.CLIP_FACTS)
