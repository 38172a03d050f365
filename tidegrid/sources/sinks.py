"""Exports. Nothing here replaces an existing result."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid import constants as C
from tidegrid.operators.features import StandardizerState, rebase_time, state_json, time_support_codes
from tidegrid.plans.guards import ContractError, require_none

#: Records in one compressed file, which one task reads.
FILE_RECORDS = 1_000_000


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options) -> str:
    """Writes ``df``; an existing target is an error and stays as it is."""
    writer = df.write.format(fmt).mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_csv(df: DataFrame, path: str, compression: str = "none") -> str:
    """A compressed file is one range to its reader, so a task goes on to another file after ``FILE_RECORDS``."""
    bound = {} if compression == "none" else {"maxRecordsPerFile": FILE_RECORDS}
    return write_new(df, path, "csv", header=True, escape='"', quote='"', emptyValue="", nullValue="", compression=compression, **bound)


def _content(df: DataFrame) -> DataFrame:
    """Number of rows and a checksum that their order does not change; equal rows count as often as they occur."""
    sums = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(sums, F.lit(0)).cast("string").alias("checksum"))


def write_set(outputs: Mapping[str, tuple[DataFrame, Sequence[str]]], out: str) -> dict[str, str]:
    """Writes (table, partition columns) by name under ``out``, all of them or none, and gives their paths.

    The tables go to a hidden folder beside ``out``, are read back into a manifest of rows and checksums, and
    appear by one rename that refuses an existing target. A failure takes the hidden folder away. Names of
    partition columns must not clash with others, and maps have no checksum.
    """
    spark = next(iter(outputs.values()))[0].sparkSession
    jvm, target = spark._jvm, out.rstrip("/")
    parent, _, name = target.rpartition("/")
    hidden = f"{parent}/.{name}-{uuid.uuid4().hex}"
    fs_path = jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.sc().hadoopConfiguration()
    system = fs_path(target).getFileSystem(conf)
    if system.exists(fs_path(target)):
        raise ContractError(f"{target} exists")
    try:
        contents = None
        for label, (df, by) in outputs.items():
            path = write_new(df, f"{hidden}/{label}", partition_by=by)
            row = _content(spark.read.schema(df.schema).parquet(path).select(*df.columns)).withColumn("output", F.lit(label))
            contents = row if contents is None else contents.unionByName(row)
        write_new(contents.coalesce(1), f"{hidden}/manifest", "json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
        no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files.rename(system.makeQualified(fs_path(hidden)), system.makeQualified(fs_path(target)), no_options)
    except BaseException:
        system.delete(fs_path(hidden), True)
        raise
    return {label: f"{target}/{label}" for label in outputs}


def read_set_manifest(spark: SparkSession, out: str) -> DataFrame:
    """(output, rows, checksum) of a set written by ``write_set``."""
    return spark.read.schema("output string, rows bigint, checksum string").json(f"{out.rstrip('/')}/manifest")


def check_set(spark: SparkSession, out: str, schemas: Mapping[str, StructType]) -> DataFrame:
    """(output, expected, found, same) of every named output (name to schema) against its manifest."""
    found = None
    for label, schema in schemas.items():
        row = _content(spark.read.schema(schema).parquet(f"{out.rstrip('/')}/{label}").select(*schema.names)).select(
            F.lit(label).alias("output"), F.col("rows").alias("found"), F.col("checksum").alias("sum"))
        found = row if found is None else found.unionByName(row)
    return read_set_manifest(spark, out).join(found, "output", "full").select(
        "output", F.col("rows").alias("expected"), "found",
        F.coalesce((F.col("rows") == F.col("found")) & (F.col("checksum") == F.col("sum")), F.lit(False)).alias("same"))


def write_split_manifests(windows: DataFrame, parents: DataFrame, out: str) -> dict[str, str]:
    """Valid windows and complete parents by split, excluded windows, all complete parents: all four or none."""
    complete = parents.where("complete_for_240s")
    return write_set({
        "windows": (windows.where("valid"), ["split"]),
        "parents": (complete, ["split"]),
        "excluded": (windows.where("not valid"), []),
        "complete_parents": (complete, []),
    }, out)


def export_predictions(preds: DataFrame, run_id: str, unit: str = "window_30s",
                       names: Sequence[str] = C.FATIGUE_CLASSES, keep: Sequence[str] = ()) -> DataFrame:
    """Array probabilities to one named column per class, ids in export order; ``keep`` names columns to leave beside them."""
    lead = [F.lit(run_id).alias("run_id"), "seed", "split"]
    body = (["sample_id", "parent_id", "subject_id", "session_id", "window_index", "label_id"]
            if unit == "window_30s" else ["parent_id", "subject_id", "session_id", "label_id", "window_count"])
    named = [F.get("probabilities", F.lit(i)).alias(f"prob_{n}") for i, n in enumerate(names)]
    return preds.select(*lead, *body, *named, "prediction", *keep)


def export_feature_package(request: DataFrame, features: DataFrame, out: str | None = None) -> DataFrame:
    """The requested features in sample time, with their index columns.

    ``features`` carries source_feature and the five arrays. A requested feature
    that is absent, or whose times break the contract, stops the job.
    """
    joined = request.join(features, "source_feature", "left")
    relative = F.col("source_time_reference") == "sample_relative"
    start = F.when(relative, F.lit(0)).otherwise(F.col("window_start_ms"))
    based = rebase_time(joined.withColumn("__start", start), "__start").drop("__start")
    codes = time_support_codes()
    bad = F.col("x").isNull() | (F.size(codes) > 0) | ~F.exists("valid_mask", lambda v: v)
    if out is None:
        return based.withColumn("package_codes", F.when(F.col("x").isNull(), F.array(F.lit("missing"))).otherwise(codes))
    require_none(based, F.coalesce(bad, F.lit(True)), "requested feature")
    packed = based.withColumn("feature_path", F.concat(F.lit("features_30s/"), "sample_id", F.lit(".npz")))
    path = write_set({"package": (packed, [])}, out)["package"]
    return request.sparkSession.read.schema(packed.schema).parquet(path)


def save_state(spark: SparkSession, state: StandardizerState, path: str) -> str:
    """One JSON line; only a state fitted on train may be stored."""
    if state.fitted_split != "train":
        raise ContractError("only a train-fitted state may be saved")
    text = spark.range(1).select(F.lit(state_json(state)).alias("value"))
    return write_new(text, path, "text")


_STATE = (
    "version string, fitted_split string, source_manifest_sha256 string, valid_token_count bigint, "
    "feature_names array<string>, mean array<double>, scale array<double>, zero_variance_indices array<int>"
)


def load_state(spark: SparkSession, path: str) -> StandardizerState:
    row = spark.read.schema(_STATE).json(path).first()
    if row is None or row["version"] != C.STATE_VERSION:
        raise ContractError("unsupported normalisation version")
    if row["fitted_split"] != "train":
        raise ContractError("the state was not fitted on train")
    return StandardizerState(
        tuple(row["mean"]), tuple(row["scale"]), row["valid_token_count"], tuple(row["zero_variance_indices"]),
        tuple(row["feature_names"]), row["source_manifest_sha256"], row["fitted_split"], row["version"])
