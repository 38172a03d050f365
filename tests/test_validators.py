import pytest
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.operators import validators as V
from tidegrid.plans.guards import ContractError, LockedSplitError
from tests.test_features_and_clips import BUNDLE, bundle

FATIGUE = "row_no long, " + ", ".join(f"{n} string" for n in C.FATIGUE_FIELDS)
CLIP = "row_no long, " + ", ".join(f"{n} string" for n in C.COMMON_FIELDS)
CLIP6 = "row_no long, " + ", ".join(f"{n} string" for n in C.CLIP_6_FIELDS)
DESCRIPTORS = {"mask": "a.npz::valid_mask", "feature_path": "a.npz", "feature_shape": "[6,4]", "feature_dtype": "float32"}


def base(**change):
    return {"sample_id": "s1", "modality": "video", "subject_id": "D", "session_id": "D_A", "split": "train", "source_file": "raw/a.bin", "window_index": "0",
            "window_start_ms": "0", "window_end_ms": "30000", "duration_ms": "30000", "label_start_ms": "0", "label_end_ms": "240000", "kss_score": "6.5",
            "label_class": "medium", "label_id": "1", "valid": "true", "valid_ratio": "1.0", **DESCRIPTORS, "extractor_name": "x", "extractor_version": "v1", "error": ""} | change


def clip(**change):
    return base(subject_id="P01", session_id="s", window_end_ms="10000", duration_ms="10000", label_class="No task", label_id="0") | change


def table(rows, records, fields, schema):
    return rows([(i, *[r[f] for f in fields]) for i, r in enumerate(records, start=2)], schema)


def arrays(rows, *data):
    return rows(data or [bundle("a.npz")], BUNDLE).withColumnRenamed("sample_id", "feature_path").drop("split")


def found(errors):
    return sorted((r["code"], r["row_no"], r["rule"]) for r in errors.collect())


@pytest.mark.parametrize("change,want", [
    ({}, []), ({"extractor_version": "latest"}, "identity_fields"), ({"modality": "audio"}, "modality"), ({"split": "dev"}, "split"),
    ({"source_file": "../a"}, "source_file"), ({"source_file": "[]"}, "source_file"), ({"window_index": "0.0"}, "integers"), ({"window_end_ms": "30001"}, "window_times"),
    ({"window_start_ms": "500", "window_end_ms": "30500"}, "window_grid"), ({"label_start_ms": "30000", "label_end_ms": "270000"}, "parent_interval"),
    ({"window_index": "1"}, "window_index"), ({"label_id": "2"}, "kss_mapping"), ({"kss_score": "nan"}, "kss_mapping"), ({"valid": "yes"}, "valid_text"),
    ({"valid_ratio": "1.5"}, "ratio_range"), ({"valid_ratio": "nan"}, "ratio_range"), ({"error": "x"}, "valid_with_error"), ({"valid": "false"}, "invalid_without_error"),
    ({"valid_ratio": "0.9"}, "ratio_below_threshold"), ({"feature_path": ""}, "absent_feature"), ({"feature_path": "a.csv", "mask": "a.csv::valid_mask"}, "npz_suffix"),
    ({"mask": "a.npz::mask"}, "mask_reference"), ({"mask": "b.npz::valid_mask"}, "mask_reference"), ({"feature_path": "b.npz", "mask": "b.npz::valid_mask"}, "bundle_missing"),
    ({"feature_shape": "[6,5]"}, "declared_shape"), ({"feature_shape": "6x4"}, "shape_json"), ({"feature_dtype": "float64"}, "declared_dtype"), ({"valid_ratio": "0.99"}, "ratio_union"),
    ({"valid": "false", "error": "gap", "valid_ratio": "0", "feature_path": "", "mask": "", "feature_shape": "", "feature_dtype": ""}, []),
    ({"valid": "0", "error": "gap"}, []), ({"sample_id": " s1 "}, [])])
def test_shared_rules(rows, change, want):
    got = found(V.validate_metadata(table(rows, [base(**change)], C.FATIGUE_FIELDS, FATIGUE), "fatigue", arrays(rows)))
    assert got == ([("INVALID_ROW", 2, want)] if want else [])


def test_first_broken_rule_hides_the_later_ones(rows):
    got = found(V.validate_metadata(table(rows, [base(modality="audio", label_id="9", split="dev")], C.FATIGUE_FIELDS, FATIGUE), "fatigue", arrays(rows)))
    assert got == [("INVALID_ROW", 2, "modality")]


@pytest.mark.parametrize("array,rule", [
    ({"x": [[float("inf")] * 4] * 6}, "nonfinite"), ({"observed_fraction": [2.0] * 6}, "fraction"),
    ({"time_s": [1.0, 1.0, 12.0, 16.0, 21.0, 26.0]}, "time_increasing"), ({"support_s": [(0.0, 5.0)] * 6}, "centre")])
def test_array_rules(rows, array, rule):
    got = found(V.validate_metadata(table(rows, [base()], C.FATIGUE_FIELDS, FATIGUE), "fatigue", arrays(rows, bundle("a.npz", **array))))
    assert got == [("INVALID_ROW", 2, rule)]


def windows(n, **change):
    return [base(sample_id=f"s{i}", window_index=str(i % 8), window_start_ms=str(i * 30000), window_end_ms=str(i * 30000 + 30000),
                 label_start_ms=str(i // 8 * 240000), label_end_ms=str(i // 8 * 240000 + 240000)) | change for i in range(n)]


def validate(rows, records):
    return found(V.validate_metadata(table(rows, records, C.FATIGUE_FIELDS, FATIGUE), "fatigue", arrays(rows)))


def test_rules_across_rows(rows):
    assert validate(rows, windows(10)) == []
    twice = windows(3)
    twice[2]["sample_id"] = "s0"
    assert validate(rows, twice) == [("DUPLICATE_SAMPLE_ID", 4, "")]
    again = [*windows(2), windows(2)[1] | {"sample_id": "other"}]
    assert validate(rows, again) == [("DUPLICATE_WINDOW", 4, "")]
    gap = windows(4)
    del gap[2]
    assert validate(rows, gap) == [("NONSTANDARD_STRIDE", None, "")]
    mixed = windows(2)
    mixed[1]["modality"] = "can"
    assert validate(rows, mixed) == [("MIXED_MODALITIES", None, "")]
    conflict = windows(3)
    conflict[1] |= {"kss_score": "2", "label_id": "0", "label_class": "low"}
    assert validate(rows, conflict) == [("PARENT_LABEL_CONFLICT", 3, ""), ("PARENT_LABEL_CONFLICT", 4, "")]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_rules_across_rows_do_not_depend_on_chunks(rows, chunk):
    """One subject and one sample id hold most rows; errors come from plain loops over the rows."""
    spots = [(f"s{i % 3 or i}", "D" if i % 4 else "E", i // 6, i // 4 % 2 + i % 5 // 4, "train" if i % 7 else "val") for i in range(40)]
    data = [(n, s, who, f"{who}_A", split, "video", time, None, parent, float(score))
            for n, (s, who, time, score, split) in enumerate(spots) for parent in [time // 2]]
    state = rows(data, "row_no long, sample_id string, subject_id string, session_id string, split string, modality string, "
                       "p_window_start_ms long, __at int, p_label_start_ms long, p_kss_score double")
    want, last = [], {}
    for n, s, who, session, split, _, time, _, parent, score in data:
        for code, key, value in [("DUPLICATE_SAMPLE_ID", (s,), None), ("SUBJECT_SPLIT_LEAKAGE", (who,), split),
                                 ("PARENT_LABEL_CONFLICT", (who, session, parent), score), ("DUPLICATE_WINDOW", (who, session, time), None)]:
            if (code, key) in last and (value is None or last[code, key] != value):
                want.append((code, n, ""))
            last[code, key] = value
    assert len({w[0] for w in want}) == 4
    got = V._order_errors(state, V.metadata_rules("fatigue"), "fatigue", chunk)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_leakage_only_counts_rows_that_got_that_far(rows):
    leak = windows(3)
    leak[1]["split"] = leak[2]["split"] = "val"
    assert validate(rows, leak) == [("SUBJECT_SPLIT_LEAKAGE", 3, ""), ("WRONG_ULDD_SPLIT", 3, ""), ("WRONG_ULDD_SPLIT", 4, "")]
    # a row stopped by the split rule itself leaves no trace
    leak = windows(3)
    leak[1]["split"] = "dev"
    assert ("SUBJECT_SPLIT_LEAKAGE", 4, "") not in validate(rows, leak)


def test_empty_and_malformed(rows, spark):
    empty = table(rows, [base()], C.FATIGUE_FIELDS, FATIGUE).where("1 = 0")
    assert found(V.validate_metadata(empty, "fatigue")) == [("EMPTY_METADATA", None, "")]
    short = table(rows, windows(2), C.FATIGUE_FIELDS, FATIGUE).withColumn("malformed", F.col("row_no") == 3)
    assert found(V.validate_metadata(short, "fatigue", arrays(rows))) == [("MALFORMED_ROW", 3, "")]
    report = V.validation_report(V.validate_metadata(table(rows, windows(2), C.FATIGUE_FIELDS, FATIGUE), "fatigue", arrays(rows))).first()
    assert (report["status"], report["error_count"]) == ("PASS", 0)


def test_headers():
    assert V.header_errors(["a", "b", "a"], ["a", "c"]) == [("DUPLICATE_COLUMNS", ["a"]), ("MISSING_COLUMNS", ["c"])]


@pytest.mark.parametrize("change,want", [({}, []), ({"subject_id": "P41"}, "subject"), ({"window_index": "1"}, "clip_window"), ({"label_class": "Eating"}, "clip_label"), ({"label_id": "9"}, "clip_label")])
def test_clip_task(rows, change, want):
    feature = arrays(rows, bundle("a.npz", step=10 / 6))
    got = found(V.validate_metadata(table(rows, [clip(**change)], C.COMMON_FIELDS, CLIP), "distraction", feature))
    assert got == ([("INVALID_ROW", 2, want)] if want else [])


def six(**change):
    name = "01_P01_20231111_09_31_43_25"
    return clip(sample_id=name, session_id="P01_20231111_0931_43", source_file=f'["d/{name}.wav"]', label_scheme=C.CLIP_SCHEME, feature_shape="[10,512]") | change


@pytest.mark.parametrize("change,audio,video", [
    ({}, "", ""), ({"session_id": "P01"}, "session_form", "session_form"), ({"source_file": "d/other.wav"}, "source_stem", "source_stem"), ({"split": "val"}, "split_map", "split_map"),
    ({"label_id": "2"}, "label", "label"), ({"label_scheme": "old"}, "label_scheme", ""), ({"valid": "false", "error": "low"}, "feature_on_invalid", ""),
    ({"feature_path": "/a.npz"}, "path", "path")])
def test_six_class_rules(rows, change, audio, video):
    feature = arrays(rows, bundle("a.npz", tokens=10, width=512, step=1.0))
    splits = rows([("P01", "train")], "subject_id string, split string")
    for modality, want in (("audio", audio), ("video", video)):
        df = table(rows, [six(modality=modality, **change)], C.CLIP_6_FIELDS, CLIP6)
        assert found(V.validate_clips_6(df, modality, splits, feature)) == ([("INVALID_ROW", 2, want)] if want else [])
    small = table(rows, [six(modality="video", feature_shape="[6,4]")], C.CLIP_6_FIELDS, CLIP6)
    assert found(V.validate_clips_6(small, "video", splits, arrays(rows, bundle("a.npz", step=10 / 6)))) == [("INVALID_ROW", 2, "expected_shape")]


def test_telemetry_contract(rows):
    shape = {"tokens": 300, "width": 9, "step": 0.1, "x": [[0.0] * 8 + [4.0]] * 300, "time_s": [(i + 0.5) / 10 for i in range(300)],
             "support_s": [(i / 10, (i + 1) / 10) for i in range(300)]}
    records = [r | {"modality": "can", "feature_shape": "[300,9]"} for r in windows(80)]
    extra = {"feature_columns": F.lit('["' + '","'.join(C.TELEMETRY_FEATURES) + '"]'), "qc_status": F.lit("PASS"), "qc_reason_codes": F.lit(""),
             "clock_status": F.lit("stable"), "raw_coverage_ratio": F.lit("1.0"), "feature_sha256": F.lit("h")}
    df = table(rows, records, C.FATIGUE_FIELDS, FATIGUE).withColumns(extra)
    good = arrays(rows, bundle("a.npz", **shape)).withColumn("actual_sha256", F.lit("h"))
    assert found(V.validate_telemetry(df, good)) == []
    assert found(V.validate_telemetry(df.where("row_no < 80"), good)) == [("INCOMPLETE_CAN_SESSION_GRID", None, "")]
    only = lambda d, b: {(c, r) for c, _, r in found(V.validate_telemetry(d, b)) if c == "INVALID_CAN_ROW"}
    assert only(df.withColumn("qc_status", F.lit("FAIL")), good) == {("INVALID_CAN_ROW", "valid_status")}
    assert only(df, good.withColumn("actual_sha256", F.lit("z"))) == {("INVALID_CAN_ROW", "sha256")}
    half = arrays(rows, bundle("a.npz", **(shape | {"x": [[0.0] * 8 + [4.5]] * 300}))).withColumn("actual_sha256", F.lit("h"))
    assert only(df, half) == {("INVALID_CAN_ROW", "values")}


PAIR = {
    "row_no": 2, "paired_sample_id": "ULDD_D_A_000000000_000030000", "parent_id": "ULDD_D_A_000000000_000240000", "subject_id": "D", "session_id": "D_A", "split": "train", "window_index": 0,
    "window_start_ms": 0, "window_end_ms": 30000, "duration_ms": 30000, "label_start_ms": 0, "label_end_ms": 240000, "kss_score": 6.5, "label_class": "medium", "label_id": 1,
    "paired_valid": True, "exclude_reason": "", "complete8_eligible": True, "complete8_exclude_reason": "", "sync_status": C.SYNC_ALIGNED, "offset_ms": 0, "hardware_clock_verified": False,
    "video_sample_id": "v", "video_subwindow_ids": "a|b|c|d|e|f", "video_feature_archive": "v.zip", "video_feature_member": "f/a.npz", "video_feature_shape": "[6,96]", "video_feature_dtype": "float32",
    "video_feature_sha256": "a" * 64, "video_source_time_reference": "session_relative", "video_time_transform": "subtract_window_start_ms_div_1000", "can_sample_id": "ULDD_D_A_000000000_000030000",
    "can_feature_path": "c/a.npz", "can_feature_shape": "[300,9]", "can_feature_dtype": "float32", "can_feature_sha256": "B" * 64, "can_valid_ratio": 0.99}


@pytest.mark.parametrize("change,rule", [
    ({}, None), ({"subject_id": "A"}, "subject_split"), ({"session_id": "F_A"}, "session_prefix"), ({"paired_valid": False}, "paired_valid"), ({"exclude_reason": "x"}, "reasons"),
    ({"sync_status": C.SYNC_MISMATCH}, "sync_status"), ({"offset_ms": 1}, "offset"), ({"hardware_clock_verified": True}, "hardware_clock"), ({"window_index": 8}, "window_index"),
    ({"window_index": 1}, "index_time"), ({"label_id": 2}, "kss_mapping"), ({"paired_sample_id": "x"}, "pair_id"), ({"can_sample_id": "x"}, "telemetry_id"), ({"parent_id": "x"}, "parent_id"),
    ({"video_feature_shape": "[6,95]"}, "video_shape"), ({"video_subwindow_ids": "a|a|b|c|d|e"}, "children"), ({"can_valid_ratio": 0.9}, "valid_ratio"), ({"can_feature_path": "../a"}, "paths"),
    ({"can_feature_sha256": "zz"}, "sha256")])
def test_pair_manifest(spark, change, rule):
    df = spark.createDataFrame([PAIR | change])
    assert [r["rule"] for r in V.validate_pairs(df, "train").collect()] == ([rule] if rule else [])


def test_pair_copies_and_parents(spark):
    twice = spark.createDataFrame([PAIR, PAIR | {"row_no": 3, "video_sample_id": "w"}])
    assert sorted(r["rule"] for r in V.validate_pairs(twice, "train").collect()) == ["duplicate_can_sample_id", "duplicate_paired_sample_id"]
    eight = [PAIR | {"window_index": i, "label_id": 1 if i else 2} for i in range(8)]
    assert [r["code"] for r in V.validate_pair_parents(spark.createDataFrame(eight)).collect()] == ["labels"]


def test_locked_split(rows):
    df = rows([("train",), ("val",)], "split string")
    assert V.read_split(df, "train").count() == 1
    with pytest.raises(LockedSplitError):
        V.read_split(df, "test")
    with pytest.raises(LockedSplitError):
        V.read_split(rows([("train",), ("test",)], "split string"), "train")
    assert V.read_split(rows([("train",), ("test",)], "split string"), "test", allow_test=True).count() == 1


def test_request(rows, spark):
    schema = "sample_id string, subject_id string, session_id string, window_start_ms long, window_end_ms long, source_feature string, source_time_reference string"
    good = [(f"r-{s}", s, f"{s}_A", 0, 30_000, "f.npz", "session_relative") for s in "CHP"]
    assert V.validate_request(rows(good, schema)).count() == 0
    assert {r["rule"] for r in V.validate_request(rows(good[:2], schema)).collect()} == {"P"}
    bad = [*good, ("r-C", "C", "C_A", 0, 30_000, "f.npz", "epoch"), ("a b", "D", "D_A", 0, 1, "/f", "x")]
    assert {r["rule"] for r in V.validate_request(rows(bad, schema)).collect()} == {"duplicate_sample_id", "time_reference", "sample_id"}
    with pytest.raises(ContractError, match="scoring"):
        V.require_request_columns(rows([("a", 1)], "sample_id string, label_id int"))


def test_training_rows(rows):
    schema = "row_no long, sample_id string, label_scheme string, split string, label_id string, label_class string"
    data = [(2, "01_a", C.CLIP_SCHEME, "train", "0", "No task"), (3, "01_a", C.CLIP_SCHEME, "train", "0", "No task"), (4, "02_a", C.CLIP_SCHEME, "train", "0", "No task"),
            (5, "03_a", C.CLIP_SCHEME, "train", "0", "No task"), (6, "", C.CLIP_SCHEME, "train", "0", "No task")]
    assert {r["row_no"]: r["rule"] for r in V.validate_training_rows(rows(data, schema)).collect()} == {3: "duplicate_sample_id", 4: "task", 5: "label", 6: "sample_id"}


def test_package(rows):
    schema = "sample_id string, subject_id string, feature_path string, feature_sha256 string, feature_shape string, feature_dtype string"
    index = [(f"r-{s}", s, f"f/{s}.npz", "h", "[6,96]", "float32") for s in "CHP"]
    good = [bundle(f"f/{s}.npz", width=96) for s in "CHP"]
    judge = lambda i, b, digest="h": sorted(r["rule"] for r in V.validate_package(
        rows(i, schema), arrays(rows, *b).withColumn("actual_sha256", F.lit(digest))).collect())
    assert judge(index, good) == []
    assert judge(index, good, "z") == ["feature_hash"] * 3
    assert judge(index, good[:2]) == ["missing_feature"]
    assert judge(index[:2], good) == ["P"]
    assert judge([*index, index[0]], good) == ["duplicate_sample_id"]
    assert judge([*index, ("r-D", "D", "f/C.npz", "h", "[6,96]", "float32")], good) == ["subject"]
    assert judge([index[0], index[1], ("r-P", "P", "f/P.npz", "h", "[6, 96]", "float32")], good) == ["declaration"]
    assert judge(index, [good[0], good[1], bundle("f/P.npz", width=95)]) == ["expected_shape"]
    assert judge(index, [good[0], good[1], bundle("f/P.npz", width=96, mask=[False] * 6)]) == ["no_valid_token"]
    assert judge(index, [good[0], good[1], bundle("f/P.npz", width=96, time_s=[i * 5.0 for i in range(6)])]) == ["time_support"]
