import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.operators import classifier, clips, jobs
from tidegrid.operators import features as B
from tidegrid.operators.intervals import block_frames, covered_seconds
from tidegrid.plans.guards import ContractError

BUNDLE = ("sample_id string, split string, x array<array<float>>, time_s array<double>, valid_mask array<boolean>, "
          "support_s array<struct<start:double,end:double>>, observed_fraction array<float>")


def bundle(sample="a", split="train", tokens=6, width=4, step=5.0, mask=None, **change):
    out = {
        "sample_id": sample, "split": split, "x": [[float(i * width + j) for j in range(width)] for i in range(tokens)],
        "time_s": [(i + 0.5) * step for i in range(tokens)], "valid_mask": mask or [True] * tokens,
        "support_s": [(i * step, (i + 1) * step) for i in range(tokens)], "observed_fraction": [1.0] * tokens}
    out.update(change)
    return tuple(out.values())


def first_error(rows, row, **kw):
    return rows([row], BUNDLE).select(B.first_bundle_error(B.bundle_rules(30.0, **kw)).alias("e")).first()["e"]


@pytest.mark.parametrize("change,error", [
    ({}, ""), ({"x": [[1.0, math.nan]] * 6}, "nonfinite"), ({"x": [[1.0], [1.0, 2.0]] * 3}, "x_shape"), ({"x": [[1.0, 2.0]] * 5}, "lengths"),
    ({"time_s": [2.5, 2.5, 12.5, 17.5, 22.5, 27.5]}, "time_increasing"), ({"support_s": [(0.0, 5.0)] * 5 + [(25.0, 31.0)]}, "support"),
    ({"support_s": [(0.0, 5.0), (8.0, 10.0), (10.0, 15.0), (15.0, 20.0), (20.0, 25.0), (25.0, 30.0)]}, "centre"),
    ({"observed_fraction": [1.5] + [1.0] * 5}, "fraction"), ({"time_s": None}, "arrays")])
def test_first_broken_array_rule(rows, change, error):
    assert first_error(rows, bundle(**change)) == error


def test_expected_shape(rows):
    assert first_error(rows, bundle(), shape=(6, 96)) == "expected_shape"
    assert first_error(rows, bundle(width=96), shape=(6, 96)) == ""


def test_time_variants(rows):
    at_start = bundle(time_s=[i * 5.0 for i in range(6)])
    open_, closed = (rows([at_start], BUNDLE).select(B.time_support_codes(30.0, c).alias("c")).first()["c"] for c in (False, True))
    assert open_ == ["outside_sample_support"] and closed == []
    short = bundle(time_s=[2.5])
    assert rows([short], BUNDLE).select(B.time_support_codes().alias("c")).first()["c"] == ["shape"]


@pytest.mark.parametrize("support,codes", [
    (None, []), ([(i * 5.0, i * 5.0 + 4.0) for i in range(6)], ["support_not_contiguous_grid"]),
    ([(i * 5.0, i * 5.0 + 6.0) for i in range(6)], ["support_not_contiguous_grid"])])
def test_video_grid(rows, support, codes):
    row = bundle(support_s=support) if support else bundle()
    assert rows([row], BUNDLE).select(B.fixed_grid_codes().alias("c")).first()["c"] == codes


def test_rebase(rows):
    late = bundle(time_s=[60 + (i + 0.5) * 5 for i in range(6)], support_s=[(60 + i * 5.0, 65 + i * 5.0) for i in range(6)])
    got = B.rebase_time(rows([late], BUNDLE).withColumn("window_start_ms", F.lit(60_000))).first()
    assert got["time_s"] == [2.5, 7.5, 12.5, 17.5, 22.5, 27.5] and got["support_s"][5]["end"] == 30.0


@pytest.mark.parametrize("intervals,mask,length", [
    ([(0.0, 2.0), (2.0, 3.0)], [True, True], 3.0), ([(0.0, 4.0), (1.0, 2.0)], [True, True], 4.0), ([(5.0, 6.0), (0.0, 1.0)], [True, True], 2.0),
    ([(0.0, 2.0), (1.0, 5.0)], [True, False], 2.0), ([(0.0, 2.0)], [False], 0.0)])
def test_covered_seconds(rows, intervals, mask, length):
    df = rows([(intervals, mask)], "s array<struct<start:double,end:double>>, m array<boolean>")
    assert df.select(covered_seconds(F.col("s"), F.col("m")).alias("c")).first()["c"] == length


def test_standardizer(rows):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, (10, 6, 4)).astype(np.float32)
    x[:, :, 3] = 7
    masks = rng.random((10, 6)) > 0.3
    data = [bundle(f"s{i}", "train" if i < 6 else "val", x=x[i].tolist(), mask=masks[i].tolist()) for i in range(10)]
    df = rows(data, BUNDLE)
    state = B.collect_state(B.fit_statistics(df), "abcd")
    used = x[:6][masks[:6]].astype(float)
    np.testing.assert_allclose(state.mean, used.mean(axis=0), rtol=1e-9)
    np.testing.assert_allclose(state.scale[:3], used.std(axis=0)[:3], rtol=1e-9)
    assert state.scale[3] == 1.0 and state.zero_variance_indices == (3,) and state.valid_token_count == len(used)
    for columns in (B.state_vectors(state), B.state_columns(B.fit_statistics(df))):
        got = {r["sample_id"]: np.array(r["x"]) for r in B.standardize(df, *columns).collect()}
        want = np.where(masks[..., None], (x - np.float32(state.mean)) / np.float32(state.scale), 0)
        for i in range(10):
            np.testing.assert_allclose(got[f"s{i}"], want[i], rtol=2e-5, atol=2e-6)
    with pytest.raises(ContractError):
        B.fit_statistics(df, "val")


def test_masked_values_and_padding_change_nothing(rows):
    mask = [True, False, True, True, False, False]
    plain = bundle(mask=mask)
    noise = bundle(mask=mask, x=[[float(i * 4 + j) if mask[i] else 999.0 for j in range(4)] for i in range(6)])
    for pool in (B.masked_mean_pool, B.masked_mean_max_last):
        got = [pool(rows([r], BUNDLE)).first()["pooled"] for r in (plain, noise)]
        padded = pool(B.pad_right(rows([plain], BUNDLE), 11)).first()["pooled"]
        assert got[0] == got[1] == padded
    assert pool(rows([bundle(mask=[False] * 6)], BUNDLE)).first()["pooled"] is None
    last = B.masked_mean_max_last(rows([plain], BUNDLE)).first()["pooled"]
    assert last[:4] == pytest.approx(np.mean([[0, 1, 2, 3], [8, 9, 10, 11], [12, 13, 14, 15]], axis=0)) and last[8:] == [12, 13, 14, 15]


def test_padding(rows):
    got = {r["sample_id"]: r for r in B.pad_right(rows([bundle(), bundle("b", tokens=2, mask=[False, False])], BUNDLE)).collect()}
    assert len(got["b"]["x"]) == 6 and got["b"]["all_invalid"] and got["b"]["valid_mask"] == [False] * 6 and got["b"]["support_s"][4]["end"] == 0.0
    assert not got["a"]["all_invalid"] and got["a"]["x"][5] == [20, 21, 22, 23]


def test_classifier_learns_a_separable_split(rows):
    rng = np.random.default_rng(1)
    data = []
    for i in range(120):
        label = i % 3
        x = rng.normal(label * 4, 1, (6, 4)).astype(np.float32)
        data.append((*bundle(f"s{i}", ("train", "val")[i % 2], x=x.tolist()), label))
    out = classifier.pooled_classifier(rows(data, BUNDLE + ", label_id int")).collect()
    val = [r for r in out if r["split"] == "val"]
    assert len(out) == 120 and np.mean([r["prediction"] == r["label_id"] for r in val]) > 0.95
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in out)


FACTS = "source_file string, samplerate int, channels int, sample_width_bytes int, nframes long, nonzero_samples long, clipped_ratio double, decode_error string"


def fact(rate=44_100, channels=2, width=2, frames=441_000, nonzero=1000, clipped=0.0, error="", name="01_P01_20231111_09_31_43_25.wav"):
    return (name, rate, channels, width, frames, nonzero, clipped, error)


@pytest.mark.parametrize("row,flags,reasons,status", [
    (fact(), [], [], "pass"), (fact(rate=16_000, frames=160_000), ["SAMPLE_RATE_DEVIATION"], ["SAMPLE_RATE_DEVIATION"], "pending"),
    (fact(channels=1), ["CHANNELS_NOT_STEREO"], ["CHANNELS_NOT_STEREO"], "pending"), (fact(width=1, nonzero=0, clipped=1.0), ["SAMPLE_WIDTH_NOT_16BIT"], ["SAMPLE_WIDTH_NOT_16BIT"], "pending"),
    (fact(nonzero=0), ["ZERO_AUDIO"], ["ZERO_AUDIO"], "pending"), (fact(clipped=2e-4), ["POSSIBLE_CLIPPING"], [], "pass_with_flags"), (fact(clipped=1e-4), [], [], "pass"),
    (fact(frames=0), ["EMPTY_AUDIO", "TAIL_SHORTFALL_EXCEEDS"], ["EMPTY_AUDIO", "TAIL_SHORTFALL_EXCEEDS"], "pending"),
    (fact(frames=441_000 + 44_100), ["LONGER_THAN_NOMINAL"], ["LONGER_THAN_NOMINAL"], "pending"), (fact(frames=441_000 + 2_000), [], [], "pass"),
    (fact(frames=441_000 - 4_000), ["MINOR_TAIL_SHORTFALL"], [], "pass_with_flags"), (fact(frames=441_000 - 5_000), ["TAIL_SHORTFALL_EXCEEDS"], ["TAIL_SHORTFALL_EXCEEDS"], "pending"),
    (fact(error="UNSUPPORTED_CONTAINER"), [], ["UNSUPPORTED_CONTAINER"], "pending")])
def test_clip_quality(rows, row, flags, reasons, status):
    got = clips.clip_qc(rows([row], FACTS)).first()
    assert (got["flags"], got["reason_codes"], got["qc_status"]) == (flags, reasons, status)
    assert got["primary_error"] == (reasons[0] if reasons else "")


def test_clip_metadata_and_totals(rows):
    data = [fact(), fact(name="02_P41_20231111_09_31_43_25.wav"), fact(frames=0, name="d\\03_P02_20231111_09_31_43_25.wav")]
    table, totals = jobs.build_clip_metadata(rows(data, FACTS), rows([("P01", "train")], "subject_id string, split string"))
    got = {r["sample_id"]: r for r in table.collect()}
    assert set(got) == {None, "01_P01_20231111_09_31_43_25", "03_P02_20231111_09_31_43_25"}
    assert got["01_P01_20231111_09_31_43_25"]["split"] == "train" and got["03_P02_20231111_09_31_43_25"]["split"] == ""
    assert got["03_P02_20231111_09_31_43_25"]["error"] == "EMPTY_AUDIO" and got["01_P01_20231111_09_31_43_25"]["error"] == C.NO_FEATURES
    values = {(r["metric"], r["key"]): r["value"] for r in totals.collect()}
    assert values["files_total", ""] == 3 and values["unparsed_total", ""] == 1 and values["duration_mean_s", ""] == 5.0
    assert values["reason_counts", "EMPTY_AUDIO"] == 1 and values["rows_by_class", "Playing game"] == 1


AUDIT = "sample_id string, error string"
INDEX = "sample_id string, path string, status string"
FACT = "path string, bundle_error string, coverage double, shape string, dtype string"


@pytest.mark.parametrize("error,status,facts,strict,lenient", [
    ("ZERO_AUDIO", "ok", ("", 1.0), "ZERO_AUDIO", ""), (C.NO_FEATURES, None, None, C.NO_FEATURES, C.NO_FEATURES),
    (C.NO_FEATURES, "failed", ("", 1.0), C.INDEX_NOT_OK, ""), (C.NO_FEATURES, "ok", None, C.FILE_INVALID, C.FILE_MISSING),
    ("", "ok", ("fraction", 1.0), C.FILE_INVALID, ""), (C.NO_FEATURES, "ok", ("", 0.9), C.COVERAGE_LOW, C.COVERAGE_BELOW), (C.NO_FEATURES, "ok", ("", 0.95), "", "")])
def test_feature_state(rows, error, status, facts, strict, lenient):
    audit = rows([("a", error)], AUDIT)
    index = rows([("a", "f.npz", status)] if status else [("b", "g.npz", "ok")], INDEX)
    found = rows([("f.npz", *facts, "[5,2048]", "float32")] if facts else [("z", "", 1.0, "", "")], FACT)
    a, b = clips.attach_features_strict(audit, index, found).first(), clips.attach_features_lenient(audit, index, found).first()
    assert (a["error"], b["error"]) == (strict, lenient)
    assert a["valid"] == (strict == "") and (a["mask"] == "f.npz::valid_mask") == (strict == "")
    if lenient == C.COVERAGE_BELOW:
        assert b["feature_shape"] == "[5,2048]" and not b["valid"] and b["valid_ratio"] == 0.9
    if lenient == C.FILE_MISSING:
        assert clips.attach_features_lenient(audit, index, None).first()["error"] == C.NOT_VERIFIED


def test_block_shares(rows):
    got = block_frames(rows([(150_000,)], "n long"), "n").orderBy("block_no").collect()
    assert [r["observed_fraction"] for r in got] == [1.0, 1.0, 1.0, 1.0, pytest.approx(22_000 / 32_000)]
    assert [r["block_valid"] for r in got] == [True] * 4 + [False]
    edge = block_frames(rows([(4 * 32_000 + 30_400,)], "n long"), "n").where("block_no = 4").first()
    assert edge["block_valid"]


def test_six_class_jobs(rows):
    schema = "sample_id string, subject_id string, session_id string, split string, source_file string, error string, label_id int, label_class string"
    names = ["01_P01_20231111_09_31_43_25", "02_P01_20231111_09_31_43_25", "08_P02_20231111_09_31_43_25"]
    audit = rows([(n, n[3:6], "stale", "", f"d/{n}.wav", C.NO_FEATURES, 0, "") for n in names], schema)
    splits = rows([("P01", "train")], "subject_id string, split string")
    none, index = rows([("z", "", 1.0, "", "")], FACT), rows([("q", "q.npz", "ok")], INDEX)
    got = {r["sample_id"]: r for r in jobs.build_audio_6c(audit, splits, index, none).collect()}
    assert set(got) == {names[0], names[2]} and got[names[2]]["label_id"] == 5 and got[names[2]]["split"] == ""
    assert got[names[0]]["session_id"] == "P01_20231111_0931_43" and got[names[0]]["source_file"] == f'["d/{names[0]}.wav"]'
    with pytest.raises(Exception, match="no split for subject P02"):
        jobs.build_video_6c(audit, splits, index, none).collect()
