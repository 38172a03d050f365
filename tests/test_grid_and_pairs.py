import pytest
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.functions import ids
from tidegrid.operators import coverage, grid, intervals, jobs, ordering, pairing
from tidegrid.plans.guards import ContractError

WINDOW = ("row_no long, sample_id string, parent_id string, subject_id string, session_id string, split string, window_index int, "
          "window_start_ms long, window_end_ms long, duration_ms long, label_start_ms long, label_end_ms long, kss_score double, "
          "label_class string, label_id int, valid boolean, qc_reason_codes array<string>")


def window(index, parent=0, subject="D", split="train", valid=True, codes=(), score=6.5, row=None):
    start = parent * 240_000 + index * 30_000
    label = 0 if score < 4 else 1 if score < 7 else 2
    return (row if row is not None else parent * 8 + index, f"{subject}-{start}", f"{subject}-p{parent}", subject, f"{subject}_A", split, index, start, start + 30_000,
            30_000, parent * 240_000, parent * 240_000 + 240_000, score, C.FATIGUE_CLASSES[label], label, valid, list(codes))


def test_parent_with_one_invalid_window(rows):
    data = [window(i, valid=i < 7, codes=() if i < 7 else ("B", "A")) for i in range(8)]
    got = grid.parent_manifest(rows(data, WINDOW)).first()
    assert (got["window_count"], got["valid_window_count"], got["complete_for_240s"]) == (8, 7, False)
    assert got["qc_reason_codes"] == ["A", "B"] and got["subject_id"] == "D"


def test_known_codes_are_merged_as_bits(rows):
    data = [window(i, parent=p, codes=[c for k, c in enumerate(C.WINDOW_REASONS) if (i * 7 + p) % (k + 3) == 0] * (1 + i % 2))
            for p in range(9) for i in range(8)]
    data.append((*window(0, parent=20)[:-1], None))
    plain, bits = (grid.parent_manifest(rows(data, WINDOW), known=k) for k in (None, C.WINDOW_REASONS))
    assert sorted(plain.collect(), key=str) == sorted(bits.collect(), key=str)
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
    for codes in (["OTHER"], [C.UNUSABLE_GAP, "OTHER"], [None]):
        with pytest.raises(Exception, match="code outside the list"):
            grid.parent_manifest(rows([window(0, codes=codes)], WINDOW), known=C.WINDOW_REASONS).collect()


def test_windows_without_a_parent_are_counted(rows):
    lost = window(3)
    got = grid.parent_manifest(rows([window(0), (*lost[:2], None, *lost[3:])], WINDOW))
    assert {(r["parent_id"], r["subject_id"], r["window_count"]) for r in got.collect()} == {("D-p0", "D", 1), (None, None, 1)}


@pytest.mark.parametrize("indices,complete", [
    (range(8), True), (range(7), False), ([0, 1, 2, 3, 4, 5, 6, 6], False), ([0, 1, 2, 3, 4, 5, 6, 8], False), ([*range(8), 7], False)])
def test_index_set(rows, indices, complete):
    data = [window(i, row=n) for n, i in enumerate(indices)]
    assert grid.parent_manifest(rows(data, WINDOW)).first()["complete_for_240s"] is complete


def test_split_freeze(rows):
    data = [window(i) for i in range(8)] + [window(0, parent=1, valid=False, codes=("CLOCK",))] + [
        window(0, subject="A", split="val"), window(0, subject="C", split="test")]
    text = rows(data, WINDOW).withColumns({
        "qc_status": F.when(F.col("valid"), "PASS").otherwise("PENDING"), "error": F.array_join("qc_reason_codes", ";"),
        "feature_path": F.lit("f/a.npz")}).withColumns({
            "qc_reason_codes": F.col("error"), "valid": F.col("valid").cast("string"), "label_id": F.col("label_id").cast("string"),
            "kss_score": F.col("kss_score").cast("string"), "window_index": F.col("window_index").cast("string")})
    valid, excluded, parents, summary = jobs.freeze_splits(text)
    assert (valid.count(), excluded.count(), parents.count()) == (10, 1, 1)
    by = {r["split"]: r for r in summary.collect()}
    assert by["train"]["candidate_windows"] == 9 and by["val"]["complete_parents"] == 0
    with pytest.raises(ContractError):
        jobs.freeze_splits(text.withColumn("split", F.lit("val")))


def test_stride_and_full_grid(rows):
    whole = [window(i % 8, i // 8) for i in range(80)]
    good, gap = rows(whole, WINDOW), rows(whole[:5] + whole[6:], WINDOW)
    check = lambda df: grid.stride_check(df, ["session_id"]).first()["regular"]
    full = lambda df: grid.full_grid_check(df, ["session_id"]).first()["full_grid"]
    assert (check(good), full(good)) == (True, True)
    assert (check(gap), full(gap)) == (False, False)
    assert full(rows(whole[:79] + whole[78:79], WINDOW)) is False
    # a copy of a start does not break the stride, but it breaks the full grid
    assert (check(rows(whole + whole[:1], WINDOW)), full(rows(whole + whole[:1], WINDOW))) == (True, False)


def test_window_rules(rows):
    codes = lambda w: rows([w], WINDOW).select(grid.window_rule_codes().alias("c")).first()["c"]
    good = list(window(2, 1))
    assert codes(tuple(good)) == []
    wrong = good.copy()
    wrong[6] = 3
    assert codes(tuple(wrong)) == ["window_index"]
    late = good.copy()
    late[10], late[11] = 0, 240_000
    assert codes(tuple(late)) == ["outside_parent", "window_index"]


def pair_rows(rows, data):
    return rows(data, WINDOW).withColumn("paired_valid", F.col("valid")).withColumn("paired_sample_id", ids.pair_id(
        F.col("subject_id"), F.col("session_id"), F.col("window_start_ms"), F.col("window_end_ms")))


def test_complete_parents(rows):
    data = [window(i) for i in range(8)] + [window(i, 1) for i in range(7)] + [window(i, 2, valid=i != 3) for i in range(8)]
    data += [window(i, 3, score=6.5 if i else 2.0) for i in range(8)]
    pairs = pair_rows(rows, data)
    parents = grid.complete_parents(pairs)
    got = parents.collect()
    assert len(got) == 1 and got[0]["parent_id"] == "ULDD_D_A_000000000_000240000"
    assert got[0]["paired_sample_ids"] == [f"ULDD_D_A_{i * 30000:09d}_{i * 30000 + 30000:09d}" for i in range(8)]
    reasons = {r["complete8_exclude_reason"]: r["n"] for r in grid.mark_eligible(pairs, parents).groupBy(
        "complete8_exclude_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert reasons == {"": 8, "incomplete_240s_parent": 22, "pair_invalid": 1}


def test_restrict_to_complete(rows):
    data = [window(i) for i in range(8)] + [window(i, 1) for i in range(3)] + [window(i, 2, score=2.0 if i else 8.0) for i in range(8)]
    listed = rows([("D-p0",), ("D-p1",), ("D-p2",), ("D-p9",)], "parent_id string")
    kept, problems = grid.restrict_to_complete(rows(data, WINDOW), listed)
    assert kept.count() == 19
    assert {r["parent_id"]: r["code"] for r in problems.collect()} == {"D-p1": "window_indices", "D-p2": "labels", "D-p9": "missing"}


def test_pairing_explains_every_row(rows):
    video = [window(0), window(1), window(2), window(3), window(4, valid=False), window(5)]
    right = [window(0), window(1, score=3.0), window(2, valid=False), window(4), window(5, split="val")]
    sync = rows([("D", "D_A", C.SYNC_ALIGNED)], "subject_id string, session_id string, sync_status string")
    out = pairing.pair_modalities(rows(video, WINDOW), rows(right, WINDOW).drop("parent_id"), sync)
    got = {r["window_index"]: (r["exclude_reason"], r["paired_valid"]) for r in out.collect()}
    assert got == {
        0: ("", True), 1: ("label_mismatch_kss_score;label_mismatch_label_class;label_mismatch_label_id", False), 2: ("can_invalid", False),
        3: ("can_missing_or_invalid", False), 4: ("video_invalid", False), 5: ("label_mismatch_split", False)}
    unsure = pairing.pair_modalities(rows(video[:1], WINDOW), rows(right[:1], WINDOW).drop("parent_id"), sync.where("1 = 0")).first()
    assert unsure["exclude_reason"] == "sync_unverified"


def test_sync_audit(rows):
    key = "subject_id string, session_id string"
    sessions = rows([("D", "D_A", 36_000), ("F", "F_A", 36_000), ("G", "G_A", 36_000), ("J", "J_A", 36_000)], f"{key}, source_rows long")
    videos = rows([("D", "D_A", 600.05), ("F", "F_A", 600.2), ("G", "G_A", 600.0), ("G", "G_A", 600.0)], f"{key}, video_duration_s double")
    got = {r["session_id"]: (r["sync_status"], r["offset_ms"]) for r in intervals.sync_audit(sessions, videos, ["subject_id", "session_id"]).collect()}
    assert got == {"D_A": (C.SYNC_ALIGNED, 0), "F_A": (C.SYNC_MISMATCH, None), "G_A": (C.SYNC_NO_VIDEO, None), "J_A": (C.SYNC_NO_VIDEO, None)}


META = "row_no long, sample_id string, label_id string, label_class string, label_scheme string, split string, subject_id string, session_id string, source_file string"


def meta(sample="a", row=2, label="1", scheme="s", split="train", subject="P01", session="x", source='["d/a.wav"]'):
    return (row, sample, label, f"c{label}", scheme, split, subject, session, source)


@pytest.mark.parametrize("right,strict,lenient", [
    (meta(source='["a.mp4"]'), [], []), (meta(label="2"), ["label_mismatch"], ["label_mismatch"]), (meta(scheme=""), ["label_scheme_mismatch"], []),
    (meta(split="val"), ["split_mismatch"], ["split_mismatch"]), (meta(session=""), ["session_mismatch"], []), (meta(session="y"), ["session_mismatch"], ["session_mismatch"]),
    (meta(source=""), ["source_mismatch"], []), (meta(source="b.mp4"), ["source_mismatch"], ["source_mismatch"]), (meta(sample="b"), None, None)])
def test_pair_checks(rows, right, strict, lenient):
    left, other = rows([meta()], META), rows([right], META)
    got = {s: [r["codes"] for r in pairing.pair_check_rows(left, other, strict=s).orderBy("sample_id").collect()] for s in (True, False)}
    if strict is None:
        assert got[True] == [["only_left"], ["only_right"]] == got[False]
    else:
        assert got == {True: [strict], False: [lenient]}


def test_which_copy_counts(rows):
    left = rows([meta(row=2), meta(row=3, label="2")], META)
    right = rows([meta()], META)
    assert pairing.pair_check_rows(left, right).first()["codes"] == ["duplicate_left"]
    assert pairing.pair_check_rows(left, right, strict=False).first()["codes"] == ["duplicate_left", "label_mismatch"]
    report = pairing.pair_check_report(rows([meta(sample=""), meta()], META), right).first()
    assert report["status"] == "FAIL" and report["left_empty_ids"] == 1 and report["common_samples"] == 1


def test_inventory(rows):
    recorded = rows([("a", 1, "x"), ("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w")], "path string, size_bytes long, sha256 string")
    actual = rows([("a", 1, "x"), ("b", 3, "y"), ("c", 3, "q"), ("e", 5, "v")], "path string, size_bytes long, sha256 string")
    got = {r["path"]: r["codes"] for r in pairing.inventory_diff(recorded, actual).collect()}
    assert got == {"a": ["duplicate_record"], "b": ["size_mismatch"], "c": ["hash_mismatch"], "d": ["missing_file"], "e": ["unrecorded_file"]}


def test_label_sources(rows):
    schema = "session_id string, label_index int, kss_score double"
    sheet = rows([("a", i, 5.0) for i in range(3)] + [("b", 0, 4.0), ("c", 0, 4.0)], schema)
    files = rows([("a", i, 5.0) for i in range(3)] + [("b", 0, 4.5), ("z", 0, 1.0)], schema)
    got = {r["session_id"]: r["code"] for r in pairing.label_source_agreement(sheet, files).collect()}
    assert got == {"a": "", "b": "differs", "c": "missing"}


def test_split_assignment(rows):
    clips = rows([("P01",), ("P02",)], "subject_id string")
    splits = rows([("P01", "train")], "subject_id string, split string")
    assert {r["subject_id"]: r["split"] for r in pairing.assign_split(clips, splits).collect()} == {"P01": "train", "P02": ""}
    with pytest.raises(Exception, match="no split for subject P02"):
        pairing.assign_split(clips, splits, strict=True).collect()


W30 = "sample_id string, subject_id string, session_id string, split string, window_start_ms long, window_end_ms long, label_start_ms long, label_end_ms long, kss_score double, label_class string, label_id int, valid boolean, video_subwindow_ids string"
C5 = "sample_id string, subject_id string, session_id string, split string, window_start_ms long, window_end_ms long, label_start_ms long, label_end_ms long, kss_score double, label_class string, label_id int, valid boolean, feature_path string, feature_sha256 string"
F30 = "sample_id string, relative_path string, feature_shape string, feature_dtype string, feature_sha256 string, video_subwindow_ids string"


def source():
    sid = "video30__D_A__0000000000_0000030000"
    kids = [f"video5__D_A_IR_{i * 5_000_000:013d}_{(i + 1) * 5_000_000:013d}" for i in range(6)]
    shared = ("D", "D_A", "train")
    label = (0, 240_000, 6.5, "medium", 1)
    windows = [(sid, *shared, 0, 30_000, *label, True, "|".join(kids))]
    features = [(sid, f"features_30s/{sid}.npz", "[6,96]", "float32", "h", "|".join(kids))]
    children = [(k, *shared, i * 5000, i * 5000 + 5000, *label, True, f"features_30s/{sid}.npz", "h") for i, k in enumerate(kids)]
    return windows, features, children


@pytest.mark.parametrize("change,codes", [
    (None, []), (("children", 2, None), ["source_5s_missing_2"]), (("children", 1, (3, "val")), ["source_5s_split_1"]),
    (("children", 5, (4, 25_001)), ["source_5s_time_5"]), (("children", 0, (11, False)), ["source_5s_invalid_0"]),
    (("children", 3, (13, "z")), ["source_5s_feature_hash_3"]), (("features", 0, (2, "[6,97]")), ["source_feature_shape_or_dtype"])])
def test_child_binding(rows, change, codes):
    tables = dict(zip(("windows", "features", "children"), source()))
    if change:
        name, index, edit = change
        row = tables[name].pop(index)
        if edit:
            row = list(row)
            row[edit[0]] = edit[1]
            tables[name].insert(index, tuple(row))
    out = pairing.child_binding(rows(tables["windows"], W30), rows(tables["features"], F30), rows(tables["children"], C5))
    assert out.first()["codes"] == codes


def test_reversed_children(rows):
    windows, features, children = source()
    back = "|".join(reversed(windows[0][-1].split("|")))
    windows[0] = (*windows[0][:-1], back)
    out = pairing.child_binding(rows(windows, W30), rows(features, F30), rows(children, C5)).first()["codes"]
    assert out == ["source_5s_order_or_identity", "source_feature_subwindow_ids"]


def test_rows_of_neighbouring_windows_travel_together(rows):
    """Joins are dealt by a number that neighbours share, and lists of children stay out of the shuffle."""
    windows, features, children = source()
    out = pairing.child_binding(rows(windows, W30), rows(features, F30), rows(children, C5))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sides = [line for line in plan.splitlines() if "Join LeftOuter" in line and "__near_" in line]
    assert len(sides) >= 2 and all(">=" in line and "<=" in line for line in sides)
    near = rows([(c[0],) for c in children] + [("odd",), ("odd_x_y",), (None,)], "id string").select("id", pairing._near(F.col("id"), pairing._WINDOW).alias("n")).collect()
    near = {r.id: r.n for r in near}
    assert len({near[c[0]] for c in children}) == 1 and len(set(near.values()) - {None}) == 3 and near[None] is None


def test_ids_that_repeat_are_odd_or_null_meet_as_equal_ids_do(rows):
    ids_ = ["video30__D_A__0000000000_0000030000", "video30__D_A__0000030000_0000060000", "odd", "odd_1_2", "odd_1_3", "odd", None, "_", ""]
    left, right = rows([(x, i) for i, x in enumerate(ids_)], "id string, i int"), rows([(x, i) for i, x in enumerate([*ids_, "more"])], "r string, j int")
    got = {(r.i, r.j) for r in pairing._by_id(left, right, "id", "r", 240_000).collect()}
    assert got == {(r.i, r.j) for r in left.join(right, F.col("id") == F.col("r"), "left").collect()}


def test_short_lists_of_children_differ_as_the_lists_do(rows):
    windows, _, _ = source()
    sid, kids = windows[0][0], windows[0][-1]
    lists = [kids, "=", "!" + kids, "!=", "", None, kids[1:]]
    got = {r.k: r.s for r in rows([(x, sid) for x in lists], "k string, id string").select("k", pairing._short(F.col("k"), F.col("id")).alias("s")).collect()}
    assert got[kids] == "=" and got[None] is None and len(set(got.values())) == len(lists)


def test_union_refuses_test_rows(rows):
    a = rows([("train",)], "split string")
    assert pairing.union_splits(a, rows([("val",)], "split string")).count() == 2
    with pytest.raises(ContractError):
        pairing.union_splits(a, rows([("test",)], "split string"))


def test_partition_valid(rows):
    schema = "sample_id string, valid string, error string, feature_path string"
    usable, rejected = ordering.partition_valid(rows([("a", "1", "", "f"), ("b", "false", "", ""), ("c", "0", "gap", "")], schema))
    assert usable.count() == 1 and {r["error"] for r in rejected.collect()} == {"INVALID_WITHOUT_ERROR", "gap"}
    for bad in (("a", "true", "gap", "f"), ("a", "true", "", " ")):
        with pytest.raises(ContractError):
            ordering.partition_valid(rows([bad], schema))


def test_examples_and_first_n(rows):
    df = rows([("x", f"s{i:02d}") for i in range(30)] + [("y", "q")], "code string, sample string")
    got = {r["code"]: (r["n"], r["examples"]) for r in ordering.examples(df, "code", "sample", 3).collect()}
    assert got == {"x": (30, ["s00", "s01", "s02"]), "y": (1, ["q"])}
    with pytest.raises(ContractError):
        ordering.require_n(ordering.first_n_eligible(df, F.col("code") == "y", ["sample"], 5), 5)


def test_frozen_counts(rows):
    df = coverage.dataset_coverage(rows([window(i) for i in range(8)], WINDOW))
    coverage.assert_expected_counts(df, {"windows": 8, "parents": 1, "class_medium": 8, "class_low": 0})
    with pytest.raises(ContractError):
        coverage.assert_expected_counts(df, {"windows": 9})


def test_subject_table_keeps_absent_subjects(rows):
    got = {r["subject_id"]: r for r in coverage.subject_table(rows([window(0), window(1, valid=False)], WINDOW)).collect()}
    assert len(got) == 16 and got["D"]["valid_window_count"] == 1 and got["A"]["window_count"] == 0 and got["A"]["split"] == "val"


def test_interval_union(rows):
    data = [("a", 0.0, 2.0), ("a", 2.0, 3.0), ("a", 1.0, 1.5), ("a", 5.0, 6.0), ("a", 5.0, 5.5), ("b", 1.0, 4.0)]
    for length in (1, 2, 100):
        out = intervals.covered_length(rows(data, "k string, s double, e double"), ["k"], "s", "e", length)
        assert {r["k"]: r["covered"] for r in out.collect()} == {"a": 4.0, "b": 3.0}
