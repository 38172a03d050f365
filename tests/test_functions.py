import math

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import ids, numeric, parsing, text


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cols).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("score,label,name", [
    (1.0, 0, "low"), (3.9, 0, "low"), (4.0, 1, "medium"), (6.5, 1, "medium"), (7.0, 2, "high"), (9.0, 2, "high"),
    (0.9, None, None), (9.1, None, None), (math.nan, None, None), (math.inf, None, None)])
def test_kss_limits(spark, score, label, name):
    assert one(spark, ids.kss_label_id(F.col("s")), s=score) == label
    assert one(spark, ids.kss_label_class(F.col("s")), s=score) == name


@pytest.mark.parametrize("name,stem", [
    ("01_P01_20231111_09_31_43_25.wav", "01_P01_20231111_09_31_43_25"),
    ("set\\a/09_P40_20231111_09_31_43_1.WAV", "09_P40_20231111_09_31_43_1"),
    ("10_P01_20231111_09_31_43_25.wav", None), ("01_P41_20231111_09_31_43_25.wav", None),
    ("01_P00_20231111_09_31_43_25.wav", None), ("01_P01_20231111_09_31_25.wav", None),
    ("01_p01_20231111_09_31_43_25.wav", None), ("notes.txt", None)])
def test_clip_names(spark, name, stem):
    got = one(spark, ids.parse_clip_name(F.col("n")), n=name)
    assert (got["stem"] if got else None) == stem


def test_clip_name_parts(spark):
    got = one(spark, ids.parse_clip_name(F.col("n")), n="x/05_P07_20231111_09_31_43_125.Wav")
    assert got.asDict() == {
        "task_code": 5, "subject_id": "P07", "date": "20231111", "start_hhmmss": "093143",
        "takeover_decisec": 125, "stem": "05_P07_20231111_09_31_43_125", "extension": "wav"}
    session = ids.clip_session_id(F.lit("P07"), F.lit("20231111"), F.lit("093143"))
    assert one(spark, session) == "P07_20231111_0931_43"


@pytest.mark.parametrize("name,ok", [
    ("01_P01_20231111_09_31_43_25.MP4", True), ("08_P01_20231111_09_31_43_25.mov", True),
    ("02_P01_20231111_09_31_43_25.mp4", False), ("01_P01_20231111_09_31_43_25.wav", False),
    ("01_P01_20231111_09_31_43_25.mp4\n", False)])
def test_video_names(spark, name, ok):
    assert (one(spark, ids.parse_video_clip_name(F.col("n")), n=name) is not None) == ok


def test_six_classes(spark):
    got = [one(spark, ids.six_class_id(F.lit(t))) for t in range(1, 10)]
    assert got == [0, None, 1, 2, 3, None, 4, 5, None]


def test_identifiers(spark):
    assert one(spark, ids.pair_id(F.lit("D"), F.lit("D_A"), F.lit(60000), F.lit(90000))) == "ULDD_D_A_000060000_000090000"
    assert one(spark, ids.video_window_id(F.lit("D_A"), F.lit(0), F.lit(30000))) == "video30__D_A__0000000000_0000030000"
    children = one(spark, ids.video_child_ids(F.lit("D_A"), F.lit(30000)))
    assert len(children) == 6 and children[1] == "video5__D_A_IR_0000035000000_0000040000000"


@pytest.mark.parametrize("value,want", [
    (" TRUE ", True), ("1", True), ("false", False), ("0", False), ("yes", None), ("", None), ("t", None)])
def test_strict_bool(spark, value, want):
    assert one(spark, parsing.strict_bool(F.col("v")), v=value) is want


@pytest.mark.parametrize("value,want", [("12", 12), ("-3", -3), ("+3", None), (" 3", None), ("3.0", None), ("3\n", None), ("", None)])
def test_strict_int(spark, value, want):
    assert one(spark, parsing.strict_int(F.col("v")), v=value) == want


@pytest.mark.parametrize("value,want", [
    ("a/b.npz", True), ("/a", False), ("C:/a", False), ("\\\\h\\s", False), ("a/../b", False), ("a\\..\\b", False), ("", False), ("a..b", True)])
def test_paths(spark, value, want):
    assert one(spark, parsing.is_safe_relative_path(F.col("v")), v=value) is want


@pytest.mark.parametrize("value,want", [
    ("[6,96]", [6, 96]), ("[ 6 , 96 ]", [6, 96]), ("[6]", None), ("[0,9]", None), ("[6.0,9]", None), ("[true,9]", None), ("6,9", None), ("{}", None)])
def test_shapes(spark, value, want):
    assert one(spark, parsing.positive_shape(F.col("v")), v=value) == want


@pytest.mark.parametrize("value,want", [("a/b.npz::valid_mask", "a/b.npz"), ("a::b::valid_mask", "a::b"), ("a::mask", None), ("a", None)])
def test_mask_reference(spark, value, want):
    assert one(spark, parsing.mask_path(F.col("v")), v=value) == want


def test_source_stems(spark):
    assert one(spark, parsing.source_stems(F.col("v")), v='["a\\\\b.c.wav", "d/e", ""]') == ["b.c", "e"]
    assert one(spark, parsing.source_stems(F.col("v")), v="x/y.mp4") == ["y"]


def test_argmax_takes_the_first_maximum(spark):
    p = F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    assert one(spark, numeric.argmax(p)) == 0


@pytest.mark.parametrize("p,ok,strict", [
    ([0.2, 0.3, 0.5], True, True), ([0.2, 0.3], False, False), ([-0.1, 0.6, 0.5], False, False),
    ([math.nan, 0.5, 0.5], False, False), ([0.2, 0.3, 0.500005], True, False)])
def test_probabilities(spark, p, ok, strict):
    col = F.array(*[F.lit(v) for v in p])
    assert one(spark, numeric.valid_probabilities(col, 3)) is ok
    assert one(spark, numeric.valid_probabilities(col, 3, 1e-6, cap_at_one=True)) is strict


@pytest.mark.parametrize("value,want", [
    ('{"a": 1}', True), ("[1, 2]", True), ("3", True), ('{"a": 1},', False), ("1, 2", False), ("1] x", False), ("", False), ("{", False)])
def test_json(spark, value, want):
    assert one(spark, text.is_json(F.col("v")), v=value) is want


def test_text_policy(spark):
    codes = lambda v, j=False: one(spark, text.text_policy_codes(F.col("v"), F.lit(j), 200), v=v)
    assert codes("see C:\\data\\x and /home/someone/y") == ["machine_path"]
    assert codes("abcC:\\data") == []
    assert codes("key ghp_" + "a" * 20) == ["access_token"]
    assert codes("-----BEGIN RSA PRIVATE KEY-----") == ["access_token"]
    assert codes("{", True) == ["invalid_json"]
    assert codes("/home/a/b " * 30) == ["oversize", "machine_path"]
    assert codes("{" + " " * 300, True) == ["oversize", "invalid_json"]
    # a finding at the very end of a long text counts too
    assert codes("x" * 150 + " /Users/me/f") == ["machine_path"]
