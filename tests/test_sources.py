import csv
import hashlib
import io
import json
import random
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid import constants as C
from tidegrid.operators import clips
from tidegrid.operators import features as B
from tidegrid.operators import telemetry as T
from tidegrid.plans.guards import ContractError
from tidegrid.session import shared_folder, stage
from tidegrid.sources import files, records, sinks, tables


def test_manifest_with_mark_blank_and_short_lines(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("﻿sample_id,shape,error\na,\"[6,96]\",\nb,\"say \"\"hi\"\"\",x\nshort\nc,[1],y,extra\n".encode())
    got = tables.read_manifest(spark, str(path), ["sample_id", "error"]).orderBy("row_no").collect()
    assert [(r["row_no"], r["sample_id"], r["malformed"]) for r in got] == [(2, "a", False), (3, "b", False), (4, "short", True), (5, "c", True)]
    assert got[0]["shape"] == "[6,96]" and got[0]["error"] == "" and got[1]["shape"] == 'say "hi"'
    with pytest.raises(ContractError, match="MISSING_COLUMNS"):
        tables.read_manifest(spark, str(path), ["label"])
    (tmp_path / "d.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ContractError, match="DUPLICATE_COLUMNS"):
        tables.read_manifest(spark, str(tmp_path / "d.csv"))


def test_line_numbers_follow_the_file_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("k,pad\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = tables.read_manifest(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
        assert df.where(F.col("row_no") != F.col("k").cast("long") + 2).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def python_records(path):
    """(record number, fields) of Python's strict reader, the header being record 1."""
    with open(path, encoding="utf-8-sig", newline="") as stream:
        return list(enumerate((r for r in csv.reader(stream, strict=True) if r), start=1))


@pytest.mark.parametrize("seed", range(3))
def test_records_with_line_breaks_over_many_splits_are_those_of_python(spark, tmp_path, seed):
    rng = random.Random(seed)

    def field():
        text = "".join(rng.choice(['a', 'b "', '"', ',', '\n', '\n\n', '\r\n', ' é', 'line', '","', '"\n"']) for _ in range(rng.randrange(6)))
        if rng.random() < 0.2:
            return 'un"quo"ted' + rng.choice(["", '"'])
        return '"' + text.replace('"', '""') + '"' if set(text) & set('",\n\r') or rng.random() < 0.2 else text

    end = ["\n", "\r\n"][seed % 2]
    files_ = []
    for k in range(2):
        path = tmp_path / f"part-{k}.csv"
        body = "".join(",".join([str(i), field(), field()]) + end + (end if rng.random() < 0.05 else "") for i in range(2500))
        path.write_bytes(("\ufeff" * (k == 0) + f"k,x,y{end}" + body).encode())
        files_.append(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = tables.read_manifest(spark, str(tmp_path), ["k"])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = sorted((r.row_no, r.k, r.x, r.y, r.malformed) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((n, *fields, False) for path in files_ for n, fields in python_records(path) if n > 1)
    assert any("\n" in r[2] for r in want)
    assert rows == want


def test_a_record_may_reach_over_several_splits(spark, tmp_path):
    long = "\n".join(f"line {i}, with \"quotes\"" for i in range(800))
    path = tmp_path / "m.csv"
    with open(path, "w", newline="") as stream:
        csv.writer(stream).writerows([["k", "note"], ["a", "1"], ["b", long], ["c", "two\nlines"], ["d", ""]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = tables.read_manifest(spark, str(path)).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_no, r.k, r.note) for r in rows] == [(2, "a", "1"), (3, "b", long), (4, "c", "two\nlines"), (5, "d", "")]


@pytest.mark.parametrize("body", ['a,"open\nb,2\n', 'a,"closed" and on\n', 'a,b"\n"x"y,1\n'])
def test_bad_quotes_stop_the_read(spark, tmp_path, body):
    path = tmp_path / "m.csv"
    path.write_text("k,x\n" + body)
    with pytest.raises(csv.Error):
        python_records(path)
    with pytest.raises(Exception, match="bad quotes"):
        tables.read_manifest(spark, str(path)).collect()


def test_text_that_is_no_utf8_stops_the_read(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes(b"k,x\na,\xff\xfe\n")
    with pytest.raises(Exception, match="UTF"):
        tables.read_manifest(spark, str(path)).collect()


@pytest.mark.parametrize("text", ["k,x\n", "k,x", "k,x\n\n\n", '"k","x"\r\n\r\n'])
def test_a_table_without_records_stops_the_read(spark, tmp_path, text):
    path = tmp_path / "m.csv"
    path.write_text(text, newline="")
    with pytest.raises(ContractError, match="empty"):
        tables.read_manifest(spark, str(path))
    path.write_text("")
    with pytest.raises(ContractError, match="no header"):
        tables.read_manifest(spark, str(path))


def test_lines_stay_in_the_tasks_that_read_them(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("k,x\n" + "".join(f'{i},"two\nlines"\n' for i in range(50)))
    table = tables.read_manifest(spark, str(path))
    assert table.where("malformed").count() == 0 and table.count() == 50
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "__line" not in plan


def test_compressed_tables_are_read_back(spark, rows, tmp_path):
    df = rows([(i, f'{i}\n"x"' if i % 3 else "") for i in range(200)], "k int, note string")
    path = sinks.write_csv(df, str(tmp_path / "out"), "gzip")
    assert list((tmp_path / "out").glob("*.csv.gz")) and not list((tmp_path / "out").glob("*.csv"))
    back = tables.read_manifest(spark, path, ["k", "note"], numbered=False)
    assert sorted((int(r.k), r.note, r.malformed) for r in back.collect()) == [(i, f'{i}\n"x"' if i % 3 else "", False) for i in range(200)]


def test_compressed_files_hold_a_bounded_number_of_records(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_RECORDS", 30)
    path = sinks.write_csv(rows([(i, f"{i}\nx") for i in range(200)], "k int, note string").coalesce(1), str(tmp_path / "out"), "gzip")
    assert len(list((tmp_path / "out").glob("*.csv.gz"))) == 7
    back = tables.read_manifest(spark, path, ["k", "note"])
    assert sorted((int(r.k), r.note) for r in back.collect()) == [(i, f"{i}\nx") for i in range(200)]
    assert {r.row_no for r in back.collect()} == set(range(2, 32))


def test_the_video_hand_off_is_written_compressed(spark, rows, tmp_path, monkeypatch):
    from workload import exchange

    rows([(i, 100.0 * i) for i in range(1, 101)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(exchange, "shared_folder", lambda spark, label: str(tmp_path / label))
    found = {r.source: (r.n, r.ids) for r in exchange.read_video_source(spark, str(tmp_path)).collect()}
    assert found == {"windows30": (100, 100), "windows5": (598, 598), "features": (98, 98)}
    files = [p.name for p in (tmp_path / "video").rglob("part-*")]
    assert files and all(name.endswith(".csv.gz") for name in files)


def test_a_record_that_grows_too_long_comes_in_pieces(monkeypatch):
    monkeypatch.setattr(records, "RECORD_LIMIT", 40)
    lines = [b'1,"open', *[b"0123456789"] * 20, b'end",z', b"2,b"]
    flags = [(line.count(b'"') == 1, line.count(b'"') == 0) for line in lines]

    def batches():
        for at in range(0, len(lines), 3):
            n = len(lines[at: at + 3])
            yield pa.RecordBatch.from_arrays([
                pa.array(["f"] * n), pa.array([0] * n), pa.array([o for o, _ in flags[at: at + 3]]), pa.array([s for _, s in flags[at: at + 3]]),
                pa.array([False] * n), pa.array([False] * n), pa.array([0] * n), pa.array(lines[at: at + 3], pa.binary())],
                names=["__file", "__block", "__opens", "__stays", "__blank", "__quoted", "__records", "value"])

    whole = [r for b in records._gather(True)(batches()) for r in b.to_pylist()]
    pieces = [r for b in records._gather(False)(batches()) for r in b.to_pylist()]
    assert [(r["record_no"], r["record"]) for r in whole] == [(2, b"2,b")]
    assert {r["record_no"] for r in pieces} == {1} and [r["__piece"] for r in pieces] == list(range(len(pieces)))
    assert b"\n".join(r["record"] for r in pieces) == b"\n".join(lines[:-1]) and max(len(r["record"]) for r in pieces) < 80


def test_a_header_with_a_line_break(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('k,"two\nlines"\n1,2\n')
    (row,) = tables.read_manifest(spark, str(path)).collect()
    assert row["two\nlines"] == "2" and row.row_no == 2


def telemetry_file(folder, name, stamps):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [",".join(C.TELEMETRY_HEADER)] + [f"{us},0,0,0,{i},1,2,3,4,5" for i, us in enumerate(stamps)]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_telemetry_files(spark, tmp_path):
    telemetry_file(tmp_path / "D" / "A", "D_Telemetry_A.csv", range(0, 500_000, 16_666))
    telemetry_file(tmp_path / "F" / "D", "F_Telemetry_D.csv", [5, 15, 25, 3_000_000])
    telemetry_file(tmp_path / "F" / "D", "F_Notes_D.csv", [1])
    df = tables.read_telemetry(spark, str(tmp_path))
    assert df.where("session_id = 'D_A' and heading_deg <> row_no").count() == 0
    audit = {r["session_id"]: r for r in T.clock_audit(df).collect()}
    assert set(audit) == {"D_A", "F_D"} and audit["F_D"]["first_anomaly_row"] == 4 and audit["D_A"]["source_rows"] == 31
    assert tables.telemetry_source_problems(df).count() == 0
    telemetry_file(tmp_path / "copy", "D_Telemetry_A.csv", [0, 1])
    again = tables.read_telemetry(spark, str(tmp_path))
    assert [(r["session_id"], r["code"]) for r in tables.telemetry_source_problems(again).collect()] == [("D_A", "duplicate_session")]


def test_wrong_telemetry_header_is_refused(spark, tmp_path):
    (tmp_path / "D_Telemetry_A.csv").write_text("a,b,c,d,e,f,g,h,i,j\n1,2,3,4,5,6,7,8,9,10\n")
    with pytest.raises(Exception, match="header"):
        tables.read_telemetry(spark, str(tmp_path)).collect()


def test_label_sheet(spark, tmp_path):
    path = tmp_path / "Labels.csv"
    path.write_text("D_Alert," + ",".join("3.5" for _ in range(10)) + "\nD_Drowsy," + ",".join(str(i % 9 + 1) for i in range(10)) + "\n")
    got = {(r["session_id"], r["label_index"]): r["kss_score"] for r in tables.read_label_sheet(spark, str(path)).collect()}
    assert len(got) == 20 and got["D_A", 0] == 3.5 and got["D_D", 9] == 1.0
    for bad in ("D_Tired,1,1,1,1,1,1,1,1,1,1\n", "D_Alert,1,1,1\n", "D_Alert,0.5,1,1,1,1,1,1,1,1,1\n", "D_Alert,1,1,1,1,1,1,1,1,1,1\n" * 2):
        path.write_text(bad)
        with pytest.raises(ContractError):
            tables.read_label_sheet(spark, str(path))


def test_feature_index(spark, tmp_path):
    path = tmp_path / "i.jsonl"
    good = {"sample_id": "a", "path": "f\\a.npz", "status": "ok", "T": 5, "D": 2048}
    path.write_text(json.dumps(good) + "\n\n")
    assert tables.read_feature_index(spark, str(path)).first()["path"] == "f/a.npz"
    for change in ({"sample_id": ""}, {"path": "../a.npz"}, {"path": "a.bin"}, {"status": ""}, {"T": 0}, {"D": -1}):
        path.write_text(json.dumps(good | change) + "\n")
        with pytest.raises(ContractError):
            tables.read_feature_index(spark, str(path))
    path.write_text((json.dumps(good) + "\n") * 2)
    with pytest.raises(ContractError):
        tables.read_feature_index(spark, str(path))
    path.write_text(json.dumps({"sample_id": "a", "path": "processed/x.npz"}) + "\n" + json.dumps({"sample_id": "a", "path": "y.npz"}) + "\n")
    assert tables.read_feature_index_lenient(spark, str(path)).first()["path"] == "y.npz"


def npz(path, **change):
    arrays = {"x": np.arange(24, dtype=np.float32).reshape(6, 4), "time_s": (np.arange(6) + 0.5) * 5.0, "valid_mask": np.ones(6, bool),
              "support_s": np.column_stack((np.arange(6) * 5.0, np.arange(6) * 5.0 + 5)), "observed_fraction": np.ones(6, np.float32)} | change
    path.parent.mkdir(parents=True, exist_ok=True)
    np.savez_compressed(path, **{k: v for k, v in arrays.items() if v is not None})


def test_bundles(spark, tmp_path):
    npz(tmp_path / "f" / "good.npz")
    npz(tmp_path / "f" / "less.npz", time_s=None)
    npz(tmp_path / "f" / "kind.npz", x=np.zeros((6, 4)))
    npz(tmp_path / "f" / "flat.npz", x=np.zeros(6, np.float32))
    npz(tmp_path / "f" / "pickle.npz", x=np.array([{}], dtype=object))
    (tmp_path / "f" / "junk.npz").write_bytes(b"no archive")
    got = {r["feature_path"]: r for r in files.ingest_feature_bundles(spark, str(tmp_path)).collect()}
    assert {k: v["read_error"] for k, v in got.items()} == {
        "f/good.npz": "", "f/less.npz": "arrays", "f/kind.npz": "dtype", "f/flat.npz": "shape", "f/pickle.npz": "unreadable", "f/junk.npz": "unreadable"}
    good = got["f/good.npz"]
    assert good["x"][5] == [20, 21, 22, 23] and good["support_s"][1]["end"] == 10.0
    assert good["actual_sha256"] == hashlib.sha256((tmp_path / "f" / "good.npz").read_bytes()).hexdigest()
    df = files.ingest_feature_bundles(spark, str(tmp_path)).where("read_error = ''")
    assert df.select(B.first_bundle_error(B.bundle_rules(30.0)).alias("e")).first()["e"] == ""


def wav(samples, rate=44_100, channels=2, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes() if width == 2 else bytes(samples))
    return out.getvalue()


def test_clips(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "tone.wav").write_bytes(wav([100, -200] * 441_000))
    (tmp_path / "loud.wav").write_bytes(wav([32767, -32768] * 1000))
    (tmp_path / "zero.wav").write_bytes(wav([0, 0] * 500))
    (tmp_path / "mono.wav").write_bytes(wav([1] * 300, channels=1, rate=16_000))
    (tmp_path / "empty.wav").write_bytes(wav([]))
    (tmp_path / "junk.wav").write_bytes(b"nothing")
    got = {r["source_file"]: r for r in files.ingest_clip_facts(spark, str(tmp_path)).collect()}
    tone = got["a/tone.wav"]
    assert (tone["samplerate"], tone["channels"], tone["nframes"], tone["nonzero_samples"], tone["clipped_ratio"]) == (44_100, 2, 441_000, 882_000, 0.0)
    assert got["loud.wav"]["clipped_ratio"] == 1.0 and got["zero.wav"]["nonzero_samples"] == 0 and got["mono.wav"]["samplerate"] == 16_000
    assert got["empty.wav"]["nframes"] == 0 and got["junk.wav"]["decode_error"] == "UNSUPPORTED_CONTAINER"


def test_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.tmp").write_bytes(b"x")
    got = files.file_inventory(spark, str(tmp_path)).collect()
    assert [(r["path"], r["size_bytes"], r["sha256"]) for r in got] == [("d/a.txt", 3, hashlib.sha256(b"abc").hexdigest())]


def test_nothing_is_overwritten(spark, tmp_path):
    df = spark.range(3)
    path = sinks.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_new(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_state_round_trip(spark, tmp_path):
    state = B.StandardizerState((1.5, 2.0), (0.1, 1.0), 12, (1,), ("a", "b"), "h")
    path = sinks.save_state(spark, state, str(tmp_path / "s"))
    assert sinks.load_state(spark, path) == state
    for change in ({"version": "other"}, {"fitted_split": "val"}):
        bad = B.StandardizerState(**(state.__dict__ | change))
        folder = tmp_path / str(len(change["version"] if "version" in change else "val"))
        spark.range(1).select(F.lit(B.state_json(bad)).alias("value")).write.text(str(folder))
        with pytest.raises(ContractError):
            sinks.load_state(spark, str(folder))
    with pytest.raises(ContractError):
        sinks.save_state(spark, B.StandardizerState(**(state.__dict__ | {"fitted_split": "val"})), str(tmp_path / "v"))


def test_small_dimensions(spark, tmp_path):
    scheme = {"label_scheme": C.CLIP_SCHEME, "class_names": list(C.CLIP_CLASSES_6), "task_to_class": {t: i for i, t in enumerate(C.CLIP_TASKS_6)}}
    path = tmp_path / "scheme.json"
    path.write_text(json.dumps(scheme, indent=1))
    got = {r["task"]: (r["class_id"], r["class_name"]) for r in tables.read_label_scheme(spark, str(path)).collect()}
    assert got["08"] == (5, "Eating") and len(got) == 6
    path.write_text(json.dumps(scheme | {"class_names": ["x"]}))
    with pytest.raises(ContractError):
        tables.read_label_scheme(spark, str(path))
    path.write_text(json.dumps({"splits": {"P01": "train", "P02": "val"}}, indent=1))
    assert tables.read_subject_splits(spark, str(path)).count() == 2
    for bad in ({"splits": {"P01": "dev"}}, {"other": 1}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ContractError):
            tables.read_subject_splits(spark, str(path))


def test_predictions_round_trip(spark, tmp_path):
    schema = "seed int, split string, sample_id string, parent_id string, subject_id string, session_id string, window_index int, label_id int, probabilities array<double>, prediction int"
    df = spark.createDataFrame([(11, "val", f"s{i}", "p", "D", "D_A", i, 0, [0.1, 0.7, 0.2], 1) for i in range(3)], schema)
    path = sinks.write_csv(sinks.export_predictions(df, "r"), str(tmp_path / "p"))
    back = tables.read_predictions(spark, path, "window_30s", "val", 11, expected=3)
    assert back.first()["probabilities"] == [0.1, 0.7, 0.2]
    for kw in ({"split": "train"}, {"seed": 22}, {"expected": 4}):
        with pytest.raises(ContractError):
            tables.read_predictions(spark, path, **({"unit": "window_30s", "split": "val", "seed": 11} | kw))


def test_prediction_lines(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    good = {"sample_id": "a", "subject_id": "D", "label": 1, "prediction": 0, "seed": 3, "split": "test", "other": [1]}
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"label": 5}) + "\n")
    assert [(r["label_id"], r["prediction"], r["seed"]) for r in tables.read_predictions_jsonl(spark, str(path), 6).collect()] == [(1, 0, 3), (5, 0, 3)]
    for bad in (json.dumps(good | {"label": 6}), json.dumps(good | {"prediction": None}), json.dumps(good | {"subject_id": None}), "{broken", json.dumps(good | {"label": "x"})):
        path.write_text(json.dumps(good) + "\n" + bad + "\n")
        with pytest.raises(Exception):
            tables.read_predictions_jsonl(spark, str(path), 6).collect()


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\n  \nb\n")
    (tmp_path / "ids.csv").write_text("x,sample_id\n1,c\n")
    assert {r[0] for r in tables.read_id_list(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    assert {r[0] for r in tables.read_id_list(spark, str(tmp_path / "ids.csv")).collect()} == {"c"}


def test_package_stops_at_a_missing_feature(spark, tmp_path):
    request = spark.createDataFrame([("a", 60_000, "f/a", "session_relative")], "sample_id string, window_start_ms long, source_feature string, source_time_reference string")
    arrays = spark.createDataFrame([("f/a", [[1.0]] * 6, [60 + (i + 0.5) * 5 for i in range(6)], [True] * 6, [(60 + i * 5.0, 65 + i * 5.0) for i in range(6)], [1.0] * 6)],
                                   "source_feature string, x array<array<float>>, time_s array<double>, valid_mask array<boolean>, support_s array<struct<start:double,end:double>>, observed_fraction array<float>")
    out = sinks.export_feature_package(request, arrays, str(tmp_path / "pack")).first()
    assert out["time_s"][0] == 2.5 and out["feature_path"] == "features_30s/a.npz"
    with pytest.raises(ContractError):
        sinks.export_feature_package(request.withColumn("source_feature", F.lit("f/z")), arrays, str(tmp_path / "pack2"))


def test_staging_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(root)
    df = stage(spark.range(10), "numbers")
    assert df.count() == 10 and root in df.inputFiles()[0]


@pytest.mark.parametrize("line", ["xx,0,0,0,0,0,0,0,0,0", "16666,0,0,0,0,0", "16666,0,0,0,word,0,0,0,0,0"])
def test_a_broken_telemetry_line_stops_the_read(spark, tmp_path, line):
    telemetry_file(tmp_path, "D_Telemetry_A.csv", [0])
    with open(tmp_path / "D_Telemetry_A.csv", "a") as f:
        f.write(line + "\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.read_telemetry(spark, str(tmp_path)).collect()


def test_a_telemetry_file_without_a_session_name_stops_the_read(spark, tmp_path):
    telemetry_file(tmp_path, "nobody_Telemetry_Z.csv", [0, 1])
    with pytest.raises(Exception, match="no session in the name"):
        tables.read_telemetry(spark, str(tmp_path)).collect()


def test_a_header_without_samples_is_empty_audio(spark, tmp_path):
    whole = wav(np.ones((44_100, 2), "<i2"))
    (tmp_path / "a.wav").write_bytes(whole[:44])
    facts = files.ingest_clip_facts(spark, str(tmp_path)).collect()[0]
    assert facts["samples"] == 0 and facts["nframes"] > 0
    codes = clips.clip_qc(files.ingest_clip_facts(spark, str(tmp_path))).collect()[0]["reason_codes"]
    assert "EMPTY_AUDIO" in codes and "ZERO_AUDIO" not in codes


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return Elsewhere.conf


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere, "x")


def test_a_set_of_outputs_appears_whole_or_not_at_all(spark, tmp_path):
    good = spark.createDataFrame([("x", 1, "a"), ("x", 1, "a"), ("y", 2, None)], "part string, k long, v string")
    bad = good.select("k", F.raise_error(F.lit("broken")).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_set({"first": (good, ["part"]), "second": (good, []), "third": (bad, [])}, str(tmp_path / "set"))
    assert list(tmp_path.iterdir()) == []
    paths = sinks.write_set({"first": (good, ["part"]), "none": (good.where("false"), [])}, str(tmp_path / "set"))
    assert [p.name for p in tmp_path.iterdir()] == ["set"] and spark.read.parquet(paths["first"]).count() == 3
    with pytest.raises(ContractError, match="exists"):
        sinks.write_set({"first": (good, [])}, str(tmp_path / "set"))
    check = {r.output: (r.expected, r.found, r.same) for r in sinks.check_set(spark, str(tmp_path / "set"), {"first": good.schema, "none": good.schema}).collect()}
    assert check == {"first": (3, 3, True), "none": (0, 0, True)}
    sinks.write_new(good.limit(1), str(tmp_path / "more"))
    next((tmp_path / "more").glob("*.parquet")).rename(tmp_path / "set" / "none" / "extra.parquet")
    after = sinks.check_set(spark, str(tmp_path / "set"), {"none": good.schema}).where("output = 'none'").first()
    assert (after.expected, after.found, after.same) == (0, 1, False)
