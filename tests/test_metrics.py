import math

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import metrics as M

SCHEMA = "seed int, parent_id string, subject_id string, session_id string, split string, window_index int, label_id int, probabilities array<double>"


def pred(label, p, i=0, parent="p", subject="D", seed=11, split="val"):
    return (seed, parent, subject, f"{subject}_A", split, i, label, None if p is None else [float(v) for v in p])


def test_fixed_and_supported_classes_differ(rows):
    data = [pred(0, [0.9, 0.1, 0]), pred(0, [0.1, 0.9, 0]), pred(1, [0.1, 0.9, 0])]
    m = M.classification_metrics(M.with_prediction(rows(data, SCHEMA)), [], 3).first()
    f0, f1 = 2 / 3, 2 / 3
    assert m["sample_count"] == 3 and m["accuracy"] == pytest.approx(2 / 3)
    assert m["macro_f1_fixed_classes"] == pytest.approx((f0 + f1) / 3)
    assert m["macro_f1_supported_classes"] == pytest.approx((f0 + f1) / 2)
    assert m["balanced_accuracy_supported_classes"] == pytest.approx(0.75)
    assert m["balanced_accuracy_all_classes"] == pytest.approx(0.5)
    wide = {r["actual"]: r for r in M.confusion_wide(M.with_prediction(rows(data, SCHEMA)), [], ["low", "medium", "high"]).collect()}
    assert (wide["low"]["low"], wide["low"]["medium"], wide["high"]["high"]) == (1, 1, 0)


def test_parent_is_the_mean_of_eight(rows):
    data = [pred(1, [0.5, 0.3, 0.2] if i < 5 else [0.1, 0.8, 0.1], i) for i in range(8)]
    got = M.aggregate_parents(rows(data, SCHEMA), 3).first()
    assert got["probabilities"] == pytest.approx([0.35, 0.4875, 0.1625]) and got["prediction"] == 1 and got["window_count"] == 8


@pytest.mark.parametrize("data,code", [
    ([pred(1, [1, 0, 0], i) for i in range(7)], "window_indices"), ([pred(1, [1, 0, 0], min(i, 6)) for i in range(8)], "window_indices"),
    ([pred(1 if i else 2, [1, 0, 0], i) for i in range(8)], "inconsistent_metadata"),
    ([pred(1, [1, 0, 0], i, subject="D" if i else "E") for i in range(8)], "inconsistent_metadata"),
    ([pred(1, [0.5, 0, 0] if i == 3 else [1, 0, 0], i) for i in range(8)], "probabilities")])
def test_bad_parents_are_named(rows, data, code):
    df = rows(data, SCHEMA)
    assert M.aggregate_parents(df, 3).count() == 0
    assert M.parent_problems(df, 3).first()["code"] == code


def test_check_stops_on_a_parent_that_cannot_be_scored(rows):
    whole = [pred(1, [0, 1, 0], i) for i in range(8)]
    df = M.with_prediction(rows(whole + [pred(1, [0, 1, 0], i, parent="q") for i in range(7)], SCHEMA))
    for stopped in (M.aggregate_parents(df, 3, check=True), M.metric_bundle(df, 3, check=True), M.majority_bundle(df, df, 3, check=True)):
        with pytest.raises(Exception, match="parents outside the contract: q"):
            stopped.collect()
    assert M.aggregate_parents(df.where("parent_id = 'p'"), 3, check=True).count() == 1


def test_refused_parents_stand_beside_the_scored(rows):
    """Two whole parents of D, one of E cut short, one of D that disagrees on its label, one of F without a whole parent."""
    data = [pred(1, [0, 1, 0], i, parent=p) for p in "ab" for i in range(8)]
    data += [pred(1, [0, 1, 0], i, parent="c", subject="E") for i in range(8)] + [pred(1, [0, 1, 0], i, parent="d", subject="E") for i in range(7)]
    data += [pred(1 if i else 2, [0, 1, 0], i, parent="e") for i in range(8)] + [pred(1, [0, 1, 0], 0, parent="f", subject="F")]
    df = M.with_prediction(rows(data, SCHEMA))
    judged = {r.parent_id: (r.code, r.prediction) for r in M.judge_parents(df, 3).collect()}
    assert judged == {"a": ("", 1), "b": ("", 1), "c": ("", 1), "d": ("window_indices", None), "e": ("inconsistent_metadata", None), "f": ("window_indices", None)}
    got = {(r.scope, r.subject_id): (r.sample_count, r.refused) for r in M.metric_bundle(df, 3).where("unit = 'parent_240s'").collect()}
    assert got == {("all", ""): (3, 3), ("subject", "D"): (2, 1), ("subject", "E"): (1, 1), ("subject", "F"): (0, 1)}
    windows = M.metric_bundle(df, 3).where("unit = 'window_30s' and scope = 'all'").first()
    assert windows.sample_count == len(data) and windows.refused == 0


def test_a_parent_without_identity_or_probabilities_is_refused(rows):
    df = rows([pred(1, [0, 1, 0], i, subject=None) for i in range(8)] + [pred(1, None if i == 2 else [0, 1, 0], i, parent="q") for i in range(8)], SCHEMA)
    assert {r.parent_id: r.code for r in M.judge_parents(df, 3).collect()} == {"p": "inconsistent_metadata", "q": "probabilities"}


def test_majority_takes_the_smallest_id_on_a_tie(rows):
    df = rows([pred(v, [1, 0, 0]) for v in (2, 2, 1, 1, 0)], SCHEMA)
    assert M.majority_class(df).first()["majority_class"] == 1
    assert M.test_majority(df, 3).first()["majority_class_id"] == 1


def test_one_seed_has_no_sample_deviation(rows):
    got = M.seed_summary(rows([(11, 0.5)], "seed int, f1 double"), ["f1"]).first()
    assert (got["mean"], got["sample_std_ddof_1"], got["seed_count"]) == (0.5, None, 1)
    got = M.seed_summary(rows([(11, 0.5), (22, 0.7)], "seed int, f1 double"), ["f1"]).first()
    assert got["sample_std_ddof_1"] == pytest.approx(math.sqrt(0.02))
    table = M.seed_summary_rows(rows([(11, 0.5), (22, 0.7)], "seed int, f1 double"), ["f1"]).collect()
    assert [r["row_type"] for r in table] == ["seed", "seed", "mean", "sample_std_ddof_1"]


def test_subjects_over_seeds_use_the_first_seed_for_support(rows):
    data = [pred(0, [1, 0, 0], seed=11), pred(1, [1, 0, 0], seed=11), pred(0, [1, 0, 0], seed=22), pred(1, [0, 1, 0], seed=22)]
    got = M.per_subject_over_seeds(M.with_prediction(rows(data, SCHEMA)), 3).first()
    assert got["sample_count"] == 2 and got["class_count"] == 2
    a, b = (2 / 3) / 3, 2 / 3
    assert got["fixed_macro_f1_mean"] == pytest.approx((a + b) / 2) and got["fixed_macro_f1_std"] == pytest.approx((b - a) / 2)
    assert got["present_macro_f1_mean"] == pytest.approx((1 / 3 + 1) / 2)


def test_top_confusions(rows):
    data = [pred(0, [0, 1, 0])] * 3 + [pred(2, [0, 1, 0])] * 3 + [pred(1, [1, 0, 0])] + [pred(0, [1, 0, 0])] * 9
    got = M.top_confusions(M.with_prediction(rows(data, SCHEMA)), ["low", "medium", "high"], 2).collect()
    assert [(r["true_class"], r["pred_class"], r["n"]) for r in got] == [("high", "medium", 3), ("low", "medium", 3)]


def track(values, patience):
    best, at, idle, ran = -math.inf, None, 0, 0
    for i, v in enumerate(values):
        ran += 1
        if v > best:
            best, at, idle = v, i, 0
        else:
            idle += 1
        if idle >= patience:
            return best, at, ran, True
    return best, at, ran, False


@pytest.mark.parametrize("values,patience", [
    ([0.1, 0.3, 0.3, 0.2, 0.9], 2), ([0.1, 0.3, 0.3, 0.2, 0.9], 3), ([0.5], 1), ([3, 2, 1, 0], 1), (list(range(10)), 2), ([1, 1, 1, 1, 2, 0, 5], 3)])
def test_early_stop(rows, values, patience):
    df = rows([("s", i, float(v)) for i, v in enumerate(values)], "seed string, position long, metric double", 4)
    got = M.best_so_far(df, ["seed"], "position", "metric", patience).first()
    assert (got["best_metric"], got["best_epoch"], got["epochs_ran"], got["stopped_early"]) == track(values, patience)


def test_bundle_units_and_scopes(rows):
    data = [pred(i % 3, [1, 0, 0], i, parent=f"p{s}", subject=s) for s in "DE" for i in range(8)]
    data = [(*r[:6], 1, r[7]) for r in data]
    out = M.metric_bundle(M.with_prediction(rows(data, SCHEMA)), 3)
    got = {(r["unit"], r["scope"], r["subject_id"]): r["sample_count"] for r in out.collect()}
    assert got == {("window_30s", "all", ""): 16, ("window_30s", "subject", "D"): 8, ("window_30s", "subject", "E"): 8,
                   ("parent_240s", "all", ""): 2, ("parent_240s", "subject", "D"): 1, ("parent_240s", "subject", "E"): 1}
    top = M.majority_bundle(rows(data, SCHEMA), rows(data, SCHEMA), 3).where("scope = 'all' and unit = 'parent_240s'").first()
    assert top["accuracy"] == 1.0


def test_row_order_and_partitions_do_not_matter(rows):
    data = [pred(i % 3, [(i % 5) / 10, 1 - (i % 5) / 10, 0], i % 8, parent=f"p{i // 8}") for i in range(160)]
    shapes = [M.classification_metrics(M.with_prediction(rows(d, SCHEMA, n)), [], 3).first() for d, n in ((data, 1), (data[::-1], 7))]
    assert shapes[0] == shapes[1]


def test_stored_metrics_are_audited(rows):
    df = M.with_prediction(rows([pred(0, [1, 0, 0]), pred(1, [1, 0, 0])], SCHEMA))
    stored = M.classification_metrics(df, ["seed"], 3)
    assert M.audit_metrics(df, stored, ["seed"], 3).where("not agrees").count() == 0
    off = stored.withColumn("accuracy", F.col("accuracy") + 1e-9)
    assert [r["metric"] for r in M.audit_metrics(df, off, ["seed"], 3).where("not agrees").collect()] == ["accuracy"]


@pytest.mark.parametrize("label, p", [(7, [1, 0, 0]), (-1, [1, 0, 0]), (None, [1, 0, 0]), (1, [.9, .9, .9]), (1, [math.nan, 0, 0]), (1, [.5, .5])])
def test_a_row_outside_the_contract_stops_every_score(rows, label, p):
    df = M.with_prediction(rows([pred(0, [1, 0, 0]), pred(label, p, 1)], SCHEMA))
    for score in (M.classification_metrics, M.per_class_metrics, M.confusion_matrix):
        with pytest.raises(Exception, match="outside the contract"):
            score(df, ["subject_id"], 3).collect()
    with pytest.raises(Exception, match="outside the contract"):
        M.metric_bundle(df, 3).collect()


@pytest.mark.parametrize("bad", [math.nan, math.inf, None])
def test_early_stop_refuses_metrics_that_are_no_numbers(rows, bad):
    df = rows([("s", 0, .5), ("s", 1, bad), ("s", 2, .9)], "seed string, position long, metric double")
    with pytest.raises(Exception, match="not finite"):
        M.best_so_far(df, ["seed"], "position", "metric", 3).collect()
    with pytest.raises(ValueError):
        M.best_so_far(df, ["seed"], "position", "metric", 0)
