"""Scoring of prediction tables.

A prediction table holds ``label_id`` and ``probabilities`` next to its ids. One
aggregation turns it into the C*C counts of every group as one wide row; all
metrics are arithmetic on that row, so no step shuffles more than the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.numeric import argmax, one_hot, valid_probabilities
from tidegrid.operators.grid import index_set_is_full
from tidegrid.plans.chunked import cut, with_running_max
from tidegrid.plans.guards import ContractError


def with_prediction(preds: DataFrame) -> DataFrame:
    return preds.withColumn("prediction", argmax(F.col("probabilities")))


def prediction_problems(preds: DataFrame, classes: int, tolerance: float = 1e-5) -> DataFrame:
    """Rows whose vector or label breaks the contract."""
    code = (
        F.when(~valid_probabilities(F.col("probabilities"), classes, tolerance), "probabilities")
        .when(~F.coalesce(F.col("label_id").between(0, classes - 1), F.lit(False)), "label_range")
    )
    return preds.withColumn("code", code).where("code is not null")


# -- counts -------------------------------------------------------------------

def _cell(i: int, j: int) -> str:
    return f"c_{i}_{j}"


def _cells(columns: Sequence[str], classes: int, scored: Column | None = None) -> list[Column]:
    """The counts of all cells. The first one stops the query if a row belongs to none.

    A label or prediction outside 0..C-1, a null one or an invalid probability vector would
    make a row drop out of every metric; it is counted in the same pass and refused. Rows that are
    not ``scored`` belong to no cell; the caller counts them.
    """
    scored = F.lit(True) if scored is None else scored
    fits = F.col("label_id").between(0, classes - 1) & F.col("prediction").between(0, classes - 1)
    if "probabilities" in columns:
        fits = fits & valid_probabilities(F.col("probabilities"), classes)
    refused = F.count_if(scored & ~F.coalesce(fits, F.lit(False)))
    stop = F.raise_error(F.concat(F.lit("predictions outside the contract: "), refused.cast("string"))).cast("bigint")
    counts = {(i, j): F.count_if(scored & (F.col("label_id") == i) & (F.col("prediction") == j))
              for i in range(classes) for j in range(classes)}
    counts[0, 0] = F.when(refused > 0, stop).otherwise(counts[0, 0])
    return [count.alias(_cell(i, j)) for (i, j), count in counts.items()]


def wide_confusion(preds: DataFrame, by: Sequence[str], classes: int) -> DataFrame:
    """One row per group with the count of every (label, prediction) cell."""
    return preds.groupBy(*by).agg(*_cells(preds.columns, classes))


def confusion_matrix(preds: DataFrame, by: Sequence[str], classes: int) -> DataFrame:
    """Long form, zero cells included."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("label_id"), F.lit(j).alias("prediction"), F.col(_cell(i, j)).alias("n"))
        for i in range(classes) for j in range(classes)
    ])
    return wide_confusion(preds, by, classes).select(*by, F.inline(cells))


def confusion_wide(preds: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group and actual class, one column per predicted class."""
    size = len(names)
    rows = F.array(*[
        F.struct(F.lit(names[i]).alias("actual"),
                 *[F.col(_cell(i, j)).alias(names[j]) for j in range(size)])
        for i in range(size)
    ])
    return wide_confusion(preds, by, size).select(*by, F.inline(rows))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _per_class(classes: int) -> list[dict[str, Column]]:
    out = []
    for i in range(classes):
        hit = F.col(_cell(i, i))
        support = sum((F.col(_cell(i, j)) for j in range(classes)), F.lit(0).cast("bigint"))
        called = sum((F.col(_cell(j, i)) for j in range(classes)), F.lit(0).cast("bigint"))
        out.append({
            "precision": _ratio(hit, called),
            "recall": _ratio(hit, support),
            "f1": _ratio(2 * hit, support + called),
            "support": support,
        })
    return out


def per_class_metrics(preds: DataFrame, by: Sequence[str], classes: int) -> DataFrame:
    """Precision, recall, F1 (0 when undefined) and support of every class."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("class_id"), *[m[k].alias(k) for k in ("precision", "recall", "f1", "support")])
        for i, m in enumerate(_per_class(classes))
    ])
    return wide_confusion(preds, by, classes).select(*by, F.inline(rows))


def metric_columns(classes: int) -> dict[str, Column]:
    """The summary metrics as arithmetic on the wide counts."""
    per = _per_class(classes)
    total = sum((m["support"] for m in per), F.lit(0).cast("bigint"))
    hits = sum((F.col(_cell(i, i)) for i in range(classes)), F.lit(0).cast("bigint"))
    present = sum((F.when(m["support"] > 0, 1).otherwise(0) for m in per), F.lit(0))

    def over_present(name: str) -> Column:
        return _ratio(sum((F.when(m["support"] > 0, m[name]).otherwise(0.0) for m in per), F.lit(0.0)), present)

    def over_all(name: str) -> Column:
        return sum((m[name] for m in per), F.lit(0.0)) / classes

    return {
        "sample_count": total,
        "accuracy": _ratio(hits, total),
        "macro_f1_fixed_classes": over_all("f1"),
        "macro_f1_supported_classes": over_present("f1"),
        "balanced_accuracy_supported_classes": over_present("recall"),
        "balanced_accuracy_all_classes": over_all("recall"),
        "last_class_recall": per[-1]["recall"],
    }


def classification_metrics(preds: DataFrame, by: Sequence[str], classes: int) -> DataFrame:
    """Summary metrics per group. The audit reading of balanced accuracy averages
    over all classes, the evaluation reading over the supported ones."""
    metrics = [c.alias(n) for n, c in metric_columns(classes).items()]
    return wide_confusion(preds, by, classes).select(*by, *metrics)


# -- parents ------------------------------------------------------------------

def _parent_groups(preds: DataFrame, classes: int, windows: int, by: Sequence[str]) -> DataFrame:
    identity = ("label_id", "subject_id", "session_id", "split")
    means = F.array(*[F.avg(F.get("probabilities", F.lit(i))) for i in range(classes)])
    same = F.lit(True)
    for name in identity:
        same = same & (F.min(name) == F.max(name))
    return preds.groupBy(*by, "parent_id").agg(
        *[F.min(name).alias(name) for name in identity],
        F.count(F.lit(1)).alias("window_count"),
        index_set_is_full(F.col("window_index"), windows).alias("__full"),
        same.alias("__same"),
        F.bool_and(valid_probabilities(F.col("probabilities"), classes)).alias("__valid"),
        means.alias("probabilities"),
    )


def judge_parents(preds: DataFrame, classes: int, windows: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Every parent: mean class probabilities and prediction, or ``code``, the first rule it breaks.

    ``code`` is empty for a parent that holds each window once and agrees on its identity; the
    others have no probabilities and no prediction. One aggregation gives both, so the parents with
    and without code add up to all there are.
    """
    def no(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(False))

    code = (
        F.when(no("__full"), "window_indices").when(no("__same"), "inconsistent_metadata")
        .when(no("__valid"), "probabilities").otherwise("")
    )
    judged = _parent_groups(preds, classes, windows, by).withColumn("code", code).drop("__full", "__same", "__valid")
    scored = F.col("code") == ""
    return with_prediction(judged.withColumn("probabilities", F.when(scored, F.col("probabilities")))).withColumn(
        "prediction", F.when(scored, F.col("prediction")))


def aggregate_parents(preds: DataFrame, classes: int, windows: int = 8,
                      by: Sequence[str] = (), check: bool = False) -> DataFrame:
    """Mean class probabilities of every parent that holds each window once.

    ``judge_parents`` gives the other parents beside these, ``parent_problems`` alone; with
    ``check`` the first one stops the query.
    """
    fits = F.col("code") == ""
    if check:
        stop = F.raise_error(F.concat(F.lit("parents outside the contract: "), F.col("parent_id").cast("string"))).cast("boolean")
        fits = F.when(fits, True).otherwise(stop)
    return judge_parents(preds, classes, windows, by).where(fits).drop("code")


def parent_problems(preds: DataFrame, classes: int, windows: int = 8,
                    by: Sequence[str] = ()) -> DataFrame:
    """Parents that cannot be scored, with the first rule they break."""
    return judge_parents(preds, classes, windows, by).where("code <> ''").select(*by, "parent_id", "window_count", "code")


# -- bundles and baselines ----------------------------------------------------

def metric_bundle(preds: DataFrame, classes: int, windows: int = 8, by: Sequence[str] = (),
                  check: bool = False) -> DataFrame:
    """Window and parent metrics, over all and per subject, in one table.

    Grouping sets give the overall and per-subject counts in one pass, and in the same pass
    ``refused``, the parents that cannot be scored: with ``sample_count`` they add up to the parents
    there are, and a subject without a single whole parent still has its row. With ``check`` a parent
    that cannot be scored stops the query.
    """
    units = {"window_30s": preds, "parent_240s": judge_parents(preds, classes, windows, by)}
    metrics = [c.alias(n) for n, c in metric_columns(classes).items()]
    out = None
    for unit, table in units.items():
        keys = [F.col(b) for b in by]
        sets = [[*keys], [*keys, F.col("subject_id")]]
        scored, refused = F.lit(True), F.lit(0).cast("bigint")
        if unit == "parent_240s":
            scored = F.col("code") == ""
            refused = F.count_if(~scored)
            if check:
                one = F.min(F.when(~scored, F.col("parent_id").cast("string")))
                stop = F.raise_error(F.concat(F.lit("parents outside the contract: "), one)).cast("bigint")
                refused = F.when(refused > 0, stop).otherwise(refused)
        counted = table.groupingSets(sets, *keys, F.col("subject_id")).agg(
            *_cells(table.columns, classes, scored), refused.alias("refused"), F.grouping("subject_id").alias("__all"))
        rows = counted.select(
            F.lit(unit).alias("unit"), *by,
            F.when(F.col("__all") == 1, "all").otherwise("subject").alias("scope"),
            F.when(F.col("__all") == 1, "").otherwise(F.col("subject_id").cast("string")).alias("subject_id"),
            *metrics, "refused")
        out = rows if out is None else out.unionByName(rows)
    return out


def label_counts(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by, "label_id").agg(F.count(F.lit(1)).alias("n"))


def majority_class(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent label per group, the smallest id on a tie."""
    return label_counts(table, by).groupBy(*by).agg(
        F.max_by("label_id", F.struct("n", -F.col("label_id"))).alias("majority_class"),
        F.max("n").alias("n"),
    )


def constant_predictions(table: DataFrame, label: Column, classes: int) -> DataFrame:
    return table.withColumn("probabilities", one_hot(label, classes)).withColumn("prediction", label.cast("int"))


def majority_bundle(train: DataFrame, val: DataFrame, classes: int, windows: int = 8, check: bool = False) -> DataFrame:
    """The bundle of always calling the most frequent training label.

    The label is one value, so it enters as a scalar subquery.
    """
    top = majority_class(train).select("majority_class").scalar()
    return metric_bundle(constant_predictions(val, top, classes), classes, windows, check=check)


def test_majority(table: DataFrame, classes: int) -> DataFrame:
    """Scores of the constant majority of the same table's labels.

    Only the label counts are needed, so the table itself is read once.
    """
    wide = table.agg(*[F.count_if(F.col("label_id") == i).alias(f"s_{i}") for i in range(classes)])
    supports = F.array(*[F.col(f"s_{i}") for i in range(classes)])
    top = argmax(supports)
    wide = wide.withColumn("majority_class_id", top)
    cells = {
        _cell(i, j): F.when(F.col("majority_class_id") == j, F.col(f"s_{i}")).otherwise(0).cast("bigint")
        for i in range(classes) for j in range(classes)
    }
    m = metric_columns(classes)
    return wide.withColumns(cells).select(
        "majority_class_id", m["sample_count"].alias("test_sample_count"), m["accuracy"].alias("accuracy"),
        m["macro_f1_fixed_classes"].alias("macro_f1"),
        m["balanced_accuracy_all_classes"].alias("balanced_accuracy"),
    )


# -- over seeds ---------------------------------------------------------------

def seed_summary(seed_rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation (null for one seed) of each metric."""
    long = seed_rows.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sample_std_ddof_1"),
        F.count("value").alias("seed_count"),
    )


def seed_summary_rows(seed_rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The seed rows followed by a mean row and a deviation row."""
    none = F.lit(None).cast("int").alias("seed")
    rows = seed_rows.select(F.lit("seed").alias("row_type"), F.col("seed").cast("int").alias("seed"), *metrics)
    mean = seed_rows.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("mean").alias("row_type"), none, *metrics)
    std = seed_rows.agg(*[F.stddev_samp(m).alias(m) for m in metrics]).select(
        F.lit("sample_std_ddof_1").alias("row_type"), none, *metrics)
    return rows.unionByName(mean).unionByName(std)


def seed_mean_population(preds: DataFrame, classes: int) -> DataFrame:
    """Per class: mean precision and recall, mean and population deviation of F1."""
    per = per_class_metrics(preds, ["seed"], classes)
    return per.groupBy("class_id").agg(
        F.avg("precision").alias("precision_mean"),
        F.avg("recall").alias("recall_mean"),
        F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_std"),
        F.min_by("support", "seed").alias("support"),
    )


def seed_mean_summary(preds: DataFrame, classes: int) -> DataFrame:
    """One row: seed means, and the population deviation of macro F1."""
    m = classification_metrics(preds, ["seed"], classes)
    return m.agg(
        F.avg("macro_f1_fixed_classes").alias("macro_f1"),
        F.stddev_pop("macro_f1_fixed_classes").alias("macro_f1_std"),
        F.avg("balanced_accuracy_supported_classes").alias("balanced_accuracy"),
        F.avg("accuracy").alias("accuracy"),
    )


def per_subject_over_seeds(preds: DataFrame, classes: int) -> DataFrame:
    """Per subject: support in the first seed; fixed and present-class macro F1.

    Present classes are those the first seed's labels hold for the subject.
    """
    wide = wide_confusion(preds, ["subject_id", "seed"], classes)
    per = _per_class(classes)
    scored = wide.select(
        "subject_id", "seed",
        F.array(*[m["f1"] for m in per]).alias("f1"),
        F.array(*[m["support"] for m in per]).alias("support"))
    # Seeds per subject are a handful: one row per (subject, seed) is left here.
    first = W.partitionBy("subject_id").orderBy("seed")
    first_seed = preds.agg(F.min("seed").alias("s")).select("s").scalar()
    based = scored.withColumn("base", F.max(F.when(F.col("seed") == first_seed, F.col("support"))).over(
        first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    base = F.coalesce("base", F.array(*[F.lit(0).cast("bigint")] * classes))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    fixed = total(F.col("f1")) / classes
    present_count = F.size(F.filter(base, lambda v: v > 0))
    present = F.when(present_count > 0, total(
        F.zip_with("f1", base, lambda f, s: F.when(s > 0, f).otherwise(0.0))) / present_count)
    return (
        based.withColumn("fixed", fixed).withColumn("present", present)
        .groupBy("subject_id").agg(
            F.max(F.aggregate(base, F.lit(0).cast("bigint"), lambda acc, v: acc + v)).alias("sample_count"),
            F.max(present_count).cast("bigint").alias("class_count"),
            F.avg("fixed").alias("fixed_macro_f1_mean"),
            F.stddev_pop("fixed").alias("fixed_macro_f1_std"),
            F.avg("present").alias("present_macro_f1_mean"),
            F.stddev_pop("present").alias("present_macro_f1_std"),
        )
    )


def top_confusions(preds: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """The k largest off-diagonal cells over all seeds, names breaking ties."""
    label = F.array(*[F.lit(n) for n in names])
    cells = confusion_matrix(preds, [], len(names)).where("label_id <> prediction and n > 0")
    return (
        cells.select(F.get(label, F.col("label_id")).alias("true_class"),
                     F.get(label, F.col("prediction")).alias("pred_class"), "n")
        .orderBy(F.desc("n"), "true_class", "pred_class").limit(k)
    )


def seed_report_problems(reports: DataFrame, classes: int) -> DataFrame:
    """Rules a stored per-seed report breaks.

    ``reports`` holds seed, arrays per_class_precision/recall/f1, class_support
    and confusion_matrix (array of arrays).
    """
    widths = F.lit(True)
    for name in ("per_class_f1", "per_class_precision", "per_class_recall", "class_support"):
        widths = widths & (F.size(name) == classes)
    count = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    samples = count(F.col("class_support"))
    row_sums = F.transform("confusion_matrix", count)
    expected = reports.agg(F.min_by(samples, "seed").alias("n")).select("n").scalar()
    square = (F.size("confusion_matrix") == classes) & F.forall("confusion_matrix", lambda r: F.size(r) == classes)
    code = (
        F.when(~widths, "class_width")
        .when(F.exists("class_support", lambda v: v < 0), "negative_support")
        .when(samples != expected, "sample_count")
        .when(~square, "matrix_shape")
        .when(row_sums != F.col("class_support").cast("array<bigint>"), "row_sums")
        .otherwise("")
    )
    return reports.select("seed", samples.alias("sample_count"), code.alias("code"))


def seed_reports(preds: DataFrame, classes: int) -> DataFrame:
    """The per-seed report a run stores: arrays per class and the matrix."""
    per = _per_class(classes)
    m = metric_columns(classes)
    return wide_confusion(preds, ["seed"], classes).select(
        "seed", m["accuracy"].alias("accuracy"), m["macro_f1_fixed_classes"].alias("macro_f1"),
        m["balanced_accuracy_supported_classes"].alias("balanced_accuracy"),
        F.array(*[p["precision"] for p in per]).alias("per_class_precision"),
        F.array(*[p["recall"] for p in per]).alias("per_class_recall"),
        F.array(*[p["f1"] for p in per]).alias("per_class_f1"),
        F.array(*[p["support"] for p in per]).alias("class_support"),
        F.array(*[F.array(*[F.col(_cell(i, j)) for j in range(classes)]) for i in range(classes)])
        .alias("confusion_matrix"),
    )


def audit_metrics(preds: DataFrame, stored: DataFrame, by: Sequence[str], classes: int,
                  tolerance: float = 1e-12) -> DataFrame:
    """Recomputes metrics and compares them with a stored table, one row each."""
    names = ("accuracy", "balanced_accuracy_all_classes", "macro_f1_fixed_classes", "last_class_recall")
    fresh = classification_metrics(preds, by, classes)

    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select(*by, F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).alias(value)) for n in names])))

    joined = long(fresh, "recomputed").join(long(stored, "stored"), [*by, "metric"], "full")
    agrees = F.coalesce(F.abs(F.col("recomputed") - F.col("stored")) <= tolerance, F.lit(False))
    return joined.withColumn("agrees", agrees)


# -- model selection ----------------------------------------------------------

def best_so_far(history: DataFrame, keys: Sequence[str], order: str, metric: str, patience: int,
                epoch: str | None = None) -> DataFrame:
    """Best metric per key, the earlier on a tie, stopping when patience runs out.

    ``order`` is a dense 0-based position. Rows after the stop do not count,
    even where the metric rises again. A metric that is null or not finite stops
    the query: NaN would rank above every number.
    """
    if patience < 1:
        raise ContractError("patience must be positive")
    epoch = epoch or order
    value = F.col(metric)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    history = history.withColumn(metric, F.when(finite, value).otherwise(
        F.raise_error(F.concat(F.lit("metric is not finite at "), F.col(order).cast("string"))).cast("double")))
    chunk = cut(order)
    gains = with_running_max(history, keys, [order], chunk, {"__best": F.col(metric)})
    gain = F.col("__best").isNull() | (F.col(metric) > F.col("__best"))
    marked = gains.withColumn("__gain", gain).drop("__best")
    last = with_running_max(marked, keys, [order], chunk,
                            {"__at": F.when(F.col("__gain"), F.col(order))}, include_current=True)
    last = last.withColumn("__idle", F.col(order) - F.col("__at"))
    stops = last.groupBy(*keys).agg(F.min(F.when(F.col("__idle") >= patience, F.col(order))).alias("__stop"))
    kept = last.join(stops, list(keys), "left").where(
        F.col("__stop").isNull() | (F.col(order) <= F.col("__stop")))
    gains_only = F.when(F.col("__gain"), F.col(order))
    return kept.groupBy(*keys).agg(
        F.max(metric).alias("best_metric"),
        F.max_by(epoch, gains_only).alias("best_epoch"),
        F.count(F.lit(1)).alias("epochs_ran"),
        F.max("__stop").isNotNull().alias("stopped_early"),
    )


def evaluation_table(preds: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """The whole evaluation as (section, item, metric, value) rows.

    Seeds, means, classes, the summed matrix and the top confusions all come
    from the per-seed counts, which are a few wide rows.
    """
    classes = len(names)
    label = F.array(*[F.lit(n) for n in names])
    m, per = metric_columns(classes), _per_class(classes)
    wide = wide_confusion(preds, ["seed"], classes)

    def rows(df: DataFrame, section: str, item: Column, **values: Column | str) -> DataFrame:
        cells = [F.struct(F.lit(k).alias("metric"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"))
                 for k, v in values.items()]
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.inline(F.array(*cells)))

    scored = wide.select(
        "seed", m["accuracy"].alias("accuracy"), m["macro_f1_fixed_classes"].alias("macro_f1"),
        m["balanced_accuracy_supported_classes"].alias("balanced_accuracy"))
    means = scored.agg(
        F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("macro_f1_std"),
        F.avg("balanced_accuracy").alias("balanced_accuracy"), F.avg("accuracy").alias("accuracy"))
    kinds = ("precision", "recall", "f1")
    classes_long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("class_id"), *[p[k].alias(k) for k in kinds]) for i, p in enumerate(per)])))
    class_means = classes_long.groupBy("class_id").agg(
        *[F.avg(k).alias(f"{k}_mean") for k in kinds], F.stddev_pop("f1").alias("f1_std"))
    cells = wide.agg(*[F.sum(_cell(i, j)).alias(_cell(i, j)) for i in range(classes) for j in range(classes)])
    total = cells.select(F.inline(F.array(*[
        F.struct(F.lit(names[i]).alias("t"), F.lit(names[j]).alias("p"), F.col(_cell(i, j)).alias("n"))
        for i in range(classes) for j in range(classes)]))).where("n > 0").withColumn("cell", F.concat_ws(">", "t", "p"))
    top = total.where("t <> p").orderBy(F.desc("n"), "t", "p").limit(k)
    first = preds.where(F.col("seed") == preds.agg(F.min("seed").alias("s")).select("s").scalar())
    none = F.lit("")
    same = lambda *keys: {key: key for key in keys}
    return (
        rows(scored, "seed", F.col("seed"), **same("macro_f1", "accuracy", "balanced_accuracy"))
        .unionByName(rows(means, "seed_mean", none, **same("macro_f1", "macro_f1_std", "balanced_accuracy", "accuracy")))
        .unionByName(rows(class_means, "per_class", F.get(label, F.col("class_id")),
                          **same("precision_mean", "recall_mean", "f1_mean", "f1_std")))
        .unionByName(rows(total, "confusion_total", F.col("cell"), n="n"))
        .unionByName(rows(top, "top_confusions", F.col("cell"), n="n"))
        .unionByName(rows(per_subject_over_seeds(preds, classes), "per_subject", F.col("subject_id"), **same(
            "sample_count", "fixed_macro_f1_mean", "fixed_macro_f1_std", "present_macro_f1_mean", "present_macro_f1_std")))
        .unionByName(rows(test_majority(first, classes), "majority_baseline", none, **same("accuracy", "macro_f1", "balanced_accuracy")))
    )
