"""Chunked plans against plain windows and NumPy, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.operators import intervals, ordering
from tidegrid.plans.chunked import bounded_chunks, cut, digits_of, digits_of_double, number_rows, with_history
from tidegrid.plans.medians import exact_median


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i, rng.choice("abc"), rng.randrange(1000)) for i in range(n)]


SCHEMA = "key string, row_no long, split string, value long"


@pytest.mark.parametrize("length,partitions", [(1, 2), (7, 5), (64, 3), (100000, 1)])
def test_history_equals_a_plain_window(rows, length, partitions):
    df = rows(skewed(), SCHEMA, partitions)
    got = with_history(df, ["key"], ["row_no"], cut("row_no", length), ["split", "value"], "p", {"top": F.col("value")})
    w = W.partitionBy("key").orderBy("row_no")
    want = df.withColumn("p", F.lag(F.struct("split", "value")).over(w)).withColumn(
        "top", F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1)))
    pick = lambda d: sorted(d.select("row_no", "p.split", "p.value", "top").collect())
    assert [tuple(r) for r in pick(got)] == [tuple(r) for r in pick(want)]


@pytest.mark.parametrize("length", [1, 13, 4096])
def test_numbering(rows, length):
    df = rows(skewed(), SCHEMA)
    got = number_rows(df, ["key"], ["row_no"], cut("row_no", length), "n")
    want = df.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("row_no")) - 1)
    assert sorted(got.select("row_no", "n").collect()) == sorted(want.select("row_no", "n").collect())


@pytest.mark.parametrize("bucket", [1, 10, 65536])
def test_median(rows, bucket):
    data = skewed(2001)
    got = {r["key"]: r["m"] for r in exact_median(rows(data, SCHEMA), ["key"], "value", "m", bucket).collect()}
    for key in {d[0] for d in data}:
        assert got[key] == np.median([d[3] for d in data if d[0] == key])


def test_leakage_looks_at_the_last_seen_value(rows):
    data = [("D", 2, "train", 0), ("D", 3, "val", 0), ("D", 4, "val", 0), ("E", 5, "val", 0), ("D", 6, "train", 0)]
    for length in (1, 2, 100):
        out = ordering.changed_from_previous(rows(data, SCHEMA), ["key"], "split", chunk_rows=length)
        assert {r["row_no"] for r in out.where("changed").collect()} == {3, 6}


def test_repeats(rows):
    data = [("a", 2, "x", 0), ("a", 9, "x", 0), ("b", 3, "x", 0), ("a", 5, "x", 0)]
    for length in (1, 4, 100):
        out = ordering.flag_repeats(rows(data, SCHEMA), ["key"], chunk_rows=length)
        assert {r["row_no"] for r in out.where("is_repeat").collect()} == {5, 9}


def test_even_sample_matches_linspace(rows):
    rng = random.Random(3)
    labels = [0 if rng.random() < 0.7 else rng.randrange(1, 3) for _ in range(500)]
    df = rows([(i, v) for i, v in enumerate(labels)], "row_no long, label int")
    got = {r["row_no"] for r in ordering.stratified_even_sample(df, "label", 20, 3, chunk_rows=16).collect()}
    want = set()
    for label in range(3):
        candidates = [i for i, v in enumerate(labels) if v == label]
        quota = 20 // 3 + (1 if label < 20 % 3 else 0)
        want |= {candidates[int(p)] for p in np.linspace(0, len(candidates) - 1, num=quota, dtype=int)}
    assert got == want
    for broken in (df.where("label <> 2"), df.where("label <> 1 or row_no < 3")):
        with pytest.raises(Exception, match="too few rows of label"):
            ordering.stratified_even_sample(broken, "label", 60, 3, chunk_rows=16).collect()


def test_hot_key_is_spread_over_tasks(spark, rows):
    """One key with all rows: no output partition of the window holds most of them."""
    df = rows([("hot", i, "a", i) for i in range(4000)], SCHEMA)
    out = with_history(df, ["key"], ["row_no"], cut("row_no", 100), ["value"], "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__chunk" in plan
    parts = df.withColumn("c", cut("row_no", 100)).repartition(8, "key", "c").groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).first()[0] < 2000


def clocked(n=6000):
    """A third of the rows in one key; of those half with one clock, the others spread or within one second."""
    rng = random.Random(6)
    out = []
    for i in range(n):
        if i % 3:
            out.append((f"k{rng.randrange(40)}", rng.randrange(10**12), i))
        elif i % 2:
            out.append(("hot", 5_000_000_000, i - n // 2))
        else:
            out.append(("hot", 7_200_000_000 + rng.randrange(900_000) if i % 4 else rng.randrange(10**12), i))
    return out


def clock_digits():
    clock = F.col("clock")
    return [cut(clock, 3_600_000_000), cut(F.pmod(clock, F.lit(3_600_000_000)), 1_000_000), F.pmod(clock, F.lit(1_000_000)), *digits_of(F.col("id"))]


@pytest.mark.parametrize("limit", [16, 100, 100_000])
def test_no_chunk_over_its_rows_with_a_hot_key_and_equal_clocks(rows, limit):
    df = rows(clocked(), "key string, clock long, id long", 4)
    parts = bounded_chunks(df, ["key"], clock_digits(), limit)
    assert parts.count() == df.count()
    assert parts.groupBy("key", "__part").count().agg(F.max("count")).first()[0] <= limit
    got = number_rows(parts, ["key"], ["clock", "id"], F.col("__part"), "n")
    want = df.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("clock", "id")) - 1)
    pick = lambda d: sorted(tuple(r) for r in d.select("id", "n").collect())
    assert pick(got) == pick(want)


def test_runs_are_deep(rows):
    """Cells that are cut give about as many chunks as their rows need, not one per value."""
    df = rows([("hot", i, i) for i in range(20_000)], "key string, clock long, id long")
    parts = bounded_chunks(df, ["key"], clock_digits(), 1000)
    assert 20 <= parts.select("__part").distinct().count() <= 45


def test_digits_sort_like_their_number(rows):
    values = [0, 1, -1, 2**63 - 1, -2**63, 65535, 65536, -65536, 10**12]
    df = rows([(v,) for v in values], "v long")
    assert [r.v for r in df.orderBy(*digits_of(F.col("v"))).collect()] == sorted(values)
    reals = [0.0, -0.5, 0.25, 1e9 + 0.125, -1e9 - 0.125, 3.0000001, 3.0]
    df = rows([(v,) for v in reals], "v double")
    assert [r.v for r in df.orderBy(*digits_of_double(F.col("v"))).collect()] == sorted(reals)


@pytest.mark.parametrize("limit", [8, 1 << 16])
def test_union_length_with_very_many_close_starts(rows, limit):
    rng = random.Random(2)
    data = [("hot", a, a + rng.random() * 0.01) for a in (rng.random() * 3 for _ in range(600))] + [("b", 70000.0 * i, 70000.0 * i + 1) for i in range(9)]
    got = {r.key: r.covered for r in intervals.covered_length(rows(data, "key string, s double, e double"), ["key"], "s", "e", chunk_rows=limit).collect()}
    total, reach = 0.0, float("-inf")
    for _, a, b in sorted(d for d in data if d[0] == "hot"):
        total += max(0.0, b - max(a, reach))
        reach = max(reach, b)
    assert got["hot"] == pytest.approx(total) and got["b"] == 9
