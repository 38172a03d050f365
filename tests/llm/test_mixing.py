"""Sources mixed to weights: apportionment against every quotient, spans against targets, SQL on odd rows."""

import random
import re

import duckdb
import pytest

from tidegrid.llm import mixing, oracles


def highest(claims, caps, seats):
    """Seats by the highest quotients, one by one."""
    got = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = min((k for k in claims if got[k] < caps[k]), key=lambda k: (-claims[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got


@pytest.mark.parametrize("case", range(3))
def test_seats_go_to_the_highest_quotients(spark, case):
    rng = random.Random(case)
    rows, want = [], {}
    for group in range(6):
        caps = {k: rng.choice([1, 2, 3, 40, 400]) for k in range(rng.choice([1, 2, 9, 60]))}
        claims = {k: rng.choice([1.0, rng.random(), 0.25]) * c for k, c in caps.items()}
        seats = round(sum(claims.values()))
        want[group] = highest(claims, caps, seats)
        rows += [(group, k, claims[k], caps[k], seats) for k in caps]
    table = spark.createDataFrame(rows, "of int, k int, claim double, cap long, seats long").repartition(3)
    got = {}
    for r in mixing.apportion(table, ["of"], "k").collect():
        got.setdefault(r.of, {})[r.k] = r.quota
    assert got == want


def test_targets_fill_by_weight_up_to_twice(spark):
    held = {"a": 100, "b": 1000, "c": 300, None: 50, "d": 0}
    rows = spark.createDataFrame(list(held.items()), "source string, words long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    # 2175 words; a stops at 200, c and d weigh 1 and 5, the null source comes last with weight 2
    weight = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    left, open_ = 1.5 * sum(held.values()), dict(weight)
    want = {}
    while True:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in open_ if share[k] > 2 * held[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 2.0 * held[k]
            left -= want[k]
            del open_[k]
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(2175)


def test_the_mix_of_odd_rows(docs):
    """Many small shards; nulls, repeated rows and long texts among them."""
    rows = mixing.mix_documents(docs, bundle_rows=4, block_words=5).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes.setdefault(r.doc_id, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    by_source = {}
    for r in rows:
        assert r["size"] in sizes[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        assert r.taken == sum((s["stop"] - s["start"]) * s["times"] for s in r.spans)
        assert all(0 <= s["start"] < s["stop"] <= r["size"] and s["times"] in (1, 2) for s in r.spans)
        assert all(a["stop"] <= b["start"] for a, b in zip(r.spans, r.spans[1:]))
        held = by_source.setdefault(r.source, [0, 0, r.target, r.source_size])
        held[0] += r.taken
        held[1] += r["size"]
    for taken, size, target, source_size in by_source.values():
        assert size == source_size and abs(taken - target) <= 0.03 * target + 10


def test_a_rerun_agrees_whatever_the_layout(docs):
    first, second = (sorted(map(repr, mixing.mix_report(d).collect())) for d in (docs.repartition(7), docs.coalesce(1)))
    assert first == second


def test_the_sql_agrees_on_odd_rows(docs, tmp_path):
    odd = docs.withColumn("source", mixing.F.expr("case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then '' else source end"))
    odd.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    result = con.execute(oracles.SAINTE_LAGUE)
    names = [c[0] for c in result.description]
    want = sorted(repr([dict(zip(names, r))[c] for c in sorted(names)]) for r in result.fetchall())
    got = mixing.mix_report(odd)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in got.collect()) == want


def test_no_rows_no_mix(empty):
    assert mixing.mix_documents(empty).collect() == []


def test_texts_without_words_are_not_taken(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, " ", "a"), (2, " ", "a"), (None, "", None)], "doc_id long, text string, source string")
    got = mixing.mix_documents(rows).collect()
    assert len(got) == 4 and all(r.taken == 0 and r.target == 0 and r.spans == [] for r in got)
