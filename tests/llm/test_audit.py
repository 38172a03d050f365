"""The streamed filter audit against counting every order by hand, with ids that arrive in any order."""

import collections
import itertools
import re

import pytest

from tidegrid.llm import audit


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {name for name, fails in (
        ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", re.search("[#$%&*|]", text) is not None)) if fails}


def by_hand(rows, labels):
    """(part, order, step) to the seven counts, document by document."""
    low = {}
    for i, text, _ in rows:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    held = [(i, part or "", failures(text or "") | ({"E"} if i is not None and i > low[text or ""] else set())) for i, text, part in rows]
    result, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for k, name in enumerate(order):
            for part in {p for _, p, _ in held}:
                counts = [0] * 6
                for i, p, fails in held:
                    if p != part:
                        continue
                    gone, fails_here = bool(fails & set(order[:k])), name in fails
                    counts[0] += not gone and not fails_here
                    counts[1] += not gone and fails_here
                    counts[2] += gone and fails_here
                    counts[3] += fails == {name}
                    counts[4] += not gone and fails_here and i in good
                    counts[5] += not gone and fails_here and i in toxic
                result[part, "".join(order), k + 1] = counts
                shapley[part, name] += counts[1]
    return {key: (*counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in result.items()}


def report(spark, path, labels, **settings):
    rows = audit.audit_filters(spark, path, labels, **settings).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def table(texts):
    rows = [(i, t, ["en", "de", None, ""][(i or 0) % 4]) for i, t in [*texts, texts[3], (None, "no id"), (None, "no id"), (None, texts[5][1])]]
    rows += [(i, texts[5][1], "en") for i in range(400, 460)] + [(-7, texts[5][1], "fr"), (-7, texts[5][1], "de"), (450, "SHOUT # " * 120, "en")]
    labels = [(i, i % 2, i % 3) for i in range(0, 460, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (9999, 1, 1), (-7, 1, None)]
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("settings", [{"batch_files": 1, "bucket_rows": 5}, {"batch_files": 100}])
def test_every_order_and_step(spark, texts, tmp_path, settings):
    rows, labels = table(texts)
    docs = spark.createDataFrame([(*r, "x") for r in reversed(rows)], "doc_id long, text string, lang string, mask string")
    path = str(tmp_path / "documents.parquet")
    docs.orderBy(docs.doc_id.desc()).repartition(6).sortWithinPartitions(docs.doc_id.desc()).write.parquet(path)
    got = report(spark, path, spark.createDataFrame(labels, LABELS), **settings)
    assert got == by_hand(rows, labels)


def test_smaller_ids_that_come_later_take_masks_back(spark, tmp_path):
    """One file per id, largest first: each micro-batch retracts the mask of the one before."""
    path = str(tmp_path / "documents.parquet")
    for i in range(5, 0, -1):
        spark.createDataFrame([(i, "the same text", "en")], "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)
    changes = [tuple(r) for r in audit.stream_changes(spark, path, batch_files=1).collect()]
    assert sum(n < 0 for *_, n in changes) == 4
    final = collections.Counter()
    for i, _, mask, n in changes:
        final[i, mask] += n
    few = 1 | 0
    assert {k: n for k, n in final.items() if n} == {(1, few): 1} | {(i, few | audit.REPEAT): 1 for i in range(2, 6)}


def test_very_many_copies_do_not_all_reach_the_state(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'copy' as text", "'en' as lang").coalesce(2)
    arrived = audit.arrivals(docs, 64)
    assert arrived.where("text_key is not null").count() <= 2 * 2
    assert arrived.where("text_key is null").groupBy("bucket").count().count() == 64


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(path)
    assert report(spark, path, spark.createDataFrame([], LABELS)) == {}
