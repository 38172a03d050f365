"""Ranked search against scoring every document by hand, and the bounds of the two hierarchies."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tidegrid.llm import ranking
from tidegrid.llm.ranking import FAN, Best, Block

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def by_hand(docs, items, k=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    documents, words = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    result = []
    for item, text in items:
        scores = []
        for i, counts in held:
            m = 100 - 75 + (75 * sum(counts.values()) * documents) // max(1, words)
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                        for t in terms(text) if t in counts)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        result += [(item, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(result, key=repr)


def ranked(spark, docs, items, **settings):
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = ranking.rank_documents(d, b, **settings).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


@pytest.fixture(scope="module")
def searched(texts):
    rng = random.Random(8)
    docs = [*texts, texts[3], (None, texts[4][1]), (None, None)]
    items = [(k, " ".join(rng.choice(docs)[1].split()[:30]) if k % 3 else rng.choice(texts[:40])[1]) for k in range(25) for docs in [texts[:40]]]
    items += [(100, None), (101, ""), (102, "nowhere to be found: zzzqq"), (None, "river stone lamp"), (5, items[5][1]), (103, texts[-4][1] or "the"),
              (104, "日本語 текст " * 40), (105, "IT'S\x00DON'T 12ab")]
    return docs, items


def test_the_best_documents_of_every_item(spark, searched):
    docs, items = searched
    assert ranked(spark, docs, items) == by_hand(docs, items)


def test_blocks_and_first_bounds_do_not_change_a_result(spark, searched):
    docs, items = searched
    want = by_hand(docs, items, 3)
    assert ranked(spark, docs, items, k=3, block_items=4, first_share=0.5) == want
    assert ranked(spark, docs, items, k=3, block_terms=40, first_share=0.0) == want


def test_many_copies_tie_by_id(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(i, "others") for i in range(1000, 1200)]
    got = ranked(spark, docs, [(1, "words")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 11)) and len({r[3] for r in got}) == 1


def test_no_items_and_no_documents(spark, searched):
    docs, items = searched
    assert ranked(spark, docs, []) == [] and ranked(spark, [], items) == []
    assert ranked(spark, [(1, None), (2, " - ")], items) == []


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_pruning_is_exact_and_prunes(kind):
    """Clustered documents: most are never scored, and the best are those of the full product."""
    rng = np.random.default_rng(4)
    groups, per, width = 64, 64, 200
    leaves, subjects = np.zeros((groups * per, width), kind), [rng.choice(width, 12, replace=False) for _ in range(groups)]
    for g, subject in enumerate(subjects):
        leaves[g * per: (g + 1) * per, subject] = rng.integers(10, 50, (per, 12))
    counts = np.zeros((40, width), kind)
    for k, r in enumerate(counts):
        r[subjects[k % groups]] = rng.integers(1, 4, 12)
    counts = counts[ranking._alike_next(counts.astype(float))]
    block = Block(np.arange(40), np.arange(width, dtype=np.uint64), np.ones(width, np.int64), ranking._maxima(counts), 1, 1)
    best, scored = Best(40, 5, np.ones(40, kind)), 0
    for at in range(0, len(leaves), 512):
        ids = np.arange(at, min(at + 512, len(leaves)))
        scored += ranking._search(block, leaves[ids], ids, np.ones(len(ids), bool), best)
    full = (leaves @ counts.T).astype(np.int64)
    for k in range(40):
        want = sorted((-s, i) for i, s in enumerate(full[:, k]) if s > 0)[:5]
        assert [(-s, d) for s, d in zip(best.score[best.item == k], best.doc[best.item == k])] == want
    assert scored < 0.5 * full.size


def test_every_node_holds_the_largest_coordinates():
    leaves = np.random.default_rng(2).integers(0, 9, (FAN * FAN + 3, 7))
    levels = ranking._maxima(leaves)
    assert len(levels[-1]) == 1 and (levels[-1][0] == leaves.max(0)).all()
    assert all((levels[1][k] == leaves[FAN * k: FAN * (k + 1)].max(0)).all() for k in range(len(levels[1])))
