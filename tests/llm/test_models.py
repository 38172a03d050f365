"""Toxicity, languages, neighbours, host rules, shards and the pipeline against brute force or held-out rows."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import sentence
from tidegrid.llm import host_rules, language_id, nn_descent, sharding, toxicity


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        words = sentence(rng, rng.randrange(20, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for bad in rng.sample(["blarg", "zonkhead", "vilefoo", "grumpel"], 3):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), "n"))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, "n"), (901, "", "n"), (902, "You ZONKHEAD!!! you vilefoo, blarg", "n"), (903, "!!! ??? ...", "n"), (600, rows[0][1], "n")]
    labels += [(901, 1, None), (None, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [r for i, r in got.items() if r.held_out and i < 600]
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in held]) > 0.95
    assert got[902].predicted == 1 and got[900].score == got[901].score and got[900].predicted == 0


def test_held_out_labels_teach_nothing(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r.doc_id: r.score for r in toxicity.toxicity_report(docs, x).collect()} for x in (labels, turned))
    assert first == second


def test_toxicity_without_labels(labelled, empty):
    docs, labels = labelled
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


@pytest.mark.parametrize("rare", [0, 1])
def test_few_rows_of_a_label_still_teach(spark, rare):
    """Six rows of one label that teach among 594 of the other; the sample of 40 rows keeps all six."""
    rng, teaching = random.Random(9), [i for i in range(900) if crc(i) % 5]
    few = set(teaching[50:600:100])
    rows, labels = [], []
    for i in range(900):
        toxic = (i in few or i >= 880) == bool(rare)
        words = sentence(rng, 30).split()
        for bad in ["blarg", "zonkhead", "vilefoo"] * toxic:
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), int(toxic)))
        if i < 880:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int").repartition(2)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs.drop("truth"), marks, 40).toPandas()
    assert set(sample[sample.label == rare].doc_id) == few and len(sample) < 80
    known = sum(i < 880 for i in teaching)
    assert 0.5 * known < sample.weight.sum() < 1.7 * known
    got = toxicity.score_toxicity(docs, marks).where("predicted = truth").count()
    assert got >= 890


def test_disguised_words_show():
    lexicon = toxicity.Lexicon(toxicity._names(["idiot"]), toxicity._names([]))
    names = toxicity.FEATURES
    plain, hidden, none = toxicity.text_features(["you idiot now", "you 1d1ot i.d.i.o.t", ""], lexicon)
    assert plain[names.index("strong_rate")] > 0 == plain[names.index("hidden_rate")]
    assert hidden[names.index("hidden_rate")] > 0 == hidden[names.index("strong_rate")]
    assert plain[names.index("near_second_person")] > 0 and not none.any()


SYLLABLES = {"aa": "ka lo mi tu ren", "bb": "sch ung ver ein lich", "cc": "eau que oi ment tre"}


def test_languages_of_held_out_rows(spark, empty):
    rng, rows = random.Random(4), []
    for i in range(300):
        lang = sorted(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang if i % 10 else None, "s"))
    rows += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "123 !!", "cc", "s"), (903, "ΩЖ中" * 30, None, "s"), (904, "ka" * 50000, "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = {r.doc_id: r for r in language_id.language_report(docs).collect()}
    assert all(r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([r.lang_pred == sorted(SYLLABLES)[i % 3] for i, r in got.items() if i < 300]) > 0.97
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred in SYLLABLES and got[903].rejected
    assert language_id.language_report(empty.drop("score", "kept")).count() == 0


def test_languages_of_rows_without_an_id_and_of_repeated_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(SYLLABLES[lang].split()) * 2 for _ in range(20)), lang)
            for i, lang in enumerate(sorted(SYLLABLES) * 40)]
    rows += [rows[5]] * 3 + [(None, rows[6][1], rows[6][2]), (None, None, None)]
    got = language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows)
    again = [r for r in got if r.doc_id == 5]
    assert len(again) == 4 and len({(r.lang_pred, r.score) for r in again}) == 1
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == sorted([rows[6][2], "und"])


def test_kneser_ney_shares_add_up(spark):
    """Over all next characters seen anywhere, a context's probabilities stay under one and near it."""
    rows = spark.createDataFrame([(1, "x", "abab abba baab abc cab"), (2, "x", "bca acb")], "doc_id long, lang string, text string")
    models = language_id.fit(rows)
    ends = sorted({c for w in "abab abba baab abc cab bca acb".split() for c in w})
    spelled = [list(map(ord, " ab" + c)) for c in [*ends, " "]]
    flat = np.array([p for s in spelled for p in s], np.uint32)
    word = np.repeat(np.arange(len(spelled)), 4)
    bits = models.bits(flat, word, len(spelled))[:, 0]
    start = models.bits(flat[:3], word[:3], 1)[0, 0]
    total = np.exp2(start - bits).sum()
    assert 0.9 < total < 1.0001


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    points = (rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    points[400:520] = points[0]
    rows = [(i, p.tolist(), 1) for i, p in enumerate(points)]
    rows += [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] * 16, 1), (2300, [1.0, None] * 8, 1), (2400, [1.0] * 3, 1), (2500, [], 1), rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    got = collections.defaultdict(list)
    for r in nn_descent.neighbour_report(table).collect():
        got[r.query_id].append(r)
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        d = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert np.allclose([r.score for r in found], d[[r.vec_id for r in found]], rtol=0, atol=1e-12)
        assert [r.vec_id for r in found] == [r.vec_id for r in sorted(found, key=lambda r: (r.score, r.vec_id))]
        hits += len({r.vec_id for r in found} & set(best.tolist()))
    assert hits >= 0.95 * 150
    zero = [r.vec_id for r in got[0]]
    assert zero == list(range(400, 410))


def test_overfull_leaves_are_split_by_planes(spark):
    """With few sampled nodes a leaf holds many blocks; most true neighbours still meet, which hashing would part."""
    rng = np.random.default_rng(8)
    points = (5 * rng.normal(size=(100, 8))[np.arange(6000) % 100] + rng.normal(size=(6000, 8))).astype(np.float32)
    nodes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "node long, vector array<float>")
    graph = nn_descent.start_graph(nodes, k=10, trees=3, block=64, sample=64).toArrow()
    found = collections.defaultdict(set)
    for v, u in zip(graph.column("v").to_pylist(), graph.column("u").to_pylist(), strict=True):
        found[v].add(u)
    d = ((points[:300, None].astype(float) - points[None]) ** 2).sum(axis=2)
    d[np.arange(300), np.arange(300)] = np.inf
    best = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(found[i] & set(best[i].tolist())) / 10 for i in range(300)]) > 0.5
    rows = nn_descent.blocks(points, 64, 1)
    assert sorted(np.concatenate(rows).tolist()) == list(range(6000)) and max(map(len, rows)) <= 128
    assert max(map(len, nn_descent.blocks(np.ones((1000, 4), np.float32), 64, 1))) <= 128


def test_search_goes_on_until_nothing_near_is_unopened(spark):
    """A chain of nodes: the nearest lie many steps from the entry."""
    n = 14
    nodes = spark.createDataFrame([(i, [float(n - i), 1.0]) for i in range(n)], "node long, vector array<float>")
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "v long, u long, d double")
    queries = spark.createDataFrame([(n, [0.0, 1.0])], "q long, vector array<float>")
    entries = spark.createDataFrame([(n, 0)], "q long, u long")
    found = nn_descent.greedy_search(queries, nodes, graph, entries, k=2, beam=2, remembered=8)
    assert found.orderBy("d").first().u == n - 1


def test_few_or_no_neighbours(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in nn_descent.neighbour_report(table).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 2 ** 0.5), (100, 1, 0, 0.0), (100, 2, 1, 2 ** 0.5)]
    assert nn_descent.neighbour_report(table.limit(0)).count() == 0


def test_vectors_that_take_no_part(spark):
    """Null, zero, empty and non-finite vectors are neither queries nor candidates; so are rows without an id."""
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0, 0.0], [], [None, 1.0], [nan, 1.0], [inf, 1.0]]
    rows = [(0, [1.0, 0.0]), (7, [3.0, 4.0]), (None, [1.0, 0.0]), *[(200 + i, v) for i, v in enumerate(bad)], (300, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in nn_descent.neighbour_report(table).collect()) == [(0, 1, 7, 20 ** 0.5)]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i: i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_document_counts(docs, texts):
    got = host_rules.judge_documents(docs).collect()
    assert len(got) == docs.count()
    by_id = dict([*texts, (None, "no id here\nat all")])
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(by_id[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_failed)


def test_bad_hosts_fall_and_small_ones_are_drawn_in(spark, empty):
    rng = random.Random(1)
    good, bad = sentence(rng, 40), "few words only"
    rows = [(i, bad if i % 20 else good, "bad") for i in range(200)] + [(1000 + i, good if i % 20 else bad, f"good{i % 5}") for i in range(2000)]
    rows += [(5000, bad, "once"), (5001, good, None)]
    got = {r.doc_id: r for r in host_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].host_failed and not got[0].base_failed and not got[0].kept
    assert not got[1001].host_failed and got[1001].kept and got[5001].kept
    assert host_rules.judge_documents(empty).count() == 0


def check_shards(rows, shards=16):
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_are_near_equal(spark):
    rng = random.Random(9)
    rows = [(rng.choice([7, rng.randrange(10**6)]), "é" * rng.randrange(200)) for _ in range(5000)] + [(None, None), (None, "x"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign_shards(docs, range_rows=400).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = check_shards(got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_no_range_is_overfull(spark):
    docs = spark.createDataFrame([(5, "same")] * 3000, "doc_id long, text string").repartition(4)
    _, held = sharding.cut_ranges(sharding.size_records(docs), range_rows=200)
    assert sum(n for _, n in held) == 3000 and max(n for _, n in held) <= 200


def test_few_rows_and_none(docs, empty):
    check_shards(sharding.assign_shards(docs).collect())
    assert sharding.assign_shards(empty).count() == 0


def test_pipeline_stages(spark, docs, labelled, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)
    toxic = labelled[0].where("doc_id < 600").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("en").alias("lang"),
                                                     F.lit("t").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    table.union(toxic).write.parquet(f"{tmp_path}/documents.parquet")
    labelled[1].withColumn("doc_id", F.col("doc_id") + 10_000).write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = stage.count()
    for number, (name, run) in enumerate(corpus_pipeline.STAGES):
        run(spark, stage, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        if number < 4:
            assert stage.columns == columns
            assert stage.where("n_chars <> char_length(text)").count() == 0
        if name == "toxicity":
            gone = before - stage.count()
            assert 60 <= gone <= 130 and stage.where("doc_id < 10000").count() == docs.where("doc_id is not null").count()
        if name == "line_dedup":
            kept = stage.count()
            assert kept == before - gone
        if name == "near_dedup":
            kept, fewer = stage.count(), kept
            assert kept <= fewer
    assert stage.where("piece = 0").count() == kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stage.count()
