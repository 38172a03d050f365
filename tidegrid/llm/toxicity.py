"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and beginnings of words far more frequent in toxic than in
other labelled texts, whatever the language. Features are densities of its words, their closeness to second-person
words, and rates of capitals, punctuation and obfuscation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.characters import code_points, runs, tables, word_names
from tidegrid.llm.common import byte_slices, staged
from tidegrid.llm.textbytes import U64, mix

#: Bounds of the fit: labelled rows used, drawn per label by a hash of doc_id, and words of the lexicon.
LEARN_ROWS, LEXICON_WORDS = 30_000, 5_000
TREES, DEPTH, STEP = 20, 3, 0.3
#: Words of the second person in the languages at hand.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre "
                 "vos tú ti tus usted ustedes vosotros vuestro").split()
#: Digits and signs that stand in for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
NEAR = 4
#: Letters of a stem, which stands for all words of five letters or more that begin with it; and its mark in the lexicon.
STEM, STEM_MARK = 4, "-"
FEATURES = ("strong_rate", "strong_count", "weak_rate", "weak_count", "hidden_rate", "second_person_rate", "near_second_person",
            "capital_rate", "capital_words", "exclaim_rate", "question_rate", "other_punctuation_rate", "doubled_punctuation_rate",
            "inner_sign_rate", "inner_digit_rate", "stretched_rate", "words", "word_length")


@dataclass
class Lexicon:
    strong: np.ndarray
    weak: np.ndarray


def _names(words: list[str]) -> np.ndarray:
    """Sorted names of words and of marked stems."""
    points, offsets = code_points(words)
    ends = offsets[1:]
    stems = np.fromiter((w.endswith(STEM_MARK) for w in words), bool, len(words))
    return np.sort(np.concatenate((word_names(points, offsets[:-1][~stems], ends[~stems]),
                                   _stem_names(points, offsets[:-1][stems], ends[stems] - 1))))


def _stem_names(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ~word_names(points, starts, np.minimum(ends, starts + STEM))


def _among(names: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(names), bool)
    return listed[np.minimum(np.searchsorted(listed, names), len(listed) - 1)] == names


def text_features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """(texts, features); all zero for a text without a character."""
    letter, upper, lower = tables()
    n = len(texts)
    points, offsets = code_points(texts)
    small, is_letter = lower[points], letter[points]
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    tally = lambda owner, weights=None: np.bincount(owner, weights=weights, minlength=n).astype(float)
    starts, ends, text = runs(is_letter, offsets)
    names = word_names(small, starts, ends)
    words, letters, size = tally(text), tally(text_of[is_letter]), np.diff(offsets).astype(float)
    per_word, per_letter, per_sign = (1 / np.maximum(x, 1) for x in (words, letters, size))
    second, long = _among(names, _names(SECOND_PERSON)), ends - starts > STEM
    stems = _stem_names(small, starts, ends)
    strong, weak = (_among(names, w) | long & _among(stems, w) for w in (lexicon.strong, lexicon.weak))

    near = np.zeros(len(names), bool)
    for k in range(1, NEAR + 1):
        for a, b in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            if len(names) > k:
                near[a] |= second[b] & (text[a] == text[b])

    blank = np.isin(points, np.array([9, 10, 11, 12, 13, 32, 0xA0], np.uint32))
    disguise = np.where(is_letter, small, 0)
    for sign, meant in LOOKALIKES.items():
        disguise[points == ord(sign)] = ord(meant)
    held = blank | (disguise > 0)
    packed_offsets = np.concatenate(([0], np.cumsum(held)))[offsets]
    packed = np.where(blank, 0, disguise)[held]
    plain = runs(packed > 0, packed_offsets)
    shown = tally(plain[2][_among(word_names(packed, *plain[:2]), lexicon.strong)])

    digit = (points >= 48) & (points <= 57)
    sign = ~is_letter & ~digit & ~blank
    inner = np.zeros(len(points), bool)
    same = np.zeros(len(points), bool)
    if len(points) > 2:
        inner[1:-1] = is_letter[:-2] & is_letter[2:] & (text_of[:-2] == text_of[2:])
        same[2:] = (small[2:] == small[1:-1]) & (small[1:-1] == small[:-2]) & (text_of[2:] == text_of[:-2]) & is_letter[2:]
    doubled = np.zeros(len(points), bool)
    doubled[1:] = sign[1:] & sign[:-1] & (text_of[1:] == text_of[:-1]) if len(points) else False
    capital = upper[points]
    capitals = np.concatenate(([0], np.cumsum(capital)))
    shouted = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    hits, few, whole = tally(text[strong]), tally(text[weak]), tally(text[_among(names, lexicon.strong)])
    return np.stack([
        hits * per_word, np.log1p(hits), few * per_word, np.log1p(few), np.maximum(0, shown - whole) * per_word,
        tally(text[second]) * per_word, tally(text[strong & near]) * per_word,
        tally(text_of[capital]) * per_letter, tally(text[shouted]) * per_word,
        tally(text_of[points == ord("!")]) * per_sign, tally(text_of[points == ord("?")]) * per_sign, tally(text_of[sign]) * per_sign,
        tally(text_of[doubled]) * per_sign, tally(text_of[inner & sign]) * per_word, tally(text_of[inner & digit]) * per_word,
        tally(text_of[same]) * per_word, np.log1p(words), letters * per_word], axis=1)


def learn_lexicon(rows: DataFrame, words: int = LEXICON_WORDS) -> Lexicon:
    """Words by the number of toxic and other labelled texts of (text, label) that hold them; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, _, lower = tables()
        for batch in batches:
            for part in byte_slices(batch):
                points, offsets = code_points(part.column("text").to_pylist())
                small = lower[points]
                starts, ends, text = runs(letter[points], offsets)
                names = word_names(small, starts, ends)
                long = np.flatnonzero(ends - starts > STEM)
                names = np.concatenate((names, _stem_names(small, starts[long], ends[long])))
                text, starts = np.concatenate((text, text[long])), np.concatenate((starts, starts[long]))
                stem = np.arange(len(names)) >= len(ends)
                ends = np.concatenate((ends, starts[~stem][long] + STEM))
                _, once = np.unique(mix(names) + text.astype(U64), return_index=True)
                label = part.column("label").to_numpy()[text[once]]
                codes, kinds = pd.factorize(names[once])
                first = np.zeros(len(kinds), np.int64)
                first[codes[::-1]] = once[::-1]
                spelled = [small[starts[i]: ends[i]].tobytes().decode("utf-32-le", "replace") + STEM_MARK * bool(stem[i]) for i in first]
                toxic = np.bincount(codes, weights=label, minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), pa.array(toxic), pa.array(
                    np.bincount(codes, minlength=len(kinds)) - toxic)], names=["word", "toxic", "other"])

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    odds = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
    counted = rows.select("text", "label").mapInArrow(run, "word string, toxic long, other long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    least = min(5, max(1, toxic // 4))  # with few toxic texts a word need not be in five of them
    listed = counted.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds >= 6").orderBy(
        F.desc(F.col("toxic") * F.log("odds")), "word").limit(words).collect()
    strong = [r["word"] for r in listed if r["odds"] >= 60]
    return Lexicon(_names(strong), _names([r["word"] for r in listed if r["odds"] < 60]))


def with_features(docs: DataFrame, lexicon: Broadcast, output: str = "features") -> DataFrame:
    """``docs`` with an array of features per row; all columns stay."""
    columns = [c for c in docs.columns if c != output]
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                found = text_features(part.column("text").to_pylist(), lexicon.value)
                at = np.arange(part.num_rows + 1, dtype=np.int32) * found.shape[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.ListArray.from_arrays(at, pa.array(found.ravel()))],
                                                 names=[*columns, output])

    return docs.select(*columns).mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, text, label, weight) of at most about ``rows`` labelled documents that are not held out.

    The bound holds per label: half of it at least for either, so all rows of a rare label are taken up to
    that. ``weight`` is the number of labelled documents a row stands for. The sample's ids are few by the
    bound, so they go to the documents, not the texts to the labels.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label"))
    there = staged(docs.select("doc_id").join(known, "doc_id"), "known")
    counts = {r["label"]: r["n"] for r in there.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = min(min(counts.get(0, 0), counts.get(1, 0)), rows // 2)
    share = {label: min(1.0, max(rows // 2, rows - few) / max(1, n)) for label, n in counts.items()}
    part = F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    drawn = there.where(F.expr("(xxhash64(doc_id) & 1048575) / 1048576D") < part).distinct()
    return staged(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("weight", 1 / part), "labelled")


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, trees: int = TREES) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Scores come from the whole text alone; null and empty texts have zero features and the score
    those get. Labels teach only by rows that are not held out; a quarter of them calibrates, weighted
    to the shares of the labels. If a label has too few rows for two parts, all rows serve both.
    Only without both labels is the score their mean, or 0 without any. Repeated rows get equal
    rows. Input columns named like the results are replaced; other columns are kept.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")))
    sample = labelled_sample(docs, labels, rows)
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    result = lambda df, score: df.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    rare = min(seen.get(0, 0), seen.get(1, 0))
    if not rare:
        return result(docs, F.lit(float(seen.get(1, 0) / max(1, sum(seen.values())))))
    context = docs.sparkSession.sparkContext
    lexicon = context.broadcast(learn_lexicon(sample))
    vector = array_to_vector("features").alias("features")
    ready = staged(with_features(sample, lexicon).select("doc_id", "label", "weight", "features"), "features")
    part = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4))
    ordered = ready.repartition(4, "doc_id").sortWithinPartitions("doc_id", "features").select(F.col("label").cast("double"), "weight", vector, part.alias("fold"))
    parts = ordered.groupBy("label", (F.col("fold") == 0).alias("apart")).count().collect()
    split = len(parts) == 4 and min(r["count"] for r in parts) >= 5
    learning, calibrating = (ordered.where("fold <> 0"), ordered.where("fold = 0")) if split else (ordered, ordered)
    trees_model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=max(1, min(10, rare // 4)), seed=7).fit(learning)
    calibration = trees_model.transform(calibrating).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    smooth = IsotonicRegression(labelCol="label", featuresCol="raw", weightCol="weight").fit(calibration)
    columns = docs.columns
    featured = with_features(docs, lexicon, "__features").withColumn("__vector", array_to_vector("__features")).drop("__features")
    names = {"probabilityCol": "__probability", "predictionCol": "__class", "rawPredictionCol": "__margin", "featuresCol": "__vector"}
    raw = trees_model.copy({getattr(trees_model, k): v for k, v in names.items()}).transform(featured)
    raw = raw.withColumn("__raw", vector_to_array("__probability")[1]).select(*columns, "__raw")
    done = smooth.copy({smooth.featuresCol: "__raw", smooth.predictionCol: "__score"}).transform(raw)
    return result(done, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__score")))).select(*columns, "score", "predicted")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs.select("doc_id", "text"), labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")
