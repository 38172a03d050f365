"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of words, with a mark at both ends of a word.
All languages share, per order, one sorted array of n-gram hashes with a value per
language. A text goes to the language of lowest cross-entropy per character; a calibrated
limit on that entropy tells texts that none of the languages explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.characters import code_points, runs, tables, word_names
from tidegrid.llm.common import byte_slices, staged
from tidegrid.llm.textbytes import U64, join_names

ORDER = 4
#: Bounds of the fit: labelled rows per language, n-grams of the highest order kept per language.
TRAIN_ROWS, GRAMS = 20_000, 150_000
MARK = 0x20


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case, and start, end and text of each run of letters."""
    letter, _, lower = tables()
    points, offsets = code_points(texts)
    return lower[points], *runs(letter[points], offsets)


def _spelled(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of words, each between two marks, behind each other, and the word of each."""
    length = ends - starts + 2
    word = np.repeat(np.arange(len(starts)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    inner = (place > 0) & (place < length[word] - 1)
    spelled = np.full(len(word), MARK, np.uint32)
    spelled[inner] = points[starts[word[inner]] + place[inner] - 1]
    return spelled, word


def _grams(spelled: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every n-gram inside a word: its hash, its context's hash, its last place."""
    m = max(0, len(spelled) - n + 1)
    inside = word[:m] == word[n - 1:] if n > 1 else np.ones(m, bool)
    name = np.full(m, n, U64)
    context = name
    for k in range(n):
        context = name
        name = join_names(name, spelled[k: m + k].astype(U64) + U64(1))
    at = np.flatnonzero(inside)
    return name[at], context[at], at + n - 1


@dataclass
class Models:
    """Per order n: sorted n-gram hashes with discounted shares, sorted context hashes with back-off weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    alphabet: int = 1000

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], names: np.ndarray, default: float) -> np.ndarray:
        keys, values = table
        out = np.full((len(names), values.shape[1]), default, np.float32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
            hit = keys[at] == names
            out[hit] = values[at[hit]]
        return out

    def bits(self, spelled: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """(words, languages) bits of each spelled word, first mark not counted."""
        p = np.full((len(spelled), len(self.languages)), 1 / self.alphabet, np.float32)
        for n in range(1, ORDER + 1):
            name, context, at = _grams(spelled, word, n)
            p[at] = self._find(self.grams[n - 1], name, 0.0) + self._find(self.contexts[n - 1], context, 1.0) * p[at]
        cost = -np.log2(p)
        cost[np.concatenate(([True], word[1:] != word[:-1]))[: len(word)]] = 0
        bounds = np.searchsorted(word, np.arange(words + 1))
        sums = np.concatenate((np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)))
        return sums[bounds[1:]] - sums[bounds[:-1]]


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, total) of the highest order over rows of (lang, text): each task adds up its own n-grams first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                langs = np.array(part.column("lang").to_pylist(), object)
                texts = part.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    points, starts, ends, _ = _words([texts[i] for i in np.flatnonzero(langs == lang)])
                    spelled, word = _spelled(points, starts, ends)
                    name, _, at = _grams(spelled, word, ORDER)
                    _, first, n = np.unique(name, return_index=True, return_counts=True)
                    ends = at[first]
                    four = np.stack([spelled[ends - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4")
                    strings = [bytes(r).decode("utf-32-le") for r in four]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(n), pa.string()), pa.array(strings, pa.string()), pa.array(n, pa.int64())],
                        names=["lang", "gram", "total"])

    return rows.mapInArrow(run, "lang string, gram string, total long").groupBy("lang", "gram").agg(F.sum("total").alias("total"))


def _kneser_ney(grams: pd.DataFrame, languages: list[str]) -> Models:
    """Interpolated Kneser-Ney with one discount per language and order; lower orders count distinct left neighbours."""
    columns = {lang: i for i, lang in enumerate(languages)}
    per_order: list[tuple[dict, dict]] = [({}, {}) for _ in range(ORDER)]
    for lang, some in grams.groupby("lang"):
        level = dict(zip(some["gram"], some["total"]))
        for n in range(ORDER, 0, -1):
            counts = pd.Series(level, dtype=np.float64)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            context = pd.Series([g[:-1] for g in counts.index], index=counts.index)
            total = counts.groupby(context).sum()
            kinds = counts.groupby(context).size()
            shares = np.maximum(counts - discount, 0).to_numpy() / total.reindex(context).to_numpy()
            weights = (discount * kinds / total).clip(upper=1.0)
            held = per_order[n - 1]
            for g, v in zip(counts.index, shares):
                held[0].setdefault(g, np.zeros(len(languages), np.float32))[columns[lang]] = v
            for g, v in weights.items():
                held[1].setdefault(g, np.ones(len(languages), np.float32))[columns[lang]] = v
            level = pd.Series(1, index=[g[1:] for g in level]).groupby(level=0).sum().to_dict()

    def table(held: dict, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.zeros(0, U64), np.zeros((0, len(languages)), np.float32)
        name = np.full(len(held), order, U64)
        points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32).reshape(len(held), n) if n else None
        for k in range(n):
            name = join_names(name, points[:, k].astype(U64) + U64(1))
        by = np.argsort(name)
        return name[by], np.array(list(held.values()), np.float32)[by]

    return Models(languages, [table(g, n + 1, n + 1) for n, (g, _) in enumerate(per_order)],
                  [table(c, n, n + 1) for n, (_, c) in enumerate(per_order)])


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS, grams: int = GRAMS) -> Models:
    """Models from rows of (doc_id, lang, text). At most about ``train_rows`` rows of a language are used, drawn by a hash of
    doc_id; their whole texts count. Each language keeps its ``grams`` most frequent n-grams of the highest order."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Models([], [(np.zeros(0, U64), np.zeros((0, 0), np.float32))] * ORDER, [(np.zeros(0, U64), np.zeros((0, 0), np.float32))] * ORDER)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, train_rows / counts[lang]))))
    drawn = rows.where(F.expr("(xxhash64(doc_id) & 1048575) / 1048576D") < share[F.col("lang")])
    totals = staged(_gram_counts(drawn.select("lang", "text")), "grams")
    held = pd.concat([totals.where(F.col("lang") == lang).orderBy(F.desc("total"), "gram").limit(grams).toPandas() for lang in languages])
    return _kneser_ney(held, languages)


def score(docs: DataFrame, models: Broadcast, keep: list[str]) -> DataFrame:
    """Per row: the kept columns, lang_pred, score (share of the best language among all, tempered), bits per character."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields),
                        "lang_pred string, score double, bits double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Models = models.value
        for batch in batches:
            for part in byte_slices(batch):
                points, starts, ends, text = _words(part.column("text").to_pylist())
                n = part.num_rows
                pred, sure, bits = np.array(["und"] * n, object), np.zeros(n), np.zeros(n)
                if len(starts) and m.languages:
                    codes, _ = pd.factorize(word_names(points, starts, ends))
                    one = np.zeros(codes.max() + 1, np.int64)
                    one[codes] = np.arange(len(codes))
                    costs = m.bits(*_spelled(points, starts[one], ends[one]), len(one))
                    size = np.bincount(text, weights=ends - starts + 1, minlength=n)
                    whole = np.stack([np.bincount(text, weights=costs[codes, k], minlength=n) for k in range(len(m.languages))], axis=1)
                    some = size > 0
                    entropy = whole[some] / size[some, None]
                    best = entropy.argmin(axis=1)
                    low = entropy.min(axis=1)
                    pred[some] = np.array(m.languages, object)[best]
                    sure[some] = 1 / np.exp2(np.minimum(0, -(entropy - low[:, None]) * np.minimum(size[some], 50)[:, None])).sum(axis=1)
                    bits[some] = low
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in keep), pa.array(pred.tolist(), pa.string()), pa.array(sure), pa.array(bits)],
                    names=[*keep, "lang_pred", "score", "bits"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, learn: Column, quantile: float = 0.999, train_rows: int = TRAIN_ROWS, grams: int = GRAMS) -> DataFrame:
    """Per input row: doc_id, lang_pred, score, bits and ``rejected``.

    Rows where ``learn`` holds and lang is not null teach the models, by lang and text alone.
    ``und`` (score 0) marks texts that are null or have no letter, and every text if nothing
    could be learned. ``rejected`` marks texts whose bits per character lie above the
    ``quantile`` of the learned rows: no model explains them, lang_pred is only the least bad.
    Repeated rows get equal rows; other columns are left out.
    """
    known = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    models = fit(known, train_rows, grams)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    scored = staged(score(docs.select("doc_id", F.coalesce(learn & F.col("lang").isNotNull(), F.lit(False)).alias("known"), "text"),
                          shared, ["doc_id", "known"]), "scored")
    limit = scored.where("known and lang_pred <> 'und'").agg(F.percentile_approx("bits", quantile, 10_000)).first()[0]
    return scored.select("doc_id", "lang_pred", "score", "bits", (F.col("bits") > F.lit(limit if limit is not None else float("inf"))).alias("rejected"))


def language_report(docs: DataFrame) -> DataFrame:
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    found = identify(docs.select("doc_id", "lang", "text"), part != 2)
    return found.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score", "rejected")
