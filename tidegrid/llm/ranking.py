"""Ranked search of all documents for each item of a stated set, by dual-tree search.

One pass over the texts keeps, per document, its number of terms and how often it has those
that any item has. Items come in blocks of bounded size; for each block every task walks two
hierarchies at once: nodes over items and nodes over documents hold the largest value of each
coordinate below them, so that the product of two nodes bounds every score between them.
A pair whose bound is below the weakest k-th score of its items holds no result, and whole
batches of documents go unseen. What is left at the leaves is scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import byte_slices, staged, text_buffer
from tidegrid.llm.slots import marks, slot_of
from tidegrid.llm.textbytes import LOWER, U64, mix, span_hashes, word_spans
from tidegrid.session import shared_folder

#: Bytes that end a term: all of ASCII but digits and letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: Items and distinct terms of a block; numbers of a dense batch of documents; children of a node.
BLOCK_ITEMS, BLOCK_TERMS, BATCH_NUMBERS, FAN = 256, 8192, 1 << 21, 4
#: Share of the documents that set the first bounds. Bounds only spare work; they never change a result.
FIRST_SHARE = 1 / 64
TEXT_SLICE = 1 << 20
TERMS = "n long, terms array<long>, counts array<int>"


def _term_lists(batch: pa.RecordBatch, keep=None) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Per text: its number of terms, its distinct terms (64-bit hashes, in order) and their counts; ``keep`` says which hashes."""
    buffer, offsets = text_buffer(batch.column("text"))
    starts, ends, owner = word_spans(buffer, offsets, BETWEEN)
    n = np.bincount(owner, minlength=batch.num_rows).astype(np.int64)
    hashes = span_hashes(buffer, starts, ends, LOWER) if len(starts) else np.zeros(0, U64)
    if keep is not None:
        kept = keep(hashes)
        owner, hashes = owner[kept], hashes[kept]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(owner)))
    places = np.searchsorted(owner[first], np.arange(batch.num_rows + 1)).astype(np.int32)
    return (n, pa.ListArray.from_arrays(pa.array(places), pa.array(hashes[first].view(np.int64))),
            pa.ListArray.from_arrays(pa.array(places), pa.array(counts.astype(np.int32))))


def with_terms(texts: DataFrame, key: str, wanted: Broadcast | None = None) -> DataFrame:
    """(key, n, terms, counts) of every whole text, a null one being empty; ``wanted`` are the slots of the terms to list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else lambda hashes: wanted.value[slot_of(mix(hashes))] > 0
        for batch in batches:
            for some in byte_slices(batch, limit=TEXT_SLICE):
                n, terms, counts = _term_lists(some, keep)
                yield pa.RecordBatch.from_arrays([some.column(key), pa.array(n), terms, counts], names=[key, "n", "terms", "counts"])

    return texts.select(key, "text").mapInArrow(run, f"{key} long, {TERMS}")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df) of all listed terms, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, n = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], names=["term", "df"])

    return postings.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Block:
    """Items of a block: their row numbers, the ordered terms with weights, and per level of the hierarchy the largest counts."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    levels: list[np.ndarray]
    documents: int
    all_terms: int


def _alike_next(counts: np.ndarray) -> np.ndarray:
    """An order of the rows of a matrix in which like rows are near: halves by nearness to two rows that are far apart, again and again."""
    def halve(rows: np.ndarray) -> list[int]:
        if len(rows) <= FAN:
            return rows.tolist()
        own = counts[rows]
        one = own @ own[int(np.argmin(own @ own[0]))]
        other = own @ own[int(np.argmin(one))]
        rows = rows[np.argsort(one - other, kind="stable")]
        return halve(rows[: len(rows) // 2]) + halve(rows[len(rows) // 2:])

    return np.array(halve(np.arange(len(counts))), np.int64)


def _maxima(leaves: np.ndarray) -> list[np.ndarray]:
    """The leaves and, level by level, the largest coordinates of ``FAN`` neighbours, up to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))
    return levels


def make_block(rows: list, documents: int, all_terms: int) -> Block:
    """The block of items given as (number, [(term, count, weight)])."""
    held = [np.array([tuple(t) for t in r["terms"]], np.int64).reshape(-1, 3) for r in rows]
    flat = np.concatenate(held)
    terms, first = np.unique(flat[:, 0].view(U64), return_index=True)
    weights = flat[first, 2]
    # Scores are whole numbers; below 2**53 doubles hold them exactly and multiply faster.
    largest = max(float((h[:, 1].astype(float) * h[:, 2]).sum()) for h in held) * 1e6
    counts = np.zeros((len(rows), len(terms)), np.float64 if largest < 2**52 else np.int64)
    for k, h in enumerate(held):
        counts[k, np.searchsorted(terms, h[:, 0].view(U64))] = h[:, 1]
    order = _alike_next(counts * np.sqrt(weights.astype(float)))
    return Block(np.array([r["item"] for r in rows])[order], terms, weights, _maxima(counts[order]), documents, all_terms)


class Best:
    """The best documents of each item so far, and the weakest score that may still enter."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.item, self.score, self.doc, self.known = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        if not len(item):
            return
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, score))
        doc, known = np.concatenate((self.doc, doc)), np.concatenate((self.known, known))
        order = np.lexsort((doc, ~known, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.item, self.score, self.doc, self.known = item[place < self.k], score[kept], doc[kept], known[kept]
        self.least[item[place == self.k - 1]] = np.maximum(self.least[item[place == self.k - 1]], score[last])


def _search(block: Block, leaves: np.ndarray, doc: np.ndarray, known: np.ndarray, best: Best) -> int:
    """Walks both hierarchies over a dense batch of documents; gives the number of pairs no bound could rule out."""
    documents, items = _maxima(leaves), block.levels
    steps = max(len(documents), len(items))
    alive = np.ones((1, 1), bool)
    for step in range(steps - 1, -1, -1):
        nodes, wanted = documents[min(step, len(documents) - 1)], items[min(step, len(items) - 1)]
        if step < len(documents) - 1:
            alive = np.repeat(alive, FAN, axis=0)[: len(nodes)]
        if step < len(items) - 1:
            alive = np.repeat(alive, FAN, axis=1)[:, : len(wanted)]
        rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return 0
        left = int(alive.sum())
        bounds = nodes[rows] @ wanted[columns].T
        width = FAN ** min(step, len(items) - 1)
        weakest = np.minimum.reduceat(best.least, np.arange(0, len(best.least), width))
        passed = (bounds >= weakest[columns]) & alive[np.ix_(rows, columns)]
        alive = np.zeros_like(alive)
        alive[np.ix_(rows, columns)] = passed
    at, of = np.nonzero(passed)
    best.add(columns[of], bounds[at, of].astype(np.int64), doc[rows[at]], known[rows[at]])
    return left


def _documents_alike_next(n: np.ndarray, term: np.ndarray, value: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """An order of documents that keeps the bounds of nodes low: by length, by the rarest of their common terms (much the
    same as the language), by their heaviest term."""
    common = np.zeros(len(weights), bool)
    common[np.argsort(weights, kind="stable")[:64]] = True
    telling = np.maximum.reduceat(np.where(common[term], weights[term] * len(weights) + term, -1), first)
    heaviest = np.maximum.reduceat(value * len(weights) + term, first) % len(weights)
    return np.lexsort((heaviest, telling, np.log2(n).astype(int)))


def best_in_tasks(postings: DataFrame, block: Broadcast, least: Broadcast, k: int) -> DataFrame:
    """(place of the item in the block, score, doc_id): the best ``k`` documents of each item among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        best = Best(len(b.items), k, least.value)
        size = max(FAN, BATCH_NUMBERS // max(1, len(b.terms)))
        kind = b.levels[0].dtype
        for batch in batches:
            lists = batch.column("terms")
            places = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(places))
            terms = lists.flatten().to_numpy().view(U64)
            term = np.searchsorted(b.terms, terms)
            found = b.terms[np.minimum(term, len(b.terms) - 1)] == terms
            owner, term, tf = owner[found], term[found], batch.column("counts").flatten().to_numpy().astype(np.int64)[found]
            if not len(owner):
                continue
            m = 100 - 75 + (75 * batch.column("n").to_numpy() * b.documents) // b.all_terms
            value = b.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            order = _documents_alike_next(batch.column("n").to_numpy()[owner[first]], term, value, first, b.weights)
            stops = np.append(first[1:], len(owner))
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            for at in range(0, len(order), size):
                some = order[at: at + size]
                lengths = stops[some] - first[some]
                entries = np.repeat(first[some] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                leaves = np.zeros((len(some), len(b.terms)), kind)
                leaves[np.repeat(np.arange(len(some)), lengths), term[entries]] = value[entries]
                _search(b, leaves, doc[owner[first[some]]], known[owner[first[some]]], best)
        yield pa.RecordBatch.from_arrays([
            pa.array(best.item), pa.array(best.score), pa.array(best.doc, mask=~best.known)], names=["place", "score", "doc_id"])

    return postings.mapInArrow(run, "place long, score long, doc_id long")


def _blocks(items: DataFrame, documents: int, all_terms: int, most_items: int, most_terms: int) -> Iterator[Block]:
    """Items in blocks of bounded size, one after the other through the driver."""
    rows, terms = [], set()
    for row in items.toLocalIterator():
        own = {t["term"] for t in row["terms"]}
        if rows and (len(rows) == most_items or len(terms | own) > most_terms):
            yield make_block(rows, documents, all_terms)
            rows, terms = [], set()
        rows.append(row)
        terms |= own
    if rows:
        yield make_block(rows, documents, all_terms)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS,
                   first_share: float = FIRST_SHARE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, scores above 0 only.

    Equal scores go by doc_id, null last. Null texts have no terms; a null item_id is an item, and
    so is each repeated row of one; a repeated document is ranked as often as it is there. No items or
    no documents, no rows; other columns are left out. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    numbered = staged(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = staged(with_terms(numbered.select(F.col("item"), "text"), "item").select(
        "item", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", "t.terms", "t.counts").toDF("item", "term", "count"), "wanted")
    found = marks(wanted.select("term"))
    postings = staged(with_terms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", found).where("n > 0"), "postings")
    found.unpersist()
    whole = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, all_terms = whole["documents"], whole["terms"] or 0
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(document_frequencies(postings), "term").groupBy("item").agg(
        F.collect_list(F.struct("term", "count", weight.alias("weight"))).alias("terms"))

    out = shared_folder(spark, "best")
    spark.createDataFrame([], "item long, score long, doc_id long").write.parquet(f"{out}/block=-1")
    for number, held in enumerate(_blocks(staged(weighed, "weighed"), documents, all_terms, block_items, block_terms)):
        block = spark.sparkContext.broadcast(held)
        names = F.array(*map(F.lit, held.items.tolist()))

        def search(rows: DataFrame, least: np.ndarray) -> DataFrame:
            bound = spark.sparkContext.broadcast(least)
            ranked = best_in_tasks(rows, block, bound, k).withColumn("rank", F.row_number().over(
                Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())))
            return ranked.where(F.col("rank") <= k)

        least = np.ones(len(held.items), held.levels[0].dtype)
        for row in search(postings.sample(first_share, seed=1), least).where(F.col("rank") == k).select("place", "score").collect():
            least[row["place"]] = row["score"]
        search(postings, least).select(F.get(names, F.col("place")).alias("item"), "score", "doc_id").write.parquet(f"{out}/block={number}")
        block.unpersist()
    best = spark.read.schema("item long, score long, doc_id long").parquet(out)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", rank).join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
