"""How filters interact: an incremental audit over a stream of all document files.

Documents arrive as micro-batches of files. Each gets a mask of the filters that its own text
fails. Whether it repeats a smaller id's text depends on what else arrives: state keyed by
text keeps the smallest id seen and its mask, and a smaller id that comes later takes the
earlier mask out of the part's counters and puts in the one with the repeat. The signed rows
add up to counts per part and mask, from which every order of the filters follows.

State and progress lie in the shared folder, so a query that loses an executor goes on from
its last micro-batch; a repeated micro-batch writes the same folder again. On a cluster set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which keeps state on
disk, as ``build_session`` does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.llm.common import let, staged
from tidegrid.llm.host_rules import SPACES
from tidegrid.session import shared_folder

#: Filters in the order of their bits; the last one is decided by the state.
FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Files of a micro-batch, and rows of the texts that share a state entry, about.
BATCH_FILES, BUCKET_ROWS = 4, 512
ARRIVED = "bucket long, text_key binary, doc_id long, has_id boolean, part string, mask int, n long"
CHANGED = "doc_id long, has_id boolean, part string, mask int, n long"
_STATE = pa.schema([("text_key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text decides by itself: A few words, B repeated words, C capitals, D symbols."""
    words = F.array_remove(F.split(text, SPACES, -1), "")
    few = let(words, lambda w: (
        F.when(F.size(w) < 100, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)).cast("long") < 80 * F.size(w).cast("long"), 2).otherwise(0)))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return (few + F.when(100 * capitals > 10 * F.char_length(text), 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)).cast("int")


def _settle(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Decides all rows of a batch but the smallest id of each text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, part, mask, bucket = (batch.column(c) for c in ("text_key", "part", "mask", "bucket"))
        has_id = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
        coded = keys.dictionary_encode()
        codes = coded.indices.to_numpy()
        low = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(low, codes[has_id], ids[has_id])
        later = has_id & (ids > low[codes])
        loose = later | ~has_id
        spread = (bucket.to_numpy() + np.arange(batch.num_rows)) % buckets
        yield pa.RecordBatch.from_arrays([
            pa.array(np.where(loose, spread, bucket.to_numpy()), pa.int64()),
            pc.if_else(pa.array(loose), pa.scalar(None, pa.binary()), keys), pa.array(ids), pa.array(has_id), part,
            pa.array(mask.to_numpy() | np.where(later, REPEAT, 0).astype(np.int32)),
            pa.array(np.ones(batch.num_rows, np.int64))], names=["bucket", "text_key", "doc_id", "has_id", "part", "mask", "n"])


def arrivals(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, text_key, doc_id, has_id, part, mask, n) of documents, a stream or a table.

    Within an Arrow batch a text's smallest id stands for it before the state. Rows with a larger
    id are settled there, whatever comes later, and so are rows without an id: they have their mask
    at once, no key, and any bucket, so that a text with very many copies does not burden its own.
    """
    text = F.coalesce("text", F.lit(""))
    masked = docs.select(
        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"), own_failures(text).alias("mask"))
    return masked.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets))).mapInArrow(
        lambda batches: _settle(batches, buckets), ARRIVED)


def _keep_smallest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Signed counter changes of the rows that arrive in a bucket; the state keeps the rows with the smallest id of each text."""
    arrived = pd.concat(list(frames), ignore_index=True)
    loose = arrived.text_key.isna()
    fresh = arrived[~loose].assign(old=False)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else _STATE.empty_table().to_pandas()
    seen = pd.concat([held.assign(old=True), fresh[[*_STATE.names, "old"]]], ignore_index=True) if len(held) else fresh
    codes = pd.factorize(seen.text_key)[0]
    ids, old = seen.doc_id.to_numpy(np.int64), seen.old.to_numpy(bool)
    low = np.full(codes.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, codes, ids)
    smallest = ids == low[codes]
    beaten = seen[~smallest]
    retracted = seen[old & ~smallest]
    if len(fresh):
        keep = seen[smallest].groupby(["text_key", "doc_id", "part", "mask"], sort=False, as_index=False).n.sum()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _STATE) as writer:
            writer.write_table(pa.Table.from_pandas(keep[_STATE.names], _STATE, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
    changes = pd.concat([
        arrived[loose], seen[~old & smallest].assign(has_id=True),
        beaten.assign(has_id=True, mask=beaten["mask"] | REPEAT),
        retracted.assign(has_id=True, n=-retracted.n)], ignore_index=True)
    yield changes[["doc_id", "has_id", "part", "mask", "n"]].astype(
        {"doc_id": "int64", "has_id": "bool", "mask": "int32", "n": "int64"})


def stream_changes(spark: SparkSession, path: str, batch_files: int = BATCH_FILES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, part, mask, n): signed rows of all documents under ``path``, written by one run over all files there are.

    A document's rows add up to one row for each time it is there, with its final mask.
    """
    held = spark.read.parquet(path)
    buckets = max(1, held.count() // bucket_rows)
    place = path.rstrip("/")
    docs = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", batch_files).parquet(
        f"{place[:-1]}[{place[-1]}]")  # as a pattern it may be a single file; a plain path has to be a folder
    changes = arrivals(docs, buckets).groupBy("bucket").applyInPandasWithState(
        _keep_smallest, CHANGED, "texts binary", "update", GroupStateTimeout.NoTimeout)
    out = shared_folder(spark, "changes")
    spark.createDataFrame([], CHANGED).write.parquet(f"{out}/batch=-1")  # there is a table even if no file comes

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

    query = changes.writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", shared_folder(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(CHANGED + ", batch int").parquet(out)
    return written.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "part", "mask", "n")


def mask_counts(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of all documents; ``good`` and ``toxic`` count those that any row of ``labels`` marks so.

    A label without id, or with an id that no document has, changes nothing.
    """
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    zero = F.lit(0).cast("long")
    every = changes.groupBy("part", "mask").agg(F.sum("n").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    marked = changes.where("doc_id is not null").join(marks, "doc_id").groupBy("part", "mask").agg(
        F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return every.unionByName(marked.withColumn("n", zero)).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def interaction_report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there, as long counts.

    A filter's shapley is its removals summed over all orders: of a document that fails f filters,
    each is first in an f-th of the orders.
    """
    bits = {name: 1 << k for k, name in enumerate(filters)}
    orders = ["".join(order) for order in permutations(filters)]
    steps = F.array(*(F.struct(F.lit(order).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bits[name]).alias("bit"),
                               F.lit(sum(bits[x] for x in order[:k])).alias("before"))
                      for order in orders for k, name in enumerate(order)))
    laid = counts.select("*", F.explode(steps).alias("s")).select(
        "part", "mask", "n", "good", "toxic", "s.filter_order", "s.step", "s.bit",
        (F.col("mask").bitwiseAND(F.col("s.bit")) != 0).alias("fails"), (F.col("mask").bitwiseAND(F.col("s.before")) != 0).alias("gone"))
    here = F.col("fails") & ~F.col("gone")

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    fair = F.expr(f"n * {len(orders)} div bit_count(mask)")
    return laid.groupBy("part", "filter_order", "step").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"), total(here).alias("removed"),
        total(F.col("fails") & F.col("gone")).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        F.sum(F.when(F.col("fails"), fair).otherwise(0)).cast("long").alias("shapley"))


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batch_files: int = BATCH_FILES,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``interaction_report`` of the Parquet documents under ``path`` (doc_id, text, lang; other columns are left).

    A null text is an empty one, a null lang the part of the empty name. A document without id
    repeats none and is repeated by none; rows that agree in id and text do not repeat each other.
    No documents, no rows.
    """
    counts = staged(mask_counts(stream_changes(spark, path, batch_files, bucket_rows), labels), "masks")
    return interaction_report(counts)
