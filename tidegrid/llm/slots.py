"""Counts of hashes in a table of fixed size: 2**24 slots of one byte, the same 16 MB for any input.

A slot that several hashes share only shows a higher count, so the table serves for orders by
rarity and for filters that may let a row pass but never hold one back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.textbytes import U64, mix

SLOT_BITS, BLOCK_BITS = 24, 12
COUNTS = "slot int, n long"


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - SLOT_BITS)).astype(np.int32)


def count_slots(batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(slot, n) of all hashes of a task, added up first."""
    held = np.zeros(1 << SLOT_BITS, np.int32)
    for hashes in batches:
        slots, n = np.unique(slot_of(hashes), return_counts=True)
        held[slots] += n.astype(np.int32)
    slots = np.flatnonzero(held)
    for at in range(0, len(slots), 1 << 16):
        some = slots[at: at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], names=["slot", "n"])


def slot_table(counts: DataFrame) -> np.ndarray:
    """Byte codes of the summed counts of (slot, n): 0 none, 1 one, then four steps per doubling."""

    def pack(table: pa.Table) -> pa.Table:
        codes = np.zeros(1 << BLOCK_BITS, np.uint8)
        n = table.column("n").to_numpy()
        codes[table.column("slot").to_numpy() & ((1 << BLOCK_BITS) - 1)] = np.where(
            n < 2, n, np.minimum(255, 2 + np.floor(4 * np.log2(np.maximum(n, 2) / 2))))
        return pa.table({"block": table.column("block")[:1], "codes": pa.array([codes.tobytes()], pa.binary())})

    blocks = (counts.groupBy("slot").agg(F.sum("n").alias("n"))
              .withColumn("block", F.shiftright("slot", BLOCK_BITS))
              .groupBy("block").applyInArrow(pack, "block int, codes binary"))
    table = np.zeros((1 << SLOT_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for row in blocks.toLocalIterator():
        table[row["block"]] = np.frombuffer(row["codes"], np.uint8)
    return table.ravel()


def marks(numbers: DataFrame) -> Broadcast:
    """The slots of a column of row numbers, for ``marked``."""
    column = numbers.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from count_slots(mix(b.column(column).to_numpy().view(U64)) for b in batches if b.num_rows)

    return numbers.sparkSession.sparkContext.broadcast(slot_table(numbers.mapInArrow(run, COUNTS)))


def marked(rows: DataFrame, column: str, found: Broadcast, wanted: bool = True) -> DataFrame:
    """The rows whose number may be among the marked ones, or those whose number surely is not. Spares a join the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array((found.value[slot_of(mix(batch.column(column).to_numpy().view(U64)))] > 0) == wanted))

    return rows.mapInArrow(run, rows.schema)
