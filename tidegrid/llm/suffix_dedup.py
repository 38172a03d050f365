"""Removal of repeated 200-byte strings by bucket-pointer refinement of sampled suffixes.

A suffix's bucket is the name of its first q bytes. Names of longer strings are built from
the names at later offsets, doubling each time, so a longer string costs one more pointer.

Suffixes to sort: every 200-byte window is represented by the suffix inside it whose q-gram
is smallest. The choice depends on the window's bytes alone, so equal windows choose equal
suffixes at equal distances, and only these anchors (about one in 60) leave their text.

1. Initial buckets: anchors with equal q-grams. An anchor alone in its bucket is final: none
   of its windows is repeated. It leaves.
2. Refinement by the pointers at later offsets, over the whole stretch of an anchor's windows.
   Two anchors still together repeat each other in all their windows.
3. A bucket that fell apart may hold windows equal in part. They are refined by blocks of 16,
   counted from the anchor: a block whose common core of 185 bytes is alone leaves, one whose
   whole stretch is shared is repeated. Of the few others each window gets its own name, again
   from pointers at later offsets, and is sorted once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import byte_slices, staged, text_buffer
from tidegrid.llm.slots import marked, marks
from tidegrid.llm.textbytes import BYTE, U64, join_names, mix

LENGTH, GRAM, REACH, BLOCK = 200, 64, 128, 16
#: Bytes of text worked on at once: all arrays of a piece stay in the processor's cache, about.
PIECE = 1 << 20


def pointer_names(buffer: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, a power of two, the names of the strings of that length at every offset (the last ones mean nothing)."""
    name, size, found = BYTE[buffer], 1, {}
    while size < max(lengths):
        later = np.empty_like(name)
        later[: max(0, len(name) - size)] = name[size:]
        later[max(0, len(name) - size):] = 0
        name, size = join_names(name, later), 2 * size
        found[size] = name
    return [found[n] for n in lengths]


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, by doubling."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return keys if size == width else np.minimum(keys[: len(keys) - (width - size)], keys[width - size:])


def anchors(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, place, bucket, refined bucket) of the anchors of all texts; places count from the text's start."""
    if len(buffer) < LENGTH:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, U64, U64))
    gram, reach = pointer_names(buffer, GRAM, REACH)
    keys = (gram[: len(buffer) - GRAM + 1] & U64(0xFFFFFFFF00000000)) | np.arange(len(buffer) - GRAM + 1, dtype=U64)
    chosen = (_smallest(keys, LENGTH - GRAM + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(chosen)]
    inside = np.arange(len(chosen)) + LENGTH <= end
    new = inside.copy()
    new[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (chosen[1:] != chosen[:-1]) | ~inside[1:]
    low, high = np.flatnonzero(new), np.flatnonzero(last)
    at = chosen[low]
    text = np.searchsorted(offsets, low, side="right") - 1
    base = offsets[text]
    return text, low - base, high - base, at - base, gram[at], stretch_names(reach, low, high + LENGTH, at - low)


def stretch_names(reach: np.ndarray, start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Name of each stretch of 200 to 384 bytes from three overlapping pointers, and of its anchor's place in it."""
    third = end - REACH
    name = join_names(reach[start], reach[np.minimum(start + REACH, third)])
    name = join_names(name, reach[third])
    return mix(name + (((end - start) << 16) | shift).astype(U64))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, limit=PIECE):
                text, low, high, at, bucket, refined = anchors(*text_buffer(part.column("text")))
                key = [part.column(c).take(pa.array(text)) for c in ("key_a", "key_b")]
                yield pa.RecordBatch.from_arrays([
                    *key, pa.array(bucket.view(np.int64)), pa.array(refined.view(np.int64)),
                    *(pa.array(x, pa.int32()) for x in (low, high, at))],
                    names=["key_a", "key_b", "bucket", "refined", "low", "high", "at"])

    return docs.mapInArrow(run, "key_a long, key_b int, bucket long, refined long, low int, high int, at int")


class _Listed:
    """What is listed beside each text of a slice, one entry per row: its text's number and its fields."""

    def __init__(self, part: pa.RecordBatch):
        lists = part.column("listed")
        self.part, self.flat = part, lists.flatten()
        self.text = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())

    def __getitem__(self, field: str) -> np.ndarray:
        return self.flat.field(field).to_numpy(zero_copy_only=False)

    def spread(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every entry ``count`` times: its number and a running number inside it."""
        which = np.repeat(np.arange(len(count)), count)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)

    def rows(self, which: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
        key = [self.part.column(c).take(pa.array(self.text[which])) for c in ("key_a", "key_b")]
        held = [self.flat.field(c).take(pa.array(which)) for c in ("refined", "single")]
        return pa.RecordBatch.from_arrays([*key, *held, *columns.values()], names=["key_a", "key_b", "refined", "single", *columns])


def _block_rows(texts: DataFrame) -> DataFrame:
    """The listed anchors' windows in blocks: name of the core, name of the whole stretch, first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, limit=PIECE):
                buffer, offsets = text_buffer(part.column("text"))
                (reach,) = pointer_names(buffer, REACH)
                listed = _Listed(part)
                near, far = (listed["at"] - listed[c] for c in ("high", "low"))
                which, step = listed.spread(far // BLOCK - near // BLOCK + 1)
                block = near[which] // BLOCK + step
                at, base = listed["at"][which], offsets[listed.text[which]]
                low, high = at - np.minimum(BLOCK * block + BLOCK - 1, far[which]), at - np.maximum(BLOCK * block, near[which])
                core = base + at - BLOCK * block
                bucket = listed["bucket"].view(U64)[which] + block.astype(U64)
                name = join_names(join_names(reach[core], reach[core + LENGTH - BLOCK + 1 - REACH]), mix(bucket))
                whole = join_names(stretch_names(reach, base + low, base + high + LENGTH, at - low), mix(bucket))
                yield listed.rows(which, bucket=pa.array(listed["bucket"][which]), core=pa.array(name.view(np.int64)), whole=pa.array(whole.view(np.int64)),
                                  low=pa.array(low, pa.int32()), high=pa.array(high, pa.int32()))

    return texts.mapInArrow(run, "key_a long, key_b int, refined long, single boolean, bucket long, core long, whole long, low int, high int")


def _window_rows(texts: DataFrame) -> DataFrame:
    """One row per window of the stretches listed beside each text: its refined name and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, limit=PIECE):
                buffer, offsets = text_buffer(part.column("text"))
                (reach,) = pointer_names(buffer, REACH)
                listed = _Listed(part)
                which, step = listed.spread(listed["high"] - listed["low"] + 1)
                place = listed["low"][which] + step
                start = place + offsets[listed.text[which]]
                name = join_names(join_names(reach[start], reach[start + LENGTH - REACH]), listed["bucket"].view(U64)[which])
                yield listed.rows(which, name=pa.array(name.view(np.int64)), place=pa.array(place, pa.int32()))

    return texts.mapInArrow(run, "key_a long, key_b int, refined long, single boolean, name long, place int")


def _beside_texts(texts: DataFrame, entries: DataFrame, *fields: str) -> DataFrame:
    """The texts that have entries, each with the list of its own; an entry per stretch of a text, so no longer than the text."""
    listed = staged(entries.groupBy("key_a", "key_b").agg(F.collect_list(F.struct(*fields)).alias("listed")), "listed")
    return marked(texts, "key_a", marks(listed.select("key_a"))).join(listed, ["key_a", "key_b"])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` under a 96-bit key of (doc_id, text): rows that agree in both are cut alike."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"key_a": F.xxhash64("doc_id", text), "key_b": F.hash(text, "doc_id", F.length(text))})


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """The names that come under two refined buckets or more."""
    return rows.groupBy(name).agg(F.min("refined").alias("a"), F.max("refined").alias("b")).where("a <> b").select(name)


def repeated_places(texts: DataFrame) -> DataFrame:
    """(key_a, key_b, low, high): the starts low..high of strings that start elsewhere too, from (key_a, key_b, text)."""
    rows = _anchor_rows(texts)
    together = staged(rows.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    kept = staged(rows.join(together, "bucket", "left_semi"), "kept")
    classes = staged(kept.groupBy("bucket", "refined").agg(F.count("*").alias("members"), F.min("key_a").alias("of")), "classes")
    apart = classes.groupBy("bucket").count().where("count > 1").select("bucket", F.lit(True).alias("apart"))
    open_classes = staged(classes.join(apart, "bucket", "left").where("members > 1 or apart"), "open")
    known = staged(kept.join(open_classes, ["bucket", "refined"]), "known")
    found = known.where("members > 1").select("key_a", "key_b", "low", "high")

    # One text stands for the members of a class; the members of a shared class are found already.
    stand = known.where("apart and key_a = of").withColumn("single", F.col("members") == 1)
    blocks = staged(_block_rows(_beside_texts(texts, stand, "bucket", "refined", "single", "low", "high", "at")), "blocks")
    near = staged(blocks.join(_shared(blocks, "core"), "core", "left_semi"), "near")
    whole = _shared(near, "whole").withColumn("all", F.lit(True))
    judged = staged(near.join(whole, "whole", "left").withColumn("all", F.coalesce("all", F.lit(False))), "judged")
    found = found.union(judged.where("single and all").select("key_a", "key_b", "low", "high"))

    fields = ["bucket", "refined", "single", "low", "high"]
    doubt = judged.where("not all").select("key_a", "key_b", "core", *fields)
    partner = judged.where("all").groupBy("core", "whole").agg(F.min(F.struct("key_a", "key_b", *fields)).alias("one")).select(
        "one.key_a", "one.key_b", "core", *(f"one.{f}" for f in fields)).join(doubt.select("core").distinct(), "core", "left_semi")
    windows = staged(_window_rows(_beside_texts(texts, doubt.unionByName(partner), *fields)), "windows")
    partly = windows.where("single").join(staged(_shared(windows, "name"), "names"), "name", "left_semi").select(
        "key_a", "key_b", F.col("place").alias("low"), F.col("place").alias("high"))
    return found.union(partly)


def _covered(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes, start and end, of one text."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    start, end = low[order], np.maximum.accumulate(high[order] + LENGTH)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _cut(whole: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of runs they form."""
    start, end = _covered(low, high)
    edges = np.zeros(len(whole) + 1, np.int8)
    edges[start], edges[end] = 1, -1
    return whole[np.cumsum(edges[:-1]) == 0].tobytes(), int((end - start).sum()), len(start)


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the bytes left of each whole text.

    A byte goes if a 200-byte string over it also starts elsewhere, in the same text or in
    another row's; a row that repeats doc_id and text is elsewhere. Null and shorter texts
    keep everything (null: no bytes). ``kept`` is binary, as a cut may fall inside a character;
    with ``as_text`` it takes the place of ``text`` instead, without such broken characters.
    Input columns named like the results are replaced; other columns are kept.
    """
    facts = ["n_bytes", "n_removed", "n_spans"]
    columns = [c for c in docs.columns if c not in {*facts, "kept", "key_a", "key_b", "places"}]
    rows = keyed(docs.select(*columns))
    places = staged(repeated_places(rows.select("key_a", "key_b", "text")).groupBy("key_a", "key_b").agg(
        F.collect_list(F.struct("low", "high")).alias("places")), "places")
    found = marks(places.select("key_a"))
    joined = marked(rows, "key_a", found).join(places, ["key_a", "key_b"], "left").select(*columns, "places")
    whole = marked(rows, "key_a", found, False).select(*columns, F.lit(None).cast(places.schema["places"].dataType).alias("places"))
    schema = T.StructType([*docs.select(*columns).schema.fields, *(T.StructField(c, T.LongType()) for c in facts),
                           *([] if as_text else [T.StructField("kept", T.BinaryType())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                buffer, offsets = text_buffer(part.column("text"))
                lists = part.column("places")
                flat = lists.flatten()
                low, high = (flat.field(c).to_numpy() for c in ("low", "high"))
                at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
                found = [_cut(buffer[offsets[i]: offsets[i + 1]], low[at[i]: at[i + 1]], high[at[i]: at[i + 1]])
                         for i in range(part.num_rows)]
                kept = pa.array([f[0].decode("utf-8", "ignore") if as_text else f[0] for f in found],
                                pa.string() if as_text else pa.binary())
                held = {c: part.column(c) for c in columns}
                held |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array([f[1] for f in found], pa.int64()),
                         "n_spans": pa.array([f[2] for f in found], pa.int64()), "text" if as_text else "kept": kept}
                yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held))

    return joined.mapInArrow(run, schema).union(whole.mapInArrow(run, schema))


def repeat_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
