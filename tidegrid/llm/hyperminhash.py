"""Near duplicates by HyperMinHash registers, banded, estimated, then confirmed on full sets.

A set of word shingles is dealt to 512 buckets by the first bits of its hashes. A bucket
keeps its smallest hash as a count of leading zeros (4 bits) and the 4 bits after the first
one. Empty buckets borrow from a full one in a fixed order, which keeps the chance of equal
registers at the similarity of the sets or above. Eight registers are one band: sets of
similarity 0.85 share none of the 64 bands with a chance of 1e-9, of 0.8 with 8e-6, while
sets of 0.3 meet in any with 1 %, so that families of loosely related texts stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import byte_slices, staged, text_buffer
from tidegrid.llm.components import components
from tidegrid.llm.slots import marked, marks
from tidegrid.llm.textbytes import U64, mix, shingle_sets, sums_by

BUCKETS, BUCKET_BITS, ZEROS, MANTISSA = 512, 9, 15, 4
BANDS = 64
#: Standard deviations of the estimate that a pair may lie below the threshold and still be confirmed.
SLACK = 5.0
#: Sizes of sets, their registers and the bits of the own ones, both as longs.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def registers_of(owner: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 512) one-byte registers of sets given as ordered (owner, hash), and which are the bucket's own.

    Rows of empty sets mean nothing.
    """
    bucket = (names >> U64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(names), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    rest = (names[first] << U64(BUCKET_BITS)) >> U64(11)  # 53 bits that a double holds exactly
    exponent = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(53 - exponent, ZEROS).astype(np.uint8)
    below = rest << (64 - exponent).clip(0, 63).astype(U64) << U64(1)  # what follows the leading one
    value = (zeros << np.uint8(MANTISSA)) | (below >> U64(64 - MANTISSA)).astype(np.uint8)
    table, full = np.zeros((n, BUCKETS), np.uint8), np.zeros((n, BUCKETS), bool)
    at = (owner[first], bucket[first])
    table[at], full[at] = value, True
    return _borrow(table, full), full


@lru_cache(maxsize=1)
def _asking() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the order in which it asks the others, and each other's rank in it (by other)."""
    keys = mix(np.arange(BUCKETS * BUCKETS, dtype=U64) + U64(1)).reshape(BUCKETS, BUCKETS)
    order = np.argsort(keys, axis=1)
    return order, np.argsort(order, axis=1).T.astype(np.uint16)


def _borrow(table: np.ndarray, full: np.ndarray, few: int = 64) -> np.ndarray:
    """Each empty bucket takes the register of the first full one that it asks."""
    order, rank = _asking()
    out, count = table.copy(), full.sum(axis=1)
    for rows in np.array_split(np.flatnonzero((count > 0) & (count < few)), max(1, len(table) // 128)):
        if len(rows):  # rank all full buckets
            width = count[rows].max()
            held = np.argsort(~full[rows], axis=1, kind="stable")[:, :width]
            asked = np.where(np.arange(width)[None, :, None] < count[rows][:, None, None], rank[held], np.uint16(65535))
            donor = np.take_along_axis(held, asked.argmin(axis=1), axis=1)
            out[rows] = np.where(full[rows], table[rows], np.take_along_axis(table[rows], donor, axis=1))
    rows = np.flatnonzero((count >= few) & (count < BUCKETS))
    wanting = ~full[rows]
    for k in range(BUCKETS):  # ask one after the other; soon few are left
        if not len(rows):
            break
        donor = order[:, k]
        gives = wanting & full[rows][:, donor]
        part = out[rows]
        part[gives] = table[rows][:, donor][gives]
        out[rows] = part
        wanting &= ~gives
        left = wanting.any(axis=1)
        rows, wanting = rows[left], wanting[left]
    return out


def sketch(rows: DataFrame, words: int) -> DataFrame:
    """Per row of (row, text): n_shingles, a 128-bit name of its set (two longs), its registers, and a bit for each that is no borrowed one."""
    schema = "row long, n_shingles long, set_a long, set_b long, registers binary, full binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                n = part.num_rows
                owner, names = shingle_sets(*text_buffer(part.column("text")), words)
                count = np.bincount(owner, minlength=n)
                table, full = registers_of(owner, names, n)
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), pa.array(count, pa.int64()),
                    pa.array(sums_by(owner, mix(names), n).view(np.int64)),
                    pa.array(sums_by(owner, mix(names ^ U64(0x5DEECE66D)), n).view(np.int64)),
                    pa.array([r.tobytes() for r in table], pa.binary()),
                    pa.array([r.tobytes() for r in np.packbits(full, axis=1)], pa.binary())],
                    names=["row", "n_shingles", "set_a", "set_b", "registers", "full"])

    return rows.select("row", "text").mapInArrow(run, schema)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(band, node, n): a key for each band of eight registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(BANDS, dtype=U64) + U64(77))
        for batch in batches:
            if batch.num_rows:
                held = np.frombuffer(b"".join(batch.column("registers").to_pylist()), U64).reshape(-1, BANDS)
                yield pa.RecordBatch.from_arrays([
                    pa.array(mix(held ^ salt).ravel().view(np.int64)),
                    *(pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("node", "n"))], names=["band", "node", "n"])

    return nodes.select("node", F.col("n_shingles").cast("int").alias("n"), "registers").mapInArrow(run, "band long, node long, n int")


def _longs(column: pa.Array, width: int) -> np.ndarray:
    return text_buffer(column)[0].view(U64).reshape(-1, width)


def _likely(left: Side, right: Side, percent: int) -> np.ndarray:
    """Whether sets may be as similar as wanted, row by row of (n, registers, full).

    Where the own registers of a bucket differ, or only one set has any, the smaller of the two least hashes is
    in one set alone. So many buckets, so many shingles at least that are not shared: this bound is exact, and
    sharp for small sets. Then the share of equal registers less the equal ones that chance gives (truncated
    hashes of unequal minima collide) estimates Jaccard, no surer than the number of shingles or registers allows.
    """
    (n_a, reg_a, full_a), (n_b, reg_b, full_b) = left, right
    big, small, threshold = np.maximum(n_a, n_b), np.minimum(n_a, n_b), percent / 100
    unequal = reg_a.view(np.uint8).reshape(-1, BUCKETS) != reg_b.view(np.uint8).reshape(-1, BUCKETS)
    both, either = full_a & full_b, full_a ^ full_b
    apart = np.bitwise_count((np.packbits(unequal, axis=1).view(U64) & both) | either).sum(axis=1, dtype=np.int64)
    ratio = big / small
    floor = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.minimum(big, BUCKETS))
    chance = 0.1699194871597391 * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    near = (1 - unequal.mean(axis=1) - chance) / (1 - chance) >= floor
    return near & (100 * small >= percent * big) & ((100 + percent) * apart <= (100 - percent) * (big + small))


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sizes and registers leave them likely."""
    side = lambda s: nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n_shingles", "registers", "full")))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
        100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = ((batch.column(f"n_shingles_{s}").to_numpy(), _longs(batch.column(f"registers_{s}"), BANDS),
                                _longs(batch.column(f"full_{s}"), BUCKETS // 64)) for s in "ab")
                yield batch.select(["a", "b"]).filter(pa.array(_likely(left, right, percent)))

    return sized.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = staged(wanted, "wanted")
    texts = staged(marked(rows.select("row", "text"), "row", marks(wanted)).join(wanted, "row", "left_semi"), "texts")
    side = lambda s: texts.select(F.col("row").alias(s), F.col("text").alias(f"text_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text_a"):
                n = part.num_rows
                (left, a), (right, b) = (shingle_sets(*text_buffer(part.column(c)), words) for c in ("text_a", "text_b"))
                owner, names = np.concatenate((left, right)), np.concatenate((a, b))
                order = np.lexsort((names, owner))
                owner, names = owner[order], names[order]
                both = (owner[1:] == owner[:-1]) & (names[1:] == names[:-1])
                common = np.bincount(owner[1:][both], minlength=n)
                union = np.bincount(owner, minlength=n) - common
                yield part.select(["a", "b"]).filter(pa.array(100 * common >= percent * union))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(band, own, block, low, high, held): the members of bands with several components in blocks of about ``size``.

    A component with ``size`` members or more of a band has blocks of its own, named in ``own``, so that it is
    never compared with itself; the rest of the band shares blocks, dealt by hash.
    """
    parts = staged(members.groupBy("band", "component").agg(F.count("*").alias("count")), "parts")
    large = F.col("count") >= size
    bands = parts.groupBy("band").agg(
        F.sum(F.when(large, 0).otherwise(F.col("count"))).alias("rest"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    plan = staged(parts.join(bands.select("band", "rest"), "band").select(
        "band", "component", F.when(large, F.col("component")).alias("own"),
        F.ceil(F.when(large, F.col("count")).otherwise(F.col("rest")) / size).alias("blocks")), "plan")
    placed = members.join(plan, ["band", "component"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return placed.join(nodes.select("node", "registers", "full"), "node").groupBy("band", "own", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list(F.struct("node", "component", "n", "registers", "full")).alias("held"))


def _across(members: DataFrame, nodes: DataFrame, percent: int, block: int = 128) -> DataFrame:
    """The likely (a, b), each once, among a band's members in different components.

    Block meets block; sizes and registers are compared inside the task, and a pair comes out of the first band
    it shares alone, so loosely related texts leave no row.
    """
    blocks = staged(_blocks(members, nodes, block), "blocks")
    side = lambda s: blocks.select("band", *(F.col(c).alias(f"{s}_{c}") for c in ("own", "block", "low", "high", "held")))
    order = lambda s: F.struct(F.coalesce(f"{s}_own", F.lit(-1)), F.col(f"{s}_block"))
    facing = side("l").join(side("r"), "band").where(
        (order("l") <= order("r")) & F.coalesce(F.col("l_own") != F.col("r_own"), F.lit(True))
        & (100 * F.col("l_high") >= percent * F.col("r_low")) & (100 * F.col("r_high") >= percent * F.col("l_low"))).select(
        "band", (order("l") == order("r")).alias("self"), "l_held", "r_held")

    def parts(column: pa.ListArray) -> tuple[np.ndarray, ...]:
        held = column.flatten()
        node, component, n = (held.field(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n"))
        ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
        return ends, node, component, n, _longs(held.field("registers"), BANDS), _longs(held.field("full"), BUCKETS // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(BANDS, dtype=U64) + U64(77))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, alone = batch.column("band").to_numpy().view(U64), batch.column("self").to_numpy(zero_copy_only=False)
            left, right = parts(batch.column("l_held")), parts(batch.column("r_held"))
            out = [np.zeros((0, 2), np.int64)]
            for row in range(batch.num_rows):
                (node_l, part_l, n_l, reg_l, full_l), (node_r, part_r, n_r, reg_r, full_r) = (
                    [values[ends[row]: ends[row + 1]] for values in rest] for ends, *rest in (left, right))
                fit = (part_l[:, None] != part_r) & (100 * np.minimum(n_l[:, None], n_r) >= percent * np.maximum(n_l[:, None], n_r))
                if alone[row]:
                    fit &= node_l[:, None] < node_r
                i, j = np.nonzero(fit)
                for at in range(0, len(i), 4096):
                    a, b = i[at: at + 4096], j[at: at + 4096]
                    shared = reg_l[a] == reg_r[b]
                    first = shared.argmax(axis=1)
                    here = shared.any(axis=1) & (mix(reg_l[a, first] ^ salt[first]) == keys[row])
                    a, b = a[here], b[here]
                    likely = _likely((n_l[a], reg_l[a], full_l[a]), (n_r[b], reg_r[b], full_r[b]), percent)
                    pair = np.stack((node_l[a[likely]], node_r[b[likely]]), axis=1)
                    out.append(np.sort(pair, axis=1))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return facing.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id).

    Rows with equal sets are one node. In each band every node is tested against the band's
    first one; then, between components found so far, all pairs of a band that were not tested.
    Pairs inside a component need no test, so a group of copies never becomes all its pairs.

    A row without a word (null and empty texts too) has no shingle, links with nothing and is
    its own component. A null doc_id never names a component: such a row is kept only if
    nothing with an id is linked to it. Rows that repeat a doc_id and text share one verdict.
    Input columns named like the results are replaced; other columns are kept.
    """
    taken = {"row", "n_shingles", "component_id", "kept", "set_a", "set_b"}
    extra = [c for c in docs.columns if c not in taken | {"doc_id", "text"}]
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *extra), "rows")
    sketched = staged(sketch(rows, words), "sketch")
    sets = staged(sketched.where("n_shingles > 0").join(rows.select("row", "doc_id"), "row")
                  .groupBy("n_shingles", "set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "sets")
    nodes = staged(sketched.join(sets.select("node"), F.col("row") == F.col("node"), "left_semi")
                   .select(F.col("row").alias("node"), "n_shingles", "registers", "full"), "nodes")
    bands = band_keys(nodes)
    heads = staged(bands.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("met"))
                   .where("met > 1").select("band", "head"), "heads")
    members = staged(bands.join(heads, "band"), "members")
    tested = staged(members.where("head < node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = staged(confirmed(staged(estimated(tested, nodes, percent), "likely"), rows, words, percent), "found")
    own = F.coalesce("component", "node").alias("component")
    apart = staged(members.join(components(links), "node", "left").select("band", "node", "n", own), "apart")
    others = staged(_across(apart, nodes, percent).join(tested, ["a", "b"], "left_anti"), "others")
    parts = components(links.union(staged(confirmed(others, rows, words, percent), "found")))
    lows = sets.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    named = staged(lows.join(least, "component").select("n_shingles", "set_a", "set_b", "component_id"), "named")
    key = ["n_shingles", "set_a", "set_b"]
    judged = staged(sketched.select("row", *key).join(named, key, "left").select("row", "n_shingles", F.col("component_id").alias("low")), "judged")
    alone = F.col("low").isNull()
    return rows.join(judged, "row").select(
        "doc_id", "text", *extra, "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"),
        (alone | F.coalesce(F.col("doc_id") == F.col("low"), F.lit(False))).alias("kept"))


def near_duplicate_report(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), words, percent).select("doc_id", "n_shingles", "component_id", "kept")
