"""Removal of lines similar to an earlier line: an exact set-similarity join over all lines.

A line is the set of its words (A-Z folded), ordered from rare to frequent. Its keys are runs
of neighbouring words in that order, two words long or, from a frequent word on, three. Two
lines of Jaccard similarity p differ in few words, and each such word breaks only the keys
around it: so they share one of the first keys of each (prefix filter, ``_prefix``). Lines
that share none with another set and have no copy are done after one aggregation. Pairs that
meet pass the length and bitmap filters, which lose no similar pair, and are then verified on
their full sets.

Rarity comes from a table of fixed size: each word adds to one of 2**24 slots, and a slot
holds one byte, about four steps per doubling. Any order of words gives the exact result; a
shared slot only makes a word look more frequent. A word seen once can meet no other line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import byte_slices, dropped, small_slices, staged, text_buffer
from tidegrid.llm.slots import COUNTS, count_slots, slot_of, slot_table
from tidegrid.llm.suffix_dedup import keyed
from tidegrid.llm.textbytes import LOWER, U64, join_names, mix, span_hashes, sums_by, word_spans


def word_rarity(docs: DataFrame) -> np.ndarray:
    """The slot table of all words of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes() -> Iterator[np.ndarray]:
            for part in small_slices(batches):
                buffer, offsets = text_buffer(part.column("text"))
                yield span_hashes(buffer, *word_spans(buffer, offsets)[:2], LOWER)
        yield from count_slots(hashes())

    return slot_table(docs.select("text").mapInArrow(run, COUNTS))


def _words_in_lines(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and line of each word; text and number of each line that has a word. Lines are numbered through the slice."""
    starts, ends, text = word_spans(buffer, offsets)
    breaks = np.flatnonzero(buffer == 10)
    at = np.searchsorted(breaks, starts) + text
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    numbers, line = at[new], np.cumsum(new) - 1
    begin = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)
    owner = np.searchsorted(begin, numbers, side="right") - 1
    return starts, ends, line, owner, numbers - begin[owner]


def _line_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, text and number of every line, those without a word too."""
    breaks = np.flatnonzero(buffer == 10)
    count = np.diff(np.searchsorted(breaks, offsets)) + 1
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts, ends = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    last = np.cumsum(count) - 1
    inner = np.ones(len(owner), bool)
    inner[last] = False
    starts[number == 0], starts[number > 0] = offsets[:-1], breaks + 1
    ends[last], ends[inner] = offsets[1:], breaks
    return starts, ends, owner, number


def _distinct(line: np.ndarray, hashes: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The distinct (line, hash), by line, then by code, then by hash."""
    rank = hashes if codes is None else (codes.astype(U64) << U64(56)) | (hashes >> U64(8))
    order = np.lexsort((rank, line))
    line, hashes = line[order], hashes[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    return line[new], hashes[new], None if codes is None else codes[order][new]


def _set_names(line: np.ndarray, hashes: np.ndarray, count: int) -> list[pa.Array]:
    return [pa.array(sums_by(line, mix(h), count).view(np.int64)) for h in (hashes, hashes ^ U64(0x5DEECE66D))]


def _place_name(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(join_names(key, line.astype(U64)))


#: A bitmap of 256 bits of a line's words.
BITS = ["b0", "b1", "b2", "b3"]
#: Keys that a task gathers before it deals them out.
ENTRIES = 1 << 18
#: Slot codes of words seen once, and of the words (up to about 256 times) that begin a key of two words.
ONCE, SOME = 1, 30


def _bitmaps(hashes: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    """The words of each bitmap, line by line."""
    place = hashes & U64(255)
    bit, word = U64(1) << (place & U64(63)), place >> U64(6)
    return [pa.array(np.bitwise_or.reduceat(np.where(word == U64(k), bit, U64(0)), begin).view(np.int64)) for k in range(len(BITS))]


def _keys(line: np.ndarray, hashes: np.ndarray, codes: np.ndarray, short: bool) -> np.ndarray:
    """The key that begins at each word: the word alone if ``short`` or seen once, else with one or two words after it.

    Behind the last word of a line come end marks, equal in all lines.
    """
    if short:
        return hashes
    after, owner = np.concatenate((hashes, np.zeros(2, U64))), np.concatenate((line, [-1, -1]))
    second = np.where(owner[1:-1] == line, after[1:-1], U64(1))
    third = np.where(owner[2:] == line, after[2:], U64(1))
    two = join_names(hashes, second)
    return np.where(codes <= ONCE, hashes, np.where(codes <= SOME, two, join_names(two, third)))


def _prefix(n: np.ndarray, once: np.ndarray, some: np.ndarray, percent: int, short: bool) -> np.ndarray:
    """How many of the first keys of a line a similar line can lack at most; it shares one of those and the next.

    Of the words of a line up to ``100 - percent`` % are missing in a similar one, and the fewer, the more words
    that one has in between. A missing word breaks the keys that hold it (1, 2 or 3), a word in between one key
    less; above 67 % a longer partner never breaks more than the shortest, whose words are all shared.
    """
    lost = n * (100 - percent)
    if short:
        return lost // 100
    rest = lost - 100 * once
    return np.where(rest < 0, lost, np.where(2 * rest < 100 * some, 100 * once + 2 * rest, 100 * once - 50 * some + 3 * rest)) // 100


def _signatures(docs: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """One row per line with a word: its place, size, set name, bitmap and the keys of its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    schema = ("key_a long, key_b int, doc_id long, line int, n int, set_a long, set_b long, "
              + "".join(f"{b} long, " for b in BITS) + "names array<long>")
    short = percent < 67

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            buffer, offsets = text_buffer(part.column("text"))
            starts, ends, line, owner, number = _words_in_lines(buffer, offsets)
            count = len(owner)
            if not count:
                continue
            hashes = span_hashes(buffer, starts, ends, LOWER)
            line, hashes, codes = _distinct(line, hashes, shared.value[slot_of(hashes)])
            n = np.bincount(line, minlength=count)
            begin = np.cumsum(n) - n
            place = np.arange(len(line)) - begin[line]
            once = np.bincount(line[codes <= ONCE], minlength=count)
            some = np.bincount(line[codes <= SOME], minlength=count) - once
            prefix = (place <= _prefix(n, once, some, percent, short)[line]) & (codes > ONCE)
            at = np.concatenate(([0], np.cumsum(np.bincount(line[prefix], minlength=count)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                *(part.column(c).take(pa.array(owner)) for c in ("key_a", "key_b", "doc_id")),
                pa.array(number, pa.int32()), pa.array(n, pa.int32()), *_set_names(line, hashes, count), *_bitmaps(hashes, begin),
                pa.ListArray.from_arrays(at, pa.array(_keys(line, hashes, codes, short)[prefix].view(np.int64)))],
                names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("key_a", "key_b", "doc_id", "text").mapInArrow(run, schema)


def _packed(signed: DataFrame, buckets: int) -> DataFrame:
    """The names of all sets, dealt to buckets: 48 bits of a name and 48 of its set, twelve bytes an entry.

    Lines that follow each other closely and have one set give its names once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            sets, sizes, names = (np.concatenate(x) for x in zip(*held))
            first = np.zeros(len(sets), bool)
            first[np.unique(sets, return_index=True)[1]] = True
            kept = np.repeat(first, sizes)
            name, of = names[kept], np.repeat(sets, sizes)[kept] >> U64(16)
            bucket = ((name & U64(0xFFFF)) * U64(buckets) >> U64(16)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, name, of = bucket[order], name[order] >> U64(16), of[order]
            rows = np.stack([name, name >> U64(32) | of >> U64(32) << U64(16), of], axis=1).astype(np.uint32)  # the low halves
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            at = (12 * np.append(begin, len(bucket))).astype(np.int32)
            entries = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(rows)])
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int32()), entries], names=["bucket", "entries"])

        held, count = [], 0
        for batch in batches:
            lists = batch.column("names")
            held.append((batch.column("set_a").to_numpy().view(U64), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(U64)))
            count += len(held[-1][2])
            if count >= ENTRIES:
                yield flushed()
                held, count = [], 0
        if count:
            yield flushed()

    return signed.select("set_a", "names").mapInArrow(run, "bucket int, entries binary")


def _shared_names(table: pa.Table) -> pa.Table:
    """(name, of, many) of the names in a bucket that two sets or more hold; ``many``: three or more."""
    rows = np.frombuffer(text_buffer(table.column("entries").combine_chunks())[0], np.uint32).reshape(-1, 3).astype(U64)
    name = rows[:, 0] | (rows[:, 1] & U64(0xFFFF)) << U64(32)
    order = np.argsort(name)
    twice = np.diff(name[order]) == 0
    some = order[np.append(twice, False) | np.insert(twice, 0, False)]
    name, of = name[some], rows[some, 2] | rows[some, 1] >> U64(16) << U64(32)
    name, of, _ = _distinct(name, of)
    begin = np.flatnonzero(np.diff(name, prepend=~name[:1]))
    sets = np.diff(np.append(begin, len(name)))
    sets = np.repeat(sets, sets)
    name = name << U64(16) | U64(table.column("bucket")[0].as_py())
    kept = sets > 1
    return pa.table({"name": name[kept].view(np.int64), "of": of[kept].view(np.int64), "many": sets[kept] > 2})


def _active(signed: DataFrame) -> DataFrame:
    """The lines that have a copy or share a key with another set, the rest being the first of their kind that meet no similar one.

    ``copy``: an earlier line has the same set. The first line of a set has the keys (``names``) that its set shares, in one
    order for all, and those of them that three sets or more share (``open``). ``signed`` is run twice, so that
    its keys, most of them found nowhere else, never lie on disk beside what is made of them.
    """
    buckets = min(1 << 16, 16 * int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = staged(_packed(signed, buckets).groupBy("bucket").applyInArrow(_shared_names, "name long, of long, many boolean"), "entries")
    lines = staged(signed.drop("names"), "lines")
    place = F.struct("doc_id", "line", "key_a", "key_b")
    kinds = lines.groupBy("set_a", "set_b").agg(F.min(place).alias("f"), F.count("*").alias("lines"))
    met = entries.groupBy("of").agg(F.array_sort(F.collect_list("name")).alias("names"), F.array_sort(F.collect_list(F.when(F.col("many"), F.col("name")))).alias("open"))
    facts = staged(kinds.join(met, F.shiftrightunsigned("set_a", 16) == F.col("of"), "left").where("lines > 1 or of is not null")
                   .select("set_a", "set_b", "f", "names", "open"), "facts")
    dropped(entries)
    of_first = lambda c: F.when(F.col("f") == place, F.col(c)).alias(c)
    active = staged(lines.join(facts, ["set_a", "set_b"]).select(
        *lines.columns, (F.struct("f.doc_id", "f.line") < F.struct("doc_id", "line")).alias("copy"), of_first("names"), of_first("open")), "active")
    dropped(lines, facts)
    return active


def _may_match(a: str, b: str, percent: int) -> Column:
    """``a`` is earlier and passes the length and bitmap filters.

    Similar lines pass: bits that differ are at most the words in which the lines differ.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in BITS), F.lit(0))
    return ((F.col(f"{a}.id") < F.col(f"{b}.id")) & (100 * F.least(n, m) >= percent * F.greatest(n, m))
            & ((100 + percent) * (n + m - differ) >= 2 * percent * (n + m)))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The distinct ``later`` of (earlier, later) pairs of classes that are similar on their full sets.

    Two slot tables of the places wanted, of fixed size, let most other lines stay where they
    are; those that pass both by chance fall out in the join.
    """
    wanted = staged(pairs.select(F.col("earlier").alias("id")).union(pairs.select("later")).distinct()
                    .join(classes.select("id", "key_a", "line", "set_a", "set_b"), "id"), "wanted")

    def table(turned: bool) -> Broadcast:
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = (_place_name(b.column("key_a").to_numpy().view(U64), b.column("line").to_numpy()) for b in batches if b.num_rows)
            yield from count_slots(mix(~x) if turned else x for x in names)

        return docs.sparkSession.sparkContext.broadcast(slot_table(wanted.select("key_a", "line").mapInArrow(mark, COUNTS)))

    marked, turned = table(False), table(True)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            buffer, offsets = text_buffer(part.column("text"))
            starts, ends, owner, number = _line_spans(buffer, offsets)
            key = part.column("key_a").to_numpy().view(U64)
            place = _place_name(key[owner], number)
            passes = (marked.value[slot_of(place)] > 0) & (turned.value[slot_of(mix(~place))] > 0)
            count, sizes = int(passes.sum()), (ends - starts)[passes]
            places = np.concatenate(([0], np.cumsum(sizes)))
            buffer = buffer[np.repeat(starts[passes] - places[:-1], sizes) + np.arange(places[-1])]
            starts, ends, line = word_spans(buffer, places)
            line, hashes, _ = _distinct(line, span_hashes(buffer, starts, ends, LOWER))
            begin = np.searchsorted(line, np.arange(count + 1)).astype(np.int32) * 8
            yield pa.RecordBatch.from_arrays([
                part.column("key_a").take(pa.array(owner[passes])), pa.array(number[passes], pa.int32()), *_set_names(line, hashes, count),
                pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(begin), pa.py_buffer(hashes)])],
                names=["key_a", "line", "set_a", "set_b", "hashes"])

    lines = docs.select("key_a", "text").mapInArrow(gather, "key_a long, line int, set_a long, set_b long, hashes binary")
    found = staged(wanted.join(lines, ["key_a", "line", "set_a", "set_b"]).select("id", "hashes").dropDuplicates(["id"]), "sets")
    side = lambda s: found.select(F.col("id").alias(s), F.col("hashes").alias(f"h_{s}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "h_earlier"):
            owners, names = [], []
            for c in ("h_earlier", "h_later"):
                names.append(np.frombuffer(b"".join(batch.column(c).to_pylist()), U64))
                owners.append(np.repeat(np.arange(batch.num_rows), np.diff(text_buffer(batch.column(c))[1]) // 8))
            owner, name = np.concatenate(owners), np.concatenate(names)
            order = np.lexsort((name, owner))
            owner, name = owner[order], name[order]
            twice = (owner[1:] == owner[:-1]) & (name[1:] == name[:-1])
            common = np.bincount(owner[1:][twice], minlength=batch.num_rows)
            union = np.bincount(owner, minlength=batch.num_rows) - common
            yield batch.select(["later"]).filter(pa.array(100 * common >= percent * union))

    return (pairs.join(side("earlier"), "earlier").join(side("later"), "later")
            .select("later", "h_earlier", "h_later").mapInArrow(verify, "later long").distinct())


def similar_lines(keyed_docs: DataFrame, percent: int = 80) -> DataFrame:
    """(key_a, key_b, line) of every line to which an earlier line, by (doc_id, number), has at least ``percent`` % Jaccard.

    Lines with equal sets are one class. Of a class only its first line can be the first of its
    kind; it goes too if an earlier class is similar. Each class is tested against the first
    class of each of its prefix words; only classes that match none are tested against all
    earlier ones there, so a family of many variants does not become all its pairs. Where two
    sets share a key, the first test was all of it.
    """
    judged = _active(_signatures(keyed_docs, word_rarity(keyed_docs), percent))
    kept = ["set_a", "set_b", "key_a", "line", "n", *BITS, "names", "open"]
    classes = staged(judged.where(F.size("names") > 0).dropDuplicates(["set_a", "set_b"]).select("doc_id", *kept)
                     .repartitionByRange("doc_id", "line").sortWithinPartitions("doc_id", "line", "set_a", "set_b")
                     .withColumn("id", F.monotonically_increasing_id()), "classes")  # ids in the order of the lines
    light = ["n", *BITS]
    entries = lambda some: some.select(F.explode("names").alias("name"), "id", *light)
    met = entries(classes).groupBy("name").agg(F.min("id").alias("id"))
    heads = staged(met.join(classes.select("id", *light), "id"), "heads")

    def pairs(joined: DataFrame, a: str, b: str) -> DataFrame:
        return joined.where(_may_match(a, b, percent)).select(F.col(f"{a}.id").alias("earlier"), F.col(f"{b}.id").alias("later")).distinct()

    tested = staged(pairs(heads.alias("h").join(entries(classes).alias("m"), "name"), "h", "m"), "pairs")
    dropped(heads)
    gone = staged(_verified(tested, classes, keyed_docs, percent), "gone")
    left = classes.join(gone, F.col("id") == F.col("later"), "left_anti")
    more = lambda some: some.select("open", F.posexplode("open").alias("at", "name"), "id", *light).withColumn(
        "before", F.slice("open", F.lit(1), F.col("at"))).drop("open", "at")
    first_shared = ~F.arrays_overlap("e.before", "l.before")  # a pair comes out once, however many keys it shares
    rest = staged(pairs(more(classes).alias("e").join(more(left).alias("l"), "name").where(_may_match("e", "l", percent) & first_shared), "e", "l")
                  .join(tested, ["earlier", "later"], "left_anti"), "pairs")
    dropped(tested)
    late = gone.union(_verified(rest, classes, keyed_docs, percent))
    sets = staged(classes.join(late, F.col("id") == F.col("later"), "left_semi").select("set_a", "set_b"), "gone")
    dropped(classes, rest)
    out = ["key_a", "key_b", "line"]
    return judged.where("copy").select(*out).union(judged.where("not copy").join(sets, ["set_a", "set_b"], "left_semi").select(*out))


def remove_similar_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with the text left, n_lines and n_removed.

    Lines end at ``\\n``. Lines without a word stay. Order is (doc_id, line number); a null
    doc_id counts as the last one. Rows that repeat doc_id and text are one document and are
    cut alike; unequal lines at one place (a doc_id with two texts) come in a fixed order. A null text stays null and has
    no lines; an emptied text is an empty string, its row stays. Input columns named like the
    results are replaced; other columns are kept.
    """
    facts = ["n_lines", "n_removed"]
    columns = [c for c in docs.columns if c not in {*facts, "key_a", "key_b", "removed"}]
    rows = keyed(docs.select(*columns))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id")
    removed = similar_lines(rows.select("key_a", "key_b", order, "text"), percent).distinct().groupBy(
        "key_a", "key_b").agg(F.collect_list("line").alias("removed"))
    joined = rows.join(removed, ["key_a", "key_b"], "left").select(*columns, "removed")
    schema = T.StructType([*docs.select(*columns).schema.fields, *(T.StructField(c, T.LongType()) for c in facts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                texts, counts, gone = [], [], []
                for text, places in zip(part.column("text").to_pylist(), part.column("removed").to_pylist()):
                    out = set(places or ())
                    if out:
                        text_lines = text.split("\n")
                        texts.append("\n".join(x for i, x in enumerate(text_lines) if i not in out))
                    else:
                        texts.append(text)
                    counts.append(0 if text is None else text.count("\n") + 1)
                    gone.append(len(out))
                held = {c: part.column(c) for c in columns}
                held |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held))

    return joined.mapInArrow(run, schema)
