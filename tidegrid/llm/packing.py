"""Packing of token pieces into sequences by hierarchical residual best fit.

Items are dealt to groups of bounded size and packed there, largest first, each into the
fullest sequence with room. Sequences with less room than the smallest sequence of the round
are done. The others are items of the next round, in fewer groups, until one group has seen
them all or no round helps any more.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import small_slices, staged, text_buffer
from tidegrid.llm.textbytes import BYTE, mix, span_hashes

CAPACITY = 2048
#: Items that one task packs, about; and groups that meet in the next round.
GROUP_ITEMS, FAN_IN = 50_000, 8
#: Encoded chunks that a task remembers before it starts anew.
REMEMBERED = 150_000
_OTHER = mix(BYTE)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible ones stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> tuple[Callable[[list[str]], Iterable[Sequence[int]]], dict[bytes, int]]:
    """Ids of many strings by a tokenizer file, and its added tokens, which texts are cut at.

    An added token found in a text has its own id, as the tokenizers library gives it without being
    told otherwise; one that swallows spaces or needs word borders is refused. Where the file is plain byte-level BPE whose merges come in the order of their ids, its
    vocabulary goes to tiktoken as ranks: the same ids, several times faster. Any other file is
    left to the tokenizers library.
    """
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split = held["model"], held.get("pre_tokenizer") or {}
    tokens = held.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that depend on what stands beside them are not supported")
    added = {t["content"].encode(): t["id"] for t in tokens}
    special = {t["content"] for t in tokens}
    vocabulary = {t: i for t, i in model.get("vocab", {}).items() if t not in special} if model.get("type") == "BPE" else {}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    numbers = [vocabulary.get(m) for m in merged]
    plain = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
             and not held.get("normalizer") and numbers == list(range(256, 256 + len(merged))) and len(vocabulary) == 256 + len(merged))
    if plain:
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: map(encoding.encode_ordinary, texts), added
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: (e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)), added


def _added_places(raw: bytes, offsets: np.ndarray, added: dict[bytes, int]) -> list[int]:
    """Both ends of every added token in the texts, the longer one where two begin alike."""
    if not any(content in raw for content in added):
        return []
    pattern = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))))
    return [at for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for found in pattern.finditer(raw, low, high) for at in found.span()]


def _chunks(buffer: np.ndarray, offsets: np.ndarray, places: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the tokenizer's pattern never crosses: cut at ``places`` and before a space or line break that follows a letter or digit.

    Letters counted here are the ASCII ones and the two-byte ones of Latin-1; leaving others out makes longer spans only.
    """
    n = len(buffer)
    latin = np.zeros(n, bool)
    latin[1:] = (buffer[:-1] == 0xC3) & (buffer[1:] != 0x97) & (buffer[1:] != 0xB7)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = ((buffer[1:] == 32) | (buffer[1:] == 10)) & (_ALNUM[buffer] | latin)[:-1]
    for low, high in zip(places[::2], places[1::2]):
        cut[low: high] = False  # an added token stays whole
    cut[offsets] = True
    cut[np.array(places, np.int64)] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.append(starts[1:], n)


def encode_all(buffer: np.ndarray, offsets: np.ndarray, tokenizer, known: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind each other and the number of ids of each; each distinct chunk is encoded once."""
    if not len(buffer):
        return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
    encode, added = tokenizer
    raw = buffer.tobytes()
    starts, ends = _chunks(buffer, offsets, _added_places(raw, offsets, added))
    names, others = span_hashes(buffer, starts, ends), span_hashes(buffer, starts, ends, _OTHER)
    codes, _ = pd.factorize(names)
    first = np.zeros(codes.max() + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if (others[first[codes]] != others).any():  # two chunks of one hash
        codes, _ = pd.factorize(pd.MultiIndex.from_arrays([names, others]))
        first = np.zeros(codes.max() + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
    texts = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    if len(known) > REMEMBERED:
        known.clear()
    known.update((content, array("I", [number]).tobytes()) for content, number in added.items())
    new = [t for t in texts if t not in known]
    for at in range(0, len(new), 20_000):
        some = new[at: at + 20_000]
        for text, found in zip(some, encode([t.decode() for t in some])):
            known[text] = array("I", found).tobytes()
    parts = [known[t] for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat, begin = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
    count = size[codes]
    ids = flat[np.repeat(begin[codes] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    text = np.searchsorted(offsets, starts, side="right") - 1
    return ids, np.bincount(text, weights=count, minlength=len(offsets) - 1).astype(np.int64)


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and end id, cut only beyond ``capacity``.

    A longer document gives full pieces after a first one with the rest. Null and empty texts are the end id alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = load_tokenizer(tokenizer_file), {}
        tail = np.array([end_id], "<u4").tobytes()
        for part in small_slices(batches):
            flat, count = encode_all(*text_buffer(part.column("text")), tokenizer, known)
            raw, at = flat.tobytes(), 0
            rows: list[tuple] = []
            for i, n in enumerate(count.tolist()):
                own = raw[4 * at: 4 * (at + n)] + tail
                at, total = at + n, n + 1
                pieces = -(-total // capacity)
                end = total - capacity * (pieces - 1)
                start = 0
                for piece in range(pieces):
                    held = own[4 * start: 4 * end]
                    rows.append((i, piece, start, end - start, zlib.crc32(held), held))
                    start, end = end, end + capacity
            of, *columns = zip(*rows)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(columns[: 4 + ids], kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *columns],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each length, given in falling order; each goes into the fullest bin with room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0  # bit r is set while a bin with room r exists
    bin_of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, chosen, bins = capacity, bins, bins + 1
        bin_of[i], place[i] = chosen, capacity - room
        left = room - length
        if left:
            if not rooms[left]:
                open_rooms |= 1 << left
            rooms[left].append(chosen)
    return bin_of, place


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fill, name = table.column("fill").to_numpy(), table.column("bin").to_numpy()
        order = np.lexsort((name, -fill))
        bin_of, place = np.zeros(len(fill), np.int64), np.zeros(len(fill), np.int64)
        bin_of[order], place[order] = best_fit(fill[order], capacity)
        members = table.column("members").combine_chunks()
        count = members.value_lengths().to_numpy()
        flat = members.flatten()
        row = np.repeat(np.arange(len(fill)), count)
        item, offset = flat.field("item").to_numpy(), flat.field("offset").to_numpy() + place[row]
        by = np.lexsort((offset, bin_of[row]))
        item, offset, held = item[by], offset[by].astype(np.int32), bin_of[row][by]
        begin = np.searchsorted(held, np.arange(held[-1] + 2))
        whole = np.bincount(bin_of, weights=fill).astype(np.int64)
        return pa.table({
            "bin": pa.array(np.minimum.reduceat(item, begin[:-1])), "fill": pa.array(whole),
            "members": pa.ListArray.from_arrays(begin.astype(np.int32), pa.StructArray.from_arrays(
                [pa.array(item), pa.array(offset)], names=["item", "offset"]))})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """(item, sequence_id, offset) for items (item, length), item unique, length from 1 to ``capacity``.

    A sequence is named by its smallest item. A group holds about ``group_items`` rows in every
    round, so no task sees more however many items there are; a sequence has at most
    ``capacity`` members. An empty table gives none.
    """
    schema = "bin long, fill long, members array<struct<item: long, offset: int>>"
    single = F.array(F.struct(F.col("item").cast("long").alias("item"), F.lit(0).alias("offset"))).alias("members")
    bins = items.select(F.col("item").cast("long").alias("bin"), F.col("length").cast("long").alias("fill"), single)
    done, bins = [bins.where(F.col("fill") >= capacity)], staged(bins.where(F.col("fill") < capacity), "items")
    left, groups, salt = bins.count(), None, 0
    while left:
        fit = -(-left // group_items)
        groups = fit if groups is None else max(1, fit, -(-groups // fan_in))
        group = F.pmod(F.xxhash64("bin", F.lit(salt)), F.lit(groups)).alias("part")
        packed = staged(bins.select("*", group).groupBy("part").applyInArrow(_pack_group(capacity), schema), "packed")
        least, before = packed.agg(F.min("fill")).first()[0], left
        fits = F.col("fill") <= capacity - least
        bins, salt = packed.where(fits), salt + 1
        left = bins.count()
        last = groups == 1 or left >= before or left < 2
        done.append(packed if last else packed.where(~fits))
        if last:
            break
    member = F.explode("members").alias("m")
    return reduce(DataFrame.unionAll, done).select("bin", member).select(
        F.col("m.item").alias("item"), F.col("bin").alias("sequence_id"), F.col("m.offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Per piece of each input row: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids on demand).

    Repeated rows and null doc_ids are documents of their own; other columns are left out.
    """
    pieces = staged(token_pieces(docs, tokenizer_file, end_id, capacity, ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("item", "length"), capacity), "item").drop("item")
