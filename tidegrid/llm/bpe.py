"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Token ids travel as one binary value per text, four little-endian bytes an id: compact
in shuffles and Parquet, hashed by built-in functions, and read by ``numpy.frombuffer``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import byte_slices

#: Characters of a text handed to the library at once.
CHUNK = 1 << 16
#: A letter or digit before a space or line break: no match of the pattern reaches across.
SAFE = re.compile(r"[^\W_](?=[ \n])")


@lru_cache(maxsize=4)
def load_ranks(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (a base64 token and its rank a line), once per process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """``text`` in pieces cut at safe boundaries; True marks a piece that found none within four sizes."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        end = found.end() if found else len(text)
        yield text[at:end], end - at > 4 * size
        at = end
    if at < len(text):
        yield text[at:], False


def encode_text(encoding: tiktoken.Encoding, pattern: str, text: str, size: int = CHUNK) -> list[int]:
    """Ids of one text. A long text is cut where no match can span, so the ids are those of the whole."""
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for chunk, unbroken in safe_chunks(text, size):
        if unbroken:  # each match by itself: the library's matcher gives up on very long runs
            for match in regex.finditer(pattern, chunk):
                ids += encoding._encode_single_piece(match.group())
        else:
            ids += encoding.encode_ordinary(chunk)
    return ids


def _output(df: DataFrame, column: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != column] + [T.StructField(column, T.BinaryType())])


def encode(df: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, text: str = "text",
           output: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """``df`` without its text and with the binary ids of each whole text, one row per input row.

    Null and empty texts have no ids (an empty binary). A text of any length is encoded
    whole; repeated rows give equal rows; an input column named like ``output`` is replaced.
    ``rank_file`` is a path that every executor can open.
    """
    kept = [c for c in df.columns if c not in (text, output)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_ranks(rank_file, pattern)
        for batch in batches:
            for part in byte_slices(batch, text):
                ids = [np.array(encode_text(encoding, pattern, value or "", chunk), "<u4").tobytes()
                       for value in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(ids, pa.binary())],
                                                 names=[*kept, output])

    frame = df.select(*kept, text)
    return frame.mapInArrow(run, _output(df.select(*kept), output))


def decode(df: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids",
           output: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of each row's ids in ``output``; null ids give empty bytes.

    Bytes, not text: a cut id sequence may end inside a character.
    """
    kept = [c for c in df.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_ranks(rank_file, pattern)
        for batch in batches:
            for part in byte_slices(batch, ids):
                raw = [encoding.decode_bytes(np.frombuffer(value or b"", "<u4").tolist())
                       for value in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(raw, pa.binary())],
                                                 names=[*kept, output])

    return df.select(*kept).mapInArrow(run, _output(df.select(*kept), output))


def token_digests(docs: DataFrame, rank_file: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes decoded from them."""
    both = decode(encode(docs.select("doc_id", "text"), rank_file), rank_file)
    return both.select(
        "doc_id", F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
