"""Encoding of the whole corpus with a public tokenizer (problem 8).

The rank file is read from a local path (a parameter) by every Python worker, once; texts and ids cross in Arrow batches
and nothing is shuffled. A long text is cut at safe boundaries first, places where the pre-splitting expression always
ends a piece, so that the parts' ids put together are the ids of the whole. Decoding joins the raw bytes of the tokens
before it reads UTF-8, since a token may end within a character.

Defined results: null text, null ids; empty text, an empty list; names of special tokens are ordinary text; texts of
any length are encoded whole; repeated rows each get their ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 50_000
#: Before a blank or line break that stands alone between other characters: a piece ends there whatever precedes.
_SAFE = regex.compile(r"(?<=\S)(?=[ \n]\S)")
_PIECE = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def split_long(text: str, size: int = LONG) -> list[str]:
    """Parts of about *size* characters that end at safe boundaries; a part without any stays whole."""
    parts, begin = [], 0
    while len(text) - begin > size:
        found = _SAFE.search(text, begin + size)
        if found is None:
            break
        parts.append(text[begin : found.start()])
        begin = found.start()
    return [*parts, text[begin:]]


def encode(enc, text: str) -> list[int]:
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in split_long(text):
        if len(part) <= 2 * LONG:
            out += enc.encode_ordinary(part)
        else:  # no safe boundary for long: piece by piece, so that the expression's engine can't run out of steps
            for piece in _PIECE.finditer(part):
                out += enc.encode_single_piece(piece[0].encode()) if hasattr(enc, "encode_single_piece") else enc._encode_single_piece(piece[0])
    return out


def token_ids(text: Column, path: str = RANKS) -> Column:
    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([None if t is None else encode(enc, t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def token_count(text: Column, path: str = RANKS) -> Column:
    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([None if t is None else len(encode(enc, t)) for t in texts.to_pylist()], pa.int64())

    return count(text)


def decoded(ids: Column, path: str = RANKS) -> Column:
    """Text of token ids: raw bytes joined, then read as UTF-8; null ids give null."""

    @F.arrow_udf(StringType())
    def text(lists: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return text(ids)


def corpus_ids(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids) of every document."""
    return documents.select("doc_id", token_ids(F.col("text"), path).alias("ids"))
