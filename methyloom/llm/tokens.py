"""Token ids of whole corpora with a public tokenizer's rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places where a token of PATTERN always ends: after a letter before a non-letter, after a digit before a non-digit,
#: and between a character and a single space before another one.
_SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?= \S)")
#: Texts longer than this are encoded piece by piece.
PIECE = 1 << 16
#: A rank file is shipped to the workers only up to this size.
MOST_BYTES = 64 << 20


@lru_cache(4)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("from_rank_file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """``text`` cut where no token can span, into pieces of ``most`` characters or a little more."""
    at = 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m or m.start() >= len(text):
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, ranks: bytes) -> list[int]:
    """Ids of ``text`` as ordinary text; none for null and empty."""
    if not text:
        return []
    enc = _encoding(ranks)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(MOST_BYTES + 1)
    if len(ranks) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return ranks


def _shipped(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


def token_ids(docs: DataFrame, id_col: str, text_col: str, ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``id_col`` and ``ids`` (ARRAY<INT>), one row per row of ``docs``, without special tokens.

    Null and empty texts give an empty list; the strings of special tokens are ordinary text; blanks are encoded as
    they are. The rank file is read by the driver and shipped once to each executor (under MOST_BYTES). No shuffle:
    each task encodes the texts it scans, a long one in pieces cut where no token can span.
    """
    ranks = _shipped(docs.sparkSession, ranks_path)
    key = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([encode(t, ranks.value) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key.name, "ids"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, ids ARRAY<INT>")


def token_texts(tokens: DataFrame, id_col: str, ids_col: str = "ids", ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``id_col``, ``bytes`` (BINARY), ``text``: the raw bytes of the ids joined and, where they are valid UTF-8, the
    text (null otherwise: a list may be cut inside a character). A null list gives nulls; an unknown id raises."""
    ranks = _shipped(tokens.sparkSession, ranks_path)
    key = tokens.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = _encoding(ranks.value)
            raw = [None if ids is None else enc.decode_bytes(ids) for ids in b.column(1).to_pylist()]
            text = []
            for r in raw:
                try:
                    text.append(None if r is None else r.decode("utf-8"))
                except UnicodeDecodeError:
                    text.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=[key.name, "bytes", "text"])

    return tokens.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, bytes BINARY, text STRING")
