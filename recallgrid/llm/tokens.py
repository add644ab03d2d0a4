"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of public vocabulary files, the same on all executors; a file of ranks of the library `tiktoken`.
TOKENIZER_DIR = os.environ.get("RECALLGRID_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how a text is cut before its parts are encoded, as this public vocabulary wants it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict = {}


def tokenizer(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def sizes(texts: list[str], path: str) -> list[int]:
    encode = tokenizer(path).encode_ordinary
    return [len(encode(t)) for t in texts]


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(sizes(batch.column(2).to_pylist(), path), pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), n], names=["doc_id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, *, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of each document with an id and a text; whole texts are counted.

    Repeated ids are one document: of different texts under one id the greatest stands. Null texts are left out, empty
    ones have 0 tokens.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counted = rows.mapInArrow(_counter(os.path.join(directory, vocabulary)), "doc_id bigint, source string, tokens bigint")
    return counted.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("one_")).select("doc_id", "one_.source", "one_.tokens")
