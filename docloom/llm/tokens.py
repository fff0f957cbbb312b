"""Sizes of texts in tokens of a public tokenizer; vocabularies are read from a folder, never copied into the library."""

from __future__ import annotations

import base64
import os

import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, tiktoken.Encoding] = {}


def _parsed(path: str, data: bytes) -> tiktoken.Encoding:
    if path not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encoding(path: str = TOKENIZER) -> tiktoken.Encoding:
    """The encoding of a rank file on the driver."""
    if path in _loaded:
        return _loaded[path]
    with open(path, "rb") as f:
        return _parsed(path, f.read())


def shipped(spark: SparkSession, path: str = TOKENIZER) -> Broadcast:
    """The rank file, read on the driver and sent with the job: executors need no copy. Its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def opened(shared: Broadcast) -> tiktoken.Encoding:
    """The encoding on an executor, parsed once a worker."""
    return _parsed(*shared.value)
