"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file (ranks of a byte-level BPE), overridden by HERONLAKE_VOCABULARY.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how that vocabulary's texts are parted before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoder(path: str):
    """The encoder, loaded once for each worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of ``text``; 0 for null. Strings of special tokens count as ordinary text."""
    path = path or os.environ.get("HERONLAKE_VOCABULARY", VOCABULARY)

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="int32")

    return count.asNondeterministic()(text)  # else a filter on the count would count again
