"""Text sizes in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Where the vocabulary file lies unless a path is given; it is never copied into the repository.
VOCABULARY = os.environ.get("GRAPHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-tokenisation pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def encoding(path: str):
    """The vocabulary at ``path``, loaded once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    @pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return F.coalesce(count(F.col(text) if isinstance(text, str) else text), F.lit(0))
