"""Sizes of texts in tokens of a public tokenizer; its file is a parameter and stays outside the repository."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary file (ranks of byte pairs); it must be at this path on every executor.
TOKENIZER = os.environ.get("LEXIVANE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern by which the public vocabulary's tokenizer cuts texts before it merges byte pairs.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are counted in parts of about so many characters, so that memory is bounded; all of the text counts.
PART = 100_000
#: Before white space that follows none, the pattern always begins a new piece, so that a cut there changes no token.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lexivane", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Number of tokens; 0 for null and empty texts. Unpaired surrogates count as the replacement character."""
    if not text:
        return 0
    encode = encoding(path).encode_ordinary
    return sum(len(encode(part)) for part in parts(text))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of ``size`` characters or as many more as there are to the next white space."""
    start = 0
    while len(text) - start > size:
        m = _BEFORE_SPACE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def token_counts(text: Column, path: str = TOKENIZER) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    return count(text)


def sized(documents: DataFrame, path: str = TOKENIZER, *extra: str) -> DataFrame:
    """doc_id, n_tokens and the ``extra`` columns of (doc_id, text); rows without an id are left out."""
    kept = documents.where(F.col("doc_id").isNotNull())
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, token_counts(F.col("text"), path).alias("n_tokens"))
