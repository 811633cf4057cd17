"""Token counts of a public byte-level BPE tokenizer, loaded once per worker."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed values: the published pre-tokenisation pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 1 << 20


@lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, and the byte length of each of its tokens."""
    import tiktoken

    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def longest_token(path: str) -> int:
    return int(encoder(path)[1].max())


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions at which the pre-tokenizer always cuts: white space after a printable ASCII byte."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    before, here = data[:-1], data[1:]
    return np.flatnonzero((before > 32) & (before < 127) & ((here == 32) | ((here >= 9) & (here <= 13)))) + 1


def count(text: str | None, path: str) -> int:
    """Tokens of a whole text, counted in slices between safe cuts where it is very long; 0 for null."""
    if not text:
        return 0
    enc = encoder(path)[0]
    if len(text) <= SLICE:
        return len(enc.encode_ordinary(text))
    raw = text.encode("utf-8", "replace")
    cuts, total, at = safe_cuts(np.frombuffer(raw, np.uint8)), 0, 0
    while at < len(raw):
        k = np.searchsorted(cuts, at + SLICE)
        to = int(cuts[k]) if k < len(cuts) else len(raw)
        total += len(enc.encode_ordinary(raw[at:to].decode("utf-8", "replace")))
        at = to
    return total


def token_count(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """The number of tokens of a text column."""

    @F.pandas_udf(T.LongType())
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([count(x, path) for x in texts], dtype="int64")

    return counts(text)
