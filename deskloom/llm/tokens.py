"""Sizes of texts in tokens of a public tokenizer, and one spelling per source."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where every machine has the vocabulary; a parameter of all operators that count tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits text before merging; a fixed value that belongs to it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _loaded[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, *, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``tokens``; a null text has 0 tokens. Whole texts are encoded."""
    names = [f"k{i}" for i in range(len(keep))]
    inner = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(x)) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sizes, pa.int64())], [*names, "tokens"])

    rows = df.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.col(text).alias("text"))
    out = rows.mapInArrow(each, f"{inner}, tokens long")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "tokens")


def clean_source(c: Column) -> Column:
    """One spelling per source; a null source stays null."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
