"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Path of the vocabulary on every machine: lines of base64 token and rank. Never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's texts are divided into words (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a vocabulary file; one per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, text: str = "text", *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., n_tokens bigint): whole texts; null and empty ones have 0. Only ``keep`` and ``text`` are read."""
    from pyspark.sql import types as T

    rows = documents.select(*keep, documents[text].cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).encode_ordinary
        for b in batches:
            sizes = [len(count(x.as_py())) if x.is_valid else 0 for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, schema)
