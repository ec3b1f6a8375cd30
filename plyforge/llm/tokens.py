"""Token counts of texts under a public byte-level vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.session import map_arrow

#: Where the vocabulary files are; every function takes another path.
VOCABULARY = os.environ.get("PLYFORGE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# How this vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """One encoder for each worker process and vocabulary."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """Replace ``text`` by its number of tokens; the other columns pass through.

    A null text has no tokens, like an empty one. Whole texts are encoded, in
    the tasks that scan them; nothing is shuffled.
    """
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others).schema.add(out, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(n, pa.int64())], [*others, out])

    return map_arrow(docs.select(*others, F.col(text)), count, schema)
