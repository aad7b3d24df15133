"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The place of a rank file and the pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keep: Sequence[str], text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The ``keep`` columns and ``n_tokens``, how many tokens the whole ``text`` has; null and empty texts have 0.

    ``ranks`` is the path of a rank file on every executor. Text the tokenizer's matcher can't take in one go (runs
    of a million spaces) is split by the same pattern outside it, with the same result.
    """
    schema = df.select(*keep).schema.add("n_tokens", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks, pattern)

        def count(t: str | None) -> int:
            if not t:
                return 0
            try:
                return len(enc.encode_ordinary(t))
            except BaseException as e:  # the matcher's stack overflow isn't an Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                import regex

                return sum(len(enc._core_bpe.encode_single_piece(m.group().encode())) for m in regex.finditer(pattern, t))

        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "n_tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
