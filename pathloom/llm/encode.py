"""Encoding a whole corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encode_batches

_INT_ARRAY = T.ArrayType(T.IntegerType(), True)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None) -> DataFrame:
    """One row (key, ids) per input row, without special tokens.

    A null and an empty text have an empty list; a blank text is text. Other columns of the input
    are not read. Rows repeat as the input repeats them. No exchange: every partition is encoded
    where it is, in Arrow batches, whole texts of any length.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", _INT_ARRAY)])
    return df.select(F.col(key), F.col(text)).mapInArrow(
        lambda batches: (b.rename_columns([key, "ids"]) for b in encode_batches(batches, rank_file, False)), schema
    )


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None) -> DataFrame:
    """One row (key, n_tokens) per input row; 0 for a null and an empty text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(key), F.col(text)).mapInArrow(
        lambda batches: (b.rename_columns([key, "n_tokens"]) for b in encode_batches(batches, rank_file, True)), schema
    )
