"""Embedding as a hook: any function from texts to vectors; and a deterministic one without a model, for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE, QUERY = "passage: ", "query: "


def hashed(texts: Sequence[str], dim: int = 384) -> np.ndarray:
    """Unit vectors of signed word counts."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out[i])
        out[i] /= norm or 1
    return out


def embed(df: DataFrame, text_col: str, model: Callable[[Sequence[str]], np.ndarray] = hashed, dim: int = 384, prefix: str = PASSAGE, out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """``df`` with a vector of each text; a model that gives another length is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, batch_size):
                part = batch.slice(i, batch_size)
                vectors = model([prefix + (t or "") for t in part.column(part.schema.get_field_index(text_col)).to_pylist()])
                if vectors.shape != (part.num_rows, dim):
                    raise ValueError(f"expected vectors of length {dim}, got {vectors.shape}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], names=[*part.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast("array<float>")).schema)


def from_blob(df: DataFrame, blob_col: str, out: str = "embedding") -> DataFrame:
    """Little-endian 32-bit floats as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [None if b is None else np.frombuffer(b, "<f4") for b in batch.column(batch.schema.get_field_index(blob_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arrays, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast("array<float>")).schema)


def to_blob(df: DataFrame, vector_col: str, out: str = "blob") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [None if v is None else np.array(v, "<f4").tobytes() for v in batch.column(batch.schema.get_field_index(vector_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blobs, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast("binary")).schema)
