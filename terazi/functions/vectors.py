"""Vector expressions and the built-in deterministic encoder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, v: s + v))
    return F.when(norm > 0, F.transform(a, lambda x: (x / norm).cast("float"))).otherwise(a)


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax over two logits: the probability of yes, without overflow."""
    top = F.greatest(yes, no)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))


class HashedEncoder:
    """Bag of word stems hashed into dim signed buckets, at unit length. Stands in for an embedding model: same text, same
    vector, on any machine; texts without words give the zero vector."""

    def __init__(self, dim: int = 256, stem: int = 6):
        self.dim, self.stem = dim, stem

    def encode(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        seen: dict[str, tuple[int, float]] = {}
        for i, text in enumerate(texts):
            for word in (text or "").replace("İ", "i").replace("I", "ı").lower().split():
                word = word.strip(".,;:!?()[]\"'")[: self.stem]
                if len(word) > 2:
                    if word not in seen:
                        h = zlib.crc32(word.encode())
                        seen[word] = h % self.dim, 1.0 if h >> 31 else -1.0
                    at, sign = seen[word]
                    out[i, at] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def encode_column(rows: DataFrame, text: str, out: str = "embedding", encoder: HashedEncoder | None = None) -> DataFrame:
    """rows with the vector of a text column added; any object with encode(list of texts) -> matrix may stand in."""
    encoder = encoder or HashedEncoder()
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = encoder.encode(batch.column(at).to_pylist())
            offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, out])

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return rows.mapInArrow(run, schema)
