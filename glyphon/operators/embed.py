"""Pooling token vectors to document vectors: row by row, or by joins and grouped sums.

Row by row is the default: no shuffle, no hot word, and it serves streams. The model's
matrix goes to the executors then, behind a check of its bytes; a larger one is joined.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from glyphon.shipping import ship
from glyphon.sources.model import Model

from .tokenize import RowTokenizer, in_worker, named, small, tokenize, tokenize_rows

#: Bytes of a matrix up to which it is broadcast.
MATRIX_BYTES = 1 << 29
#: Tokens whose vectors are held at once while a text is pooled.
_STRIP = 1 << 14


def token_counts(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token_id, n): the order of tokens doesn't matter to a mean."""
    return tokens.select(key, F.explode("tokens").alias("token_id")).groupBy(key, "token_id").agg(F.count(F.lit(1)).alias("n"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector has no direction and becomes NaN."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), l2_norm(v)), F.lit(float("nan"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pool(tokens: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, embedding): the mean of the (weighted) vectors, of unit length; zeros without tokens."""
    d = model.dimensions
    table = model.vocab.join(model.vectors, "row_id").select("token_id", "weight", "vec")
    rows = token_counts(tokens, key).join(small(table, len(model.tokenizer.vocab)) if model.matrix_bytes() <= MATRIX_BYTES else table, "token_id")
    weight = F.col("n") * (F.col("weight") if model.weighted else F.lit(1.0))
    # one aggregate of 128 sums stays in generated code, so wider vectors take several over one set of rows
    sums = None
    for low in range(0, d, 128):
        cells = range(low, min(low + 128, d))
        part = rows.groupBy(key).agg(F.sum("n").alias("total"), *[F.sum(weight * F.col("vec")[i]).alias(f"s{i}") for i in cells])
        part = part.select(key, "total", F.array(*[F.col(f"s{i}") for i in cells]).alias("s"))
        sums = part if sums is None else sums.join(part.select(key, F.col("s").alias("more")), key).select(key, "total", F.concat("s", "more").alias("s"))
    mean = sums.select(key, normalized(F.transform("s", lambda x: x / F.col("total"))).alias("e"))
    out = tokens.select(key, F.col("tokens").isNull().alias("none")).join(mean, key, "left")
    zeros = F.array_repeat(F.lit(0.0), d)
    return out.select(key, F.when(~F.col("none"), F.coalesce("e", zeros)).cast("array<float>").alias("embedding"))


def pooled(ids: np.ndarray, matrix: np.ndarray, row: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """The unit vector of a text's tokens; zeros without tokens, NaN where the mean is zero."""
    total = np.zeros(matrix.shape[1])
    if not len(ids):
        return total
    for a in range(0, len(ids), _STRIP):
        part = ids[a : a + _STRIP]
        vectors = matrix[row[part]]
        total += vectors.sum(axis=0, dtype=np.float64) if weight is None else weight[part] @ vectors.astype(np.float64)
    total /= len(ids)
    with np.errstate(divide="ignore", invalid="ignore"):
        return total / np.sqrt(total @ total)


def encode_rows(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, embedding): tokenized and pooled in one pass over the rows, for batches and streams alike."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, model.tokenizer, *model.table()))

    def encode(batches):
        name, t, matrix, row, weight = sent.value
        local = in_worker(name, lambda: RowTokenizer(t))
        for b in batches:
            out = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = None if x is None else named(lambda: local.tokens(x), k)  # noqa: B023
                out.append(None if ids is None else pooled(np.array(ids, np.int64), matrix, row, weight).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    kind = StructType([df.schema[key], StructField("embedding", ArrayType(FloatType()))])
    return df.select(key, text).mapInArrow(encode, kind)


class Encoder:
    """The public face of a model: Tokenize, Encode and Dimensions over a DataFrame."""

    def __init__(self, model: Model):
        self.model = model
        self.dimensions = model.dimensions

    def tokenize(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return tokenize_rows(df, self.model, key, text)

    def encode(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        if self.model.matrix_bytes() <= MATRIX_BYTES:
            return encode_rows(df, self.model, key, text)
        return pool(self.tokenize(df, key, text), self.model, key)

    def encode_joined(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """By distinct words, joins and grouped sums, whatever the model's size."""
        return pool(tokenize(df, self.model, key, text), self.model, key)
