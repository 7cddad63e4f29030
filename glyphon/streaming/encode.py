"""Encoding a stream: stateless, so the row-local paths run as they are in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glyphon.operators.embed import encode_rows
from glyphon.operators.tokenize import tokenize_rows
from glyphon.sources.model import Model


def tokenize_stream(stream: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    return tokenize_rows(stream, model, key, text)


def encode_stream(stream: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    return encode_rows(stream, model, key, text)
