"""Places where users plug in their own functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def apply_detector(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Pages or tiles to boxes. ``load()`` runs once per task and returns a function over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def apply_recogniser(
    df: DataFrame, load: Callable[[], Callable[[Mapping[str, Any]], tuple[str, float]]], keys: tuple[str, ...] = ("image_id", "det_idx")
) -> DataFrame:
    """Crops, as columns by name, to (text, score). A crop on which the model fails gives ('', -1)."""
    fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts, scores = [], []
            for crop in batch.to_dict("records"):
                try:
                    text, score = model(crop)
                except Exception:
                    text, score = "", -1.0
                texts.append(text)
                scores.append(float(score))
            yield batch[list(keys)].assign(text=texts, score=scores)

    return df.mapInPandas(run, ", ".join([*fields, "text string", "score double"]))


def preprocess(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return df.transform(fn)


def handle_labels(df: DataFrame, handler: Callable[[Column], Column], label: str = "label") -> DataFrame:
    """Labels through a Column function; rows whose label becomes null are dropped."""
    return df.withColumn(label, handler(F.col(label))).where(F.col(label).isNotNull())


def tokenizer(fn: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A Python tokenizer as an Arrow-batched function of a text column."""

    @F.pandas_udf(ArrayType(StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fn(t) if t is not None else None)

    return tokens
