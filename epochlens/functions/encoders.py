"""Hooks for user encoders: callables over batches, with dimension and length checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PROMPTS = ("{query}", "a photograph of {query}", "a museum object showing {query}")


def encode(df: DataFrame, encoder: Callable[[Sequence[str]], np.ndarray], input_col: str, id_col: str, dim: int, model: str = "", version: str = "") -> DataFrame:
    """(id, embedding, model, version): unit vectors that encoder gives a batch of texts or image addresses."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.asarray(encoder(f["value"].tolist()), np.float64).reshape(len(f), -1) if len(f) else np.zeros((0, dim))
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            if v.shape[1] != dim or not np.isfinite(norms).all() or (norms == 0).any():
                raise ValueError("the encoder gave a vector of another dimension, zero, or not finite")
            yield pd.DataFrame({"id": f["id"], "embedding": list((v / norms).astype(np.float32))})

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(input_col).alias("value")).mapInPandas(run, f"id {kind}, embedding array<float>")
    return out.withColumns({"model": F.lit(model), "version": F.lit(version)})


def require_model(vectors: DataFrame, model: str, version: str) -> DataFrame:
    """vectors, if all are of the given model and version; scores against others mean nothing."""
    other = vectors.where(~(F.col("model").eqNullSafe(model) & F.col("version").eqNullSafe(version))).select("model", "version").limit(1).collect()
    if other:
        raise ValueError(f"vectors of {other[0]['model']} {other[0]['version']} don't go with {model} {version}")
    return vectors


def expand_prompts(terms: DataFrame, templates: Sequence[str] = DEFAULT_PROMPTS) -> DataFrame:
    """terms with prompt_id and prompt: the normalized term in each template."""
    if not templates or any("{query}" not in t for t in templates):
        raise ValueError("every template needs {query}")
    return terms.select("*", F.posexplode(F.array(*[F.replace(F.lit(t), F.lit("{query}"), F.col("normalized")) for t in templates])).alias("prompt_id", "prompt"))


def static_vectors(terms: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): terms with their vectors in a (text, embedding) table, whatever the case."""
    t = table.select(F.lower("text").alias("__t"), "embedding")
    joined = terms.join(t, F.lower("normalized") == F.col("__t"), "left").drop("__t")
    return joined.where("embedding is not null"), joined.where("embedding is null").drop("embedding")
