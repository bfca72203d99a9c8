"""Transfer through two aligned word spaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import neighbour_means


def cross_covariance(source: DataFrame, target: DataFrame, dictionary: DataFrame) -> np.ndarray:
    """Sum of outer products over dictionary pairs (source_token, target_token): dim x dim numbers.

    Every task adds up one matrix product an Arrow batch and sends one row; Spark adds the rows cell by cell. Vectors are
    scaled to length one, zero vectors stay zero.
    """
    pairs = dictionary.join(source.select(F.col("token").alias("source_token"), F.col("aux").alias("x")), "source_token").join(
        target.select(F.col("token").alias("target_token"), F.col("aux").alias("y")), "target_token"
    )

    def unit(column: pd.Series) -> np.ndarray:
        rows = np.stack(column.to_list()).astype(float)
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                product = unit(batch["x"]).T @ unit(batch["y"])
                total = product if total is None else total + product
        if total is not None:
            yield pd.DataFrame({"width": [total.shape[1]], "cells": [total.ravel()]})

    partial = pairs.select("x", "y").where("x is not null and y is not null").mapInPandas(products, "width int, cells array<double>")
    cells = partial.select("width", F.posexplode("cells").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.max("width").alias("width"))
    rows = cells.toPandas()  # dim * dim rows
    if rows.empty:
        return np.zeros((0, 0))
    out = np.zeros(len(rows))
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out.reshape(-1, int(rows["width"].iloc[0]))


def alignment(source: DataFrame, target: DataFrame, dictionary: DataFrame) -> np.ndarray:
    """Orthogonal map that turns source vectors into the target space."""
    product = cross_covariance(source, target, dictionary)
    if not product.size:  # nothing to align by
        return np.eye(len((source.select("aux").first() or [[]])[0]))
    u, _, vt = np.linalg.svd(product)
    return u @ vt


def rotate(df: DataFrame, matrix: np.ndarray, column: str = "aux") -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(list(np.stack(rows.to_list()) @ matrix)) if len(rows) else rows

    turned = F.pandas_udf(run, "array<double>")
    return df.withColumn(column, turned(column))


def init_aligned(
    targets: DataFrame,
    source: DataFrame,
    source_space: DataFrame,
    target_space: DataFrame,
    dictionary: DataFrame,
    neighbours: int = 10,
    temperature: float = 0.1,
) -> DataFrame:
    """Each target token as the softmax-weighted mean of its nearest source tokens after alignment."""
    turned = rotate(source_space, alignment(source_space, target_space, dictionary))
    keys = source.join(turned, "token").select("id", "aux", "vec")
    queries = targets.join(target_space, "token").select("id", "aux")
    return targets.join(neighbour_means(queries, keys, neighbours, temperature), "id").select("token", "id", "vec")
