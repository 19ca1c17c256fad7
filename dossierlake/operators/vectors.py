"""Hashed embeddings as sparse rows, dot products and vector top-k."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions.text import bind, explode_rows
from dossierlake.functions.tokens import tokenize

# Fixed value: embedding width.
DIMENSIONS = 384
KNOWN_TOKENS = 1 << 18


def sparse_cells(body: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """array<struct(slot, weight)> of a text, integer weights before normalisation, by slot.

    The tokens of a text lie in its own row and are counted there, a batch of rows at a time; a worker
    hashes a token once while it is known (at most KNOWN_TOKENS are). Nothing is shuffled.
    """
    known: dict[str, tuple[int, int]] = {}

    def cell(token: str) -> tuple[int, int]:
        if token not in known:
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            digest = hashlib.md5(token.encode("utf-8")).hexdigest()
            known[token] = (int(digest[:8], 16) % dimensions, 1 if digest[9] in "02468ace" else -1)
        return known[token]

    def counted(tokens: list[str]) -> list[dict[str, int]]:
        if not len(tokens):
            return []
        slots, signs = np.array([cell(t) for t in tokens]).T
        sums = np.bincount(slots, signs, dimensions).astype(int)
        at = np.flatnonzero(sums)
        return [{"slot": s, "weight": w} for s, w in zip(at.tolist(), sums[at].tolist(), strict=True)]

    @F.pandas_udf("array<struct<slot:bigint,weight:bigint>>")
    def cells(tokens: pd.Series) -> pd.Series:
        return tokens.map(counted)

    return cells(tokenize(body))


def square_of(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("bigint"), lambda acc, c: acc + c["weight"] * c["weight"])


def cells_cosine(left: Column, right: Column) -> Column:
    """Cosine of two sparse texts; 0 when either is empty."""

    def product(cells: Column) -> Column:
        weights = F.map_from_entries(right)
        return bind(
            weights,
            lambda w: F.aggregate(
                cells, F.lit(0).cast("bigint"), lambda acc, c: acc + c["weight"] * F.coalesce(F.try_element_at(w, c["slot"]), F.lit(0))
            ),
        )

    scale = F.sqrt(square_of(left).cast("double")) * F.sqrt(square_of(right).cast("double"))
    return F.coalesce(F.try_divide(product(left).cast("double"), scale), F.lit(0.0))


def sparse_embedding(rows: DataFrame, key: str, body: Column | str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, slot, weight, square): one row per slot, `square` is the squared norm of the whole text."""
    packed = rows.select(F.col(key), sparse_cells(body, dimensions).alias("cells")).withColumn("square", square_of(F.col("cells")))
    return explode_rows(packed, [key, "square"], F.col("cells"), "c").select(key, "c.slot", "c.weight", "square")


def dense_embedding(sparse: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """The unit vector as an array, for export to a vector store."""
    entries = sparse.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("entries"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight")).cast("double")).alias("norm"),
    )
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(dimensions - 1).cast("bigint"))
    value = F.transform(slots, lambda s: F.coalesce(F.try_element_at("entries", s), F.lit(0)) / F.col("norm"))
    return entries.select(key, value.alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit mean vector per group: position-wise sums, so no group is gathered in one place."""
    parts = vectors.select(F.col(group), F.posexplode(vector).alias("pos", "value"))
    means = parts.groupBy(group, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    packed = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    values = F.transform("cells", lambda c: c["value"])
    square = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    return packed.select(group, F.transform(values, lambda x: x / F.sqrt(square)).alias("centroid"))
