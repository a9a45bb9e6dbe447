"""Truncated singular value decomposition of long sparse rows by a randomised range finder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, few

#: Columns of the random block beyond those asked for, and rounds that sharpen it.
EXTRA, ROUNDS = 12, 10


def _columns(width: int) -> list[str]:
    return [f"c{k}" for k in range(width)]


def _signs(feature: Column, width: int, seed: int) -> list[Column]:
    """A row of the random block: 1 or -1 by the bits of a hash of the feature."""
    return [(1 - 2 * F.shiftrightunsigned(F.xxhash64(feature, F.lit(seed + k // 63)), k % 63).bitwiseAND(1)).cast("double").alias(c) for k, c in enumerate(_columns(width))]


def _gram(block: DataFrame, width: int) -> np.ndarray:
    """Products of all columns of a block, width * width numbers."""
    names = _columns(width)
    row = block.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(width) for j in range(i + 1)]).first()
    gram = np.zeros((width, width))
    for i in range(width):
        for j in range(i + 1):
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    return gram


def _turned(block: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    old = _columns(matrix.shape[0])
    return block.select(key, *[sum((F.col(c) * float(x) for c, x in zip(old, matrix[:, k], strict=True)), F.lit(0.0)).alias(n) for k, n in enumerate(_columns(matrix.shape[1]))])


def _orthonormal(block: DataFrame, key: str, width: int, passes: int) -> tuple[DataFrame, int]:
    """A block whose columns span the same space and are orthonormal (the more so with a second pass), and how many these are."""
    for _ in range(passes):
        values, vectors = np.linalg.eigh(_gram(block, width))
        real = values > max(values.max(initial=0.0), 1e-300) * 1e-12
        block, width = _turned(block, key, vectors[:, real] / np.sqrt(values[real])), int(real.sum())
        block = cut(block)
    return block, width


def _times(features: DataFrame, block: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """The sparse rows (or their transpose) times a block whose rows are named ``by``; its rows are named ``to``."""
    names = _columns(width)
    return cut(features.join(few(block), by).groupBy(to).agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in names]))


def truncated_svd(features: DataFrame, n_components: int = 2, key: str = "graph_id", seed: int = 1, rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """key and c0, c1, ... of each instance, its coordinates along the largest singular directions, and the singular values.

    features: key, feature, value. The block of random signs is carried from features to instances and back ``rounds``
    times, made orthonormal each time; only products of its columns reach the driver. A direction's sign is that which
    makes its largest coordinate positive. Of data of fewer directions so many remain. No features: no rows.
    """
    width = n_components + EXTRA
    features = features.select(key, "feature", "value")
    block = features.groupBy(key).agg(*[F.sum(F.col("value") * s).alias(c) for c, s in zip(_columns(width), _signs(F.col("feature"), width, seed), strict=True)])
    block = cut(block)
    for k in range(rounds):
        back, width = _orthonormal(_times(features, block, key, "feature", width), "feature", width, 1 + (k == rounds - 1))
        if not width:
            return features.select(key).limit(0), []
        block = _times(features, back, "feature", key, width)
    # The rows of ``back`` are orthonormal directions of the features; the block is the data along them.
    values, vectors = np.linalg.eigh(_gram(block, width))
    order = np.argsort(-values)[:n_components]
    block = cut(_turned(block, key, vectors[:, order]))
    names = _columns(len(order))
    largest = block.agg(*[F.max_by(c, F.struct(F.round(F.abs(c), 9), -F.col(key))).alias(c) for c in names]).first()
    signs = np.diag([1.0 if (largest[c] or 0) >= 0 else -1.0 for c in names])
    return _turned(block, key, signs), np.sqrt(np.maximum(values[order], 0)).tolist()
