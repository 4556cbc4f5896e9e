"""Pair scoring (K1-K6, P5) of one job's pairs: one array per dimension, NaN where it can't be measured."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the dimensions without and with semantic vectors.
WEIGHTS = {"lexical": 0.40, "char_ngram": 0.30, "entity": 0.15, "structure": 0.10, "order_score": 0.05, "semantic": 0.0}
SEMANTIC_WEIGHTS = {"lexical": 0.25, "char_ngram": 0.15, "entity": 0.10, "structure": 0.10, "order_score": 0.05, "semantic": 0.35}
SHORT_CHARS, SHORT_BUMP, SHORT_CAP = 30, 0.08, 0.98


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def score_columns(chunks: DataFrame) -> list[Column]:
    """What the dimensions need of a chunk besides its matrices; entities as strings, null where there is none."""
    named = F.transform("entities", lambda e: F.concat(e["kind"], F.lit("\0"), e["value"]))
    return [
        F.col("rel_pos"), F.col("char_count"), (F.col("chunk_type") == "table_row").alias("is_row"),
        F.when(F.size("entities") > 0, named).alias("told"), F.when(F.size("section_path") > 0, F.col("section_path")).alias("path"),
    ]


def entity_jaccard(a: set | None, b: set | None) -> float:
    """F8 if either side has an entity."""
    a, b = a or set(), b or set()
    return len(a & b) / len(a | b)


def path_similarity(a: list, b: list) -> float:
    """K2: Dice over the common beginning of two section paths."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x is None or x != y:
            break
        same += 1
    return 2.0 * same / (len(a) + len(b))


class Sides:
    """The attributes of a job's chunks, in the order of their matrices."""

    def __init__(self, table: pa.Table):
        self.rel_pos, self.chars = table["rel_pos"].to_numpy(), table["char_count"].to_numpy().astype(np.int64)
        self.is_row = np.array(table["is_row"].to_pylist(), dtype=bool)
        self.told = [None if t is None else set(t) for t in table["told"].to_pylist()]
        self.path = table["path"].to_pylist()
        self.tells, self.placed = (np.array([x is not None for x in xs]) for xs in (self.told, self.path))

    def dims(self, i: np.ndarray, j: np.ndarray, lexical: np.ndarray, char_ngram: np.ndarray, semantic: np.ndarray | None) -> dict[str, np.ndarray]:
        none = np.full(len(i), np.nan)
        entity, structure = none.copy(), none.copy()
        for k in np.flatnonzero(self.tells[i] | self.tells[j]) if self.tells.any() else ():
            entity[k] = entity_jaccard(self.told[i[k]], self.told[j[k]])
        for k in np.flatnonzero(self.placed[i] & self.placed[j]) if self.placed.any() else ():
            structure[k] = path_similarity(self.path[i[k]], self.path[j[k]])
        order = 1.0 - np.abs(self.rel_pos[i] - self.rel_pos[j])
        return {"lexical": np.clip(lexical, 0.0, 1.0), "char_ngram": char_ngram, "entity": entity, "structure": structure, "order_score": order, "semantic": none if semantic is None else semantic}

    def final(self, i: np.ndarray, j: np.ndarray, dims: dict[str, np.ndarray], semantic: bool) -> np.ndarray:
        """K1, K3, K4: the weighted mean of the dimensions that can be measured; amounts count twice between table rows."""
        weights = SEMANTIC_WEIGHTS if semantic else WEIGHTS
        num = den = np.zeros(len(i))
        for name, value in dims.items():
            w = np.where(self.is_row[i] & self.is_row[j], weights[name] * 2, weights[name]) if name == "entity" else weights[name]
            num = num + np.where(np.isnan(value), 0.0, w * value)
            den = den + np.where(np.isnan(value), 0.0, w)
        return np.clip(num / den, 0.0, 1.0)

    def threshold(self, i: np.ndarray, j: np.ndarray, base: float) -> np.ndarray:
        """P5: pairs with a short side need more."""
        short = np.minimum(self.chars[i], self.chars[j]) < SHORT_CHARS
        return np.where(short, min(base + SHORT_BUMP, SHORT_CAP), base)
