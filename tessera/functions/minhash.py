"""MinHash signatures of gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 128
#: Fixed value: start and step of the generator of the affine parameters.
GOLDEN = 0x9E3779B97F4A7C15


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    """(multipliers, offsets): alternating outputs of the splitmix64 generator, multipliers made odd."""
    with np.errstate(over="ignore"):
        z = np.uint64(GOLDEN) * np.arange(2, 2 * SLOTS + 2, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z[0::2] | np.uint64(1), z[1::2]


_A, _B = _parameters()


def gram_hashes(grams: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g.encode(), 0) for g in grams], dtype=np.uint64)


def signature_of(hashes: np.ndarray) -> np.ndarray:
    """Per slot the unsigned minimum of a * hash + b modulo 2**64; all ones for no gram."""
    if len(hashes) == 0:
        return np.full(SLOTS, 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (hashes[:, None] * _A[None, :] + _B[None, :]).min(axis=0)


def signature(grams: list[str]) -> np.ndarray:
    return signature_of(gram_hashes(grams))


def minhash(grams: Column) -> Column:
    """ARRAY<BIGINT> of the 64-bit patterns."""

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([signature(list(g) if g is not None else []).view(np.int64) for g in s], dtype=object)

    return of(grams)
