"""Half-precision bit patterns (N7-N9) as Arrow-batched pandas UDFs.

Spark SQL has no float bit reinterpretation, so these run vectorised in numpy
on Arrow batches (numpy on each row's array).

Conversion rules follow the reference: float32 -> float16 *truncates* the
mantissa (no rounding), underflow gives a signed zero, overflow gives
infinity, NaN keeps a quiet NaN. float16 -> float32 follows IEEE (the
reference mis-scales subnormals; we do not copy that).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF_CLAMP = 50.0


def to_half_bits_np(x: np.ndarray) -> np.ndarray:
    """float32 array -> uint16 bit patterns with mantissa truncation."""
    b = np.asarray(x, dtype=np.float32).view(np.uint32)
    sign = ((b >> 31) & 1).astype(np.uint32)
    exp = ((b >> 23) & 0xFF).astype(np.int64)
    mant = (b & 0x7FFFFF).astype(np.uint32)
    out = (sign << 15).astype(np.uint32)                          # zero / denormal / underflow
    special = exp == 0xFF
    out = np.where(special, (sign << 15) | 0x7C00 | np.where(mant != 0, 0x200, 0), out)
    new_exp = exp - 127 + 15
    normal = (exp != 0) & ~special
    over = normal & (new_exp >= 31)
    out = np.where(over, (sign << 15) | 0x7C00, out)
    fine = normal & (new_exp > 0) & (new_exp < 31)
    out = np.where(fine, (sign << 15) | (np.clip(new_exp, 0, 31).astype(np.uint32) << 10) | (mant >> 13), out)
    return out.astype(np.uint16)


def from_half_bits_np(h: np.ndarray) -> np.ndarray:
    return np.asarray(h, dtype=np.uint16).view(np.float16).astype(np.float32)


def sanitize_half_np(h: np.ndarray) -> tuple[np.ndarray, int, int]:
    """NaN/Inf -> +0 bits; |x| > 50 -> clamp (re-encoded by truncation)."""
    f = from_half_bits_np(h)
    bad = ~np.isfinite(f)
    big = np.isfinite(f) & (np.abs(f) > HALF_CLAMP)
    out = np.asarray(h, dtype=np.uint16).copy()
    out[bad] = to_half_bits_np(np.zeros(int(bad.sum()), dtype=np.float32))
    out[big] = to_half_bits_np(np.clip(f[big], -HALF_CLAMP, HALF_CLAMP))
    return out, int(bad.sum()), int(big.sum())


def _map_arrays(s: pd.Series, fn) -> pd.Series:
    return pd.Series([None if v is None else fn(np.asarray(v)) for v in s])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def to_half_bits(v: pd.Series) -> pd.Series:
    """N8 column function: array<float> -> array<int> (uint16 bits)."""
    return _map_arrays(v, lambda a: to_half_bits_np(a.astype(np.float32)).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half_bits(v: pd.Series) -> pd.Series:
    """N9 column function: array<int> bits -> array<float>."""
    return _map_arrays(v, lambda a: from_half_bits_np(a.astype(np.uint16)))


SANITIZE_HALF_TYPE = T.StructType([
    T.StructField("bits", T.ArrayType(T.IntegerType())),
    T.StructField("invalid_count", T.IntegerType()),
    T.StructField("clamped_count", T.IntegerType())])


@F.pandas_udf(SANITIZE_HALF_TYPE)
def sanitize_half(v: pd.Series) -> pd.DataFrame:
    """N7 column function: array<int> bits -> struct(bits, invalid_count, clamped_count)."""
    rows = []
    for a in v:
        if a is None:
            rows.append((None, None, None))
            continue
        out, nb, nc = sanitize_half_np(np.asarray(a).astype(np.uint16))
        rows.append((out.astype(np.int32), nb, nc))
    return pd.DataFrame(rows, columns=["bits", "invalid_count", "clamped_count"])
