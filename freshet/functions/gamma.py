"""Gamma-distribution functions that Spark SQL lacks.

Each is an Arrow-batched UDF over numpy arrays. Shapes and quantiles are computed on summary rows (one per
series and month); only the cumulative probability runs on data rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

_SHIFT = 10.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: recurrence up to x >= 10, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    y = np.where(x < _SHIFT, x + _SHIFT, x)
    shifted = np.zeros_like(y)
    for i in range(int(_SHIFT)):
        shifted += np.where(x < _SHIFT, np.log(x + i), 0.0)
    r = 1.0 / (y * y)
    tail = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - shifted


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    y = x + _SHIFT
    r = 1.0 / (y * y)
    out = np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for i in range(int(_SHIFT)):
        out -= 1.0 / (x + i)
    return out


def lower_gamma(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(shape, x): power series below shape + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(shape, dtype=float), np.asarray(x, dtype=float))
    out = np.where(np.isnan(a) | np.isnan(x), np.nan, np.where(x <= 0, 0.0, np.nan))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - log_gamma(a))
        live = (x > 0) & (a > 0)
        low = live & (x < a + 1)
        if low.any():
            al, xl = a[low], x[low]
            term = 1.0 / al
            total = term.copy()
            step = al.copy()
            while True:
                step = step + 1
                term = term * xl / step
                total = total + term
                if np.all(term <= total * 1e-16):
                    break
            out = out.copy()
            out[low] = front[low] * total
        high = live & ~low
        if high.any():
            ah, xh = a[high], x[high]
            tiny = 1e-300
            b = xh + 1 - ah
            c = np.full_like(b, 1 / tiny)
            d = 1 / b
            h = d.copy()
            i = 0
            while True:
                i += 1
                an = -i * (i - ah)
                b = b + 2
                d = an * d + b
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = b + an / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                delta = d * c
                h = h * delta
                if np.all(np.abs(delta - 1) < 1e-15) or i > 100_000:
                    break
            h = np.where(np.abs(delta - 1) < 1e-12, h, np.nan)  # no value rather than one that has not settled
            out = out.copy()
            out[high] = 1 - front[high] * h
    return out


def shape_from_moments_of_log(gap: np.ndarray) -> np.ndarray:
    """Maximum-likelihood shape k solving ln k - digamma(k) = gap, where gap = ln(mean) - mean(ln)."""
    gap = np.asarray(gap, dtype=float)
    with np.errstate(all="ignore"):
        k = (3 - gap + np.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
        for _ in range(60):
            step = 1e-5 * k
            value = np.log(k) - digamma(k) - gap
            slope = (np.log(k + step) - digamma(k + step) - np.log(k - step) + digamma(k - step)) / (2 * step)
            k = np.maximum(k - value / slope, k / 2)
        return np.where(gap > 0, k, np.nan)


def quantile(shape: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inverse of P(shape, .): Newton steps from the cube-root normal approximation, kept inside a shrinking bracket."""
    a, p = np.broadcast_arrays(np.asarray(shape, dtype=float), np.asarray(p, dtype=float))
    valid = (a > 0) & (p >= 0) & (p < 1)
    a, p = np.where(valid, a, 1.0), np.where(valid, p, 0.5)
    low, high = np.zeros_like(a), a + 1
    while True:
        short = lower_gamma(a, high) < p
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    with np.errstate(all="ignore"):
        x = a * (1 - 1 / (9 * a) + _normal_quantile(p) / (3 * np.sqrt(a))) ** 3
        x = np.where((x > low) & (x < high), x, 0.5 * (low + high))
        log_norm = log_gamma(a)
        for _ in range(200):
            gap = lower_gamma(a, x) - p
            low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
            step = gap / np.exp((a - 1) * np.log(x) - x - log_norm)
            new = x - step
            new = np.where((new > low) & (new < high), new, 0.5 * (low + high))
            done = np.abs(new - x) <= 1e-14 * x
            x = new
            if done.all():
                break
        x = np.where(np.abs(step) <= 1e-9 * x, x, np.nan)
    return np.where(valid, np.where(p == 0, 0.0, x), np.nan)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Rough inverse of the normal law; it only has to start the search for a gamma quantile."""
    tail = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(np.maximum(tail, 1e-300)))
    z = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
    return np.where(p < 0.5, -z, z)


# NaN in a returned series reaches Spark as null.
@F.pandas_udf(DoubleType())
def _log_gamma_udf(x: pd.Series) -> pd.Series:
    return pd.Series(log_gamma(x.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def _ml_shape_udf(gap: pd.Series) -> pd.Series:
    return pd.Series(shape_from_moments_of_log(gap.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def _cdf_udf(shape: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(lower_gamma(shape.to_numpy(dtype=float), x.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def _quantile_udf(shape: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(quantile(shape.to_numpy(dtype=float), p.to_numpy(dtype=float)))


def gamma_log(x: Column) -> Column:
    return _log_gamma_udf(x)


def gamma_ml_shape(mean: Column, mean_of_log: Column) -> Column:
    return _ml_shape_udf(F.log(mean) - mean_of_log)


def gamma_cdf(x: Column, shape: Column, loc: Column, scale: Column) -> Column:
    return _cdf_udf(shape, F.try_divide(x - loc, scale))


def gamma_quantile(p: Column, shape: Column, loc: Column, scale: Column) -> Column:
    return loc + scale * _quantile_udf(shape, p)


def gamma_density(x: Column, shape: Column, loc: Column, scale: Column, log_gamma_of_shape: Column) -> Column:
    """Density in built-in functions; ln gamma(shape) is computed once per fit and passed in."""
    z = F.try_divide(x - loc, scale)
    log_density = (shape - 1) * F.ln(z) - z - log_gamma_of_shape - F.ln(scale)
    return F.when(z > 0, F.exp(log_density)).when(z.isNotNull(), F.lit(0.0))
