"""Time of uniformly sampled clips: durations, keyframes to interpolate and rounding, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num_samples(duration, rate) -> Column:
    """0 for no duration, 1 for an infinite one, else the rounded count with both ends."""
    d, r = _c(duration), _c(rate)
    return F.when(d == 0, 0).when(d == INFINITY, 1).otherwise((F.floor(d * r + 0.5) + 1).cast("int")).cast("int")


def duration(n, rate, wraps=False) -> Column:
    """Infinite for one sample; a wrapping clip repeats its first sample at its end."""
    n = _c(n) + F.when(_c(wraps) & (_c(n) > 0), 1).otherwise(0)
    return F.when(n == 0, 0.0).when(n == 1, INFINITY).otherwise((n - 1) / _c(rate))


def finite_duration(n, rate, wraps=False) -> Column:
    n = _c(n) + F.when(_c(wraps) & (_c(n) > 0), 1).otherwise(0)
    return F.when(n <= 1, 0.0).otherwise((n - 1) / _c(rate))


def rate_of(n, duration_, wraps=False) -> Column:
    """The rate that a duration implies; 0 for none."""
    d = _c(duration_)
    return F.when(d == 0, 0.0).otherwise(F.when(_c(wraps), _c(n)).otherwise(_c(n) - 1) / F.when(d == 0, 1.0).otherwise(d))


def apply_rounding(alpha, policy) -> Column:
    """Rounding acts on the interpolation alone; ``per_track`` leaves it to the track."""
    a, p = _c(alpha), _c(policy)
    return F.when(p == "floor", 0.0).when(p == "ceil", 1.0).when(p == "nearest", F.floor(a + 0.5).cast("double")).otherwise(a)


def keyframes(n, rate, time, policy="none", wraps=False) -> Column:
    """struct(key0, key1, alpha) for a time within the clip."""
    n, at, w = _c(n), _c(time) * _c(rate), _c(wraps)
    key = F.floor(at).cast("int")
    last = n - 1
    past = w & (key > last)
    key0 = F.when(past, 0).otherwise(F.least(key, last))
    key1 = F.when(past, 0).when(w & (key0 + 1 > last), 0).otherwise(F.least(key0 + 1, last))
    alpha = F.when(past, 0.0).otherwise(at - key0)
    # at the end of a clamped clip both keys are the last and nothing is left to interpolate
    alpha = F.when(~w & (key0 == key1), 0.0).otherwise(alpha)
    return F.struct(key0.cast("int").alias("key0"), key1.cast("int").alias("key1"), apply_rounding(alpha, policy).alias("alpha"))


def alpha_between(index, key0, key1, policy="none") -> Column:
    """Where ``index`` lies between any two keyframes; floor and ceil come before equality of the keys."""
    i, a, b, p = _c(index), _c(key0), _c(key1), _c(policy)
    plain = F.when(a == b, 0.0).when(a < b, (i - a) / F.when(a < b, b - a).otherwise(1)).otherwise(i - a)
    return F.when(p == "floor", 0.0).when(p == "ceil", 1.0).when(p == "nearest", F.floor(plain + 0.5).cast("double")).otherwise(plain)


def nearest_key(n, rate, time) -> Column:
    """The closest keyframe, without interpolation."""
    return F.least(F.floor(_c(time) * _c(rate) + 0.5).cast("int"), _c(n) - 1)


def sample_time(index, n, rate, wraps=False) -> Column:
    """When a keyframe is measured: never after the end."""
    return F.least(_c(index) / _c(rate), finite_duration(n, rate, wraps))


def lerp(start, end, alpha) -> Column:
    a = _c(alpha)
    return (_c(start) - a * _c(start)) + a * _c(end)


def segment_sizes(n, ideal: int = 16, most: int = 31) -> Column:
    """Samples of each segment, as an array; empty for no samples.

    The closed form holds for the default sizes: at most 31 samples stay whole, 32 are halved,
    more are spread over one segment less than the rounded-up count.
    """
    if (ideal, most) != (16, 31):
        raise ValueError("segments of other sizes are not supported")
    n = _c(n)
    k = F.when(n <= most, 1).when(n == 32, 2).otherwise(F.ceil(n / ideal) - 1).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.floor(n / k) + F.when(i < n % k, 1).otherwise(0)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(sizes)
