"""Scalar and array functions as Column expressions (inventory 2.G)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JITTER = 0.002
NEAR = 1e-3
MASK24 = (1 << 24) - 1


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing."""
    n = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def peak_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(F.coalesce(F.array_max(F.transform(doubles(x), F.abs)), F.lit(0.0)), F.lit(1e-10)))


def rms_db(x: Column) -> Column:
    total = F.aggregate(doubles(x), F.lit(0.0), lambda s, v: s + v * v)
    return 20 * F.log10(F.greatest(F.when(F.size(x) > 0, F.sqrt(total / F.size(x))).otherwise(0.0), F.lit(1e-10)))


def zero_crossing(x: Column) -> Column:
    """Share of neighbours on different sides of zero."""
    n = F.size(x)
    crossed = F.aggregate(
        F.zip_with(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: ((a >= 0) != (b >= 0)).cast("int")),
        F.lit(0),
        lambda s, v: s + v,
    )
    return F.when(n < 2, F.lit(0.0)).otherwise(crossed / (n - 1))


def standardize(x: Column, mean: Column, std: Column, clip: float = 5.0) -> Column:
    """Z-score within +-clip; what is not finite is 0, infinities too."""
    z = (x - mean) / std
    return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def safe_std(std: Column) -> Column:
    return F.when(std <= 1e-6, F.lit(1.0)).otherwise(std)


def xorshift(state: Column) -> Column:
    """One step of the 64-bit generator (shifts 13, 7, 17)."""
    s = state.bitwiseXOR(F.shiftleft(state, 13))
    s = s.bitwiseXOR(F.shiftrightunsigned(s, 7))
    return s.bitwiseXOR(F.shiftleft(s, 17))


def unit(state: Column) -> Column:
    """The upper 24 bits of a state as a number from -1 to 1."""
    return F.shiftrightunsigned(state, 40) / F.lit(float(1 << 23)) - 1


def jitter(key: Column, extent: Column) -> tuple[Column, Column]:
    """Offsets in x and y that depend on the key only."""
    one = xorshift(key.cast("long").bitwiseOR(F.lit(1).cast("long")))
    two = xorshift(one)
    return unit(one) * extent * JITTER, unit(two) * extent * JITTER


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ramp(t: Column, stops: list[tuple[float, float, float]]) -> list[Column]:
    """Red, green and blue of a piecewise linear ramp at ``t`` from 0 to 1."""
    last = len(stops) - 1
    scaled = clamp01(t) * last
    index = F.least(F.lit(last - 1), F.floor(scaled)).cast("int")
    frac = scaled - index
    out = []
    for c in range(3):
        values = F.array(*(F.lit(float(s[c])) for s in stops))
        low, high = F.element_at(values, index + 1), F.element_at(values, index + 2)
        out.append(low + (high - low) * frac)
    return out


def eta_seconds(queued: Column, done: Column, elapsed: Column) -> Column:
    """Seconds that are left; null before anything is done or when all is."""
    return F.when((done > 0) & (queued > done), F.ceil((queued - done) * elapsed / done))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normal_ext(ext: Column) -> Column:
    return F.lower(F.ltrim(F.trim(ext), F.lit(".")))


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted list: no interpolation."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)
