"""Sensor value transforms on band arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed scene classes that are not usable.
INVALID_CLASSES = (0, 1, 2, 3, 8, 9)


def harmonised(bands: Column, acquired: Column | None = None, cutoff: str = "2022-01-25", offset: int = 1000) -> Column:
    """Takes the offset off values that have it (after the cutoff day; always without acquired); whole numbers in 0..65535."""
    shift = F.lit(True) if acquired is None else F.to_date(acquired) > F.to_date(F.lit(cutoff))

    def one(x: Column) -> Column:
        clean = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
        moved = F.when(shift & (clean >= offset), clean - offset).otherwise(clean)
        return F.least(F.greatest(moved, F.lit(0.0)), F.lit(65535.0)).cast("int")

    return F.transform(bands, one)


def amplitude_scaled(bands: Column) -> Column:
    """(20 log10(a) + 50) * 200 in 0..32767, truncated; 0 where a is not a positive number."""

    def one(a: Column) -> Column:
        db = (20 * F.log10(a) + 50) * 200
        ok = a.isNotNull() & ~F.isnan(a) & (a > 0) & (a < float("inf"))
        return F.when(ok, F.least(F.greatest(db, F.lit(0.0)), F.lit(32767.0))).otherwise(0.0).cast("int")

    return F.transform(bands, one)


def class_valid(scene_class: Column) -> Column:
    return ~scene_class.isin(*INVALID_CLASSES)


def any_nonzero(bands: Column) -> Column:
    return F.exists(bands, lambda x: x != 0)


def standardised(bands: Column, mean: list[float], std: list[float]) -> Column:
    """Per band (x - mean) / (std + 1e-9)."""
    stats = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(mean, std, strict=True)])
    return F.zip_with(bands, stats, lambda x, p: (x - p["m"]) / (p["s"] + 1e-9))


def ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Normalised difference; null where the sum is about zero."""
    return F.when(F.abs(a + b) > eps, (a - b) / (a + b))


def decibels(value: Column) -> Column:
    return value / 200.0 - 50.0
