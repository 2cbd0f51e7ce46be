"""Text, label and count helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_size(n: Column) -> Column:
    """Next multiple of 8 in 8..256."""
    return F.greatest(F.lit(8), F.least(F.lit(256), F.ceil(n / 8) * 8)).cast("int")


def mixture_targets(label: Column, part: str, sep: str = "/") -> list[Column]:
    """Whether a label names a mixture, and whether it contains a part."""
    return [label.contains(sep).cast("int").alias("is_mixture"), F.array_contains(F.split(label, sep), part).cast("int").alias("has_part")]


def count_bin(n: Column) -> Column:
    """1, 2, 3-4, 5-8, ... 33-64, 65+."""
    out = F.when(n <= 1, "1").when(n == 2, "2")
    low = 3
    while low < 65:
        out = out.when(n <= 2 * (low - 1), f"{low}-{2 * (low - 1)}")
        low = 2 * (low - 1) + 1
    return out.otherwise("65+")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def without_queries(text: Column, most: int = 500) -> Column:
    """Urls lose what follows a question mark; the text is cut to a length."""
    return F.substring(F.regexp_replace(text, r"(https?://[^\s?]+)\?\S*", "$1?redacted"), 1, most)


def clean_text(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def share(a: Column, b: Column, eps: float = 1e-12, empty: float | None = 0.5) -> Column:
    """a / (a + b), or empty where there is about no mass."""
    return F.when(a + b > eps, a / (a + b)).otherwise(F.lit(empty).cast("double"))
