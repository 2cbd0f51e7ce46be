"""Days, windows and timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def epoch_day(ts) -> Column:
    return F.unix_date(F.to_date(ts))


def iso_instant(text, year: Column | None = None) -> tuple[Column, Column]:
    """(timestamp, reason): naive, malformed or out-of-year texts give null and why."""
    c = F.col(text) if isinstance(text, str) else text
    ts = F.when(c.rlike(_ISO), F.try_to_timestamp(c))
    reason = F.when(c.isNull(), "missing").when(~c.rlike(_ISO), "no_zone_or_malformed").when(ts.isNull(), "malformed")
    if year is not None:
        reason = reason.when(F.year(ts) != year, "other_year")
    return F.when(reason.isNull(), ts), reason


def duration_days(start, end) -> Column:
    return F.col(end) - F.col(start)


def in_contract(start, end, most: int = 366) -> Column:
    d = duration_days(start, end)
    return (d > 0) & (d <= most)


def relative_day(day, start, mask) -> Column:
    """Days since the window's start where mask holds, else 0."""
    return F.when(F.col(mask), F.col(day) - F.col(start)).otherwise(F.lit(0))


def context_features(days: Column, n_a: Column, n_b: Column, most_days: int = 366, most_obs: int = 64) -> list[Column]:
    """log1p of duration and counts, scaled to their largest, with flags of empty sources."""
    scale = lambda x, most: F.log1p(x.cast("double")) / F.log1p(F.lit(float(most)))
    return [
        scale(days, most_days).alias("duration_feature"), scale(n_a, most_obs).alias("a_feature"), scale(n_b, most_obs).alias("b_feature"),
        (n_a == 0).cast("int").alias("a_empty"), (n_b == 0).cast("int").alias("b_empty"),
    ]


def evidence_weight(days: Column, n_a: Column, n_b: Column) -> Column:
    """Full weight from 90 days and 10 observations of one source on."""
    return F.least(F.lit(1.0), days / 90.0) * F.least(F.lit(1.0), F.greatest(n_a, n_b) / 10.0)
