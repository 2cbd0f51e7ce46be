"""Deterministic ids, ranks and draws from SHA-256, the same after any repartitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts, length: int = 24) -> Column:
    """First hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def hash_rank(*parts) -> Column:
    """Unsigned 64-bit rank as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def unit_interval(*parts) -> Column:
    """Draw in [0, 1)."""
    return hash_rank(*parts).cast("double") / F.lit(float(2**64))


def canonical_json(**fields) -> Column:
    """JSON with sorted keys and no spaces, for hashing; null fields are left out."""
    return F.to_json(F.struct(*[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in sorted(fields.items())]))


def fingerprint(*parts, length: int = 64) -> Column:
    """Order-independent aggregate: the digest of the sorted digests of a group's rows."""
    own = F.sha2(F.concat_ws(":", *parts), 256)
    return F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(own)), ","), 256), 1, length)
