"""Content-keyed identities and uniforms: the same answer for any partitioning or worker layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import iso_utc


def nul_joined(*parts) -> Column:
    return F.concat_ws("\0", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def sample_id(t0, lead_hours, signature) -> Column:
    """PR16: 24 hex digits over time, lead with one decimal, and signature."""
    text = F.concat_ws("|", iso_utc(t0), F.format_string("%.1f", lead_hours), signature)
    return F.substring(F.sha2(text, 256), 1, 24)


def event_id(start, end) -> Column:
    """PR17: identity of a merged event."""
    return F.concat(F.lit("event-"), F.substring(F.sha2(F.concat_ws("|", iso_utc(start), iso_utc(end)), 256), 1, 16))


def utc_day_block(t0, stratum) -> Column:
    return F.concat_ws(":", stratum, F.date_format(t0, "yyyy-MM-dd"))


def hash_uniform(seed: int, purpose: str, key) -> Column:
    """PR18: [0,1) from the top 53 bits of the first eight bytes, read little-endian."""
    h = F.sha2(nul_joined(seed, purpose, key), 256)

    def word(first_byte: int) -> Column:
        swapped = F.concat(*[F.substring(h, 2 * b + 1, 2) for b in range(first_byte + 3, first_byte - 1, -1)])
        return F.conv(swapped, 16, 10).cast("long")

    high, low = word(4), word(0)
    top53 = high * F.lit(1 << 21) + F.shiftright(low, 11)
    # never null; saying so keeps the planner from evaluating it once more in a null filter
    return F.coalesce(top53.cast("double") * F.lit(2.0 ** -53), F.lit(0.0))


def shuffle_key(seed: int, purpose: str, key) -> Column:
    """Sort key of the full-coverage shuffle (hex text sorts like the digest bytes)."""
    return F.sha2(nul_joined(seed, purpose, key), 256)
