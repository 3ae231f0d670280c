"""Condition signatures: canonical text, parsed fields, pooling keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
ACCESS_MODES = ("full_trajectory", "target_end_causal", "no_era_access")
NULL_SIGNATURE = "null_provider:era=0:tp=0:no_era_access"
PATTERN = r"^(.+):era=([01]):tp=([01]):(full_trajectory|target_end_causal|no_era_access)$"


def fields(sig: Column) -> dict[str, Column]:
    """PR14: provider, era, tp, access read from the right."""
    def part(i):
        return F.regexp_extract(sig, PATTERN, i)
    return {"provider": part(1), "era": part(2) == "1", "tp": part(3) == "1", "access": part(4)}


def canonical(sig: Column) -> Column:
    """Null when the text is not a signature; an absent provider is always the one null signature."""
    ok = sig.rlike(PATTERN)
    era = F.regexp_extract(sig, PATTERN, 2)
    closed = F.regexp_extract(sig, PATTERN, 4) == "no_era_access"
    return F.when(ok & (era == "0"), F.lit(NULL_SIGNATURE)).when(ok & ~closed, sig)


def is_canonical(sig: Column) -> Column:
    return F.coalesce(canonical(sig) == sig, F.lit(False))


def provider_era(sig: Column) -> Column:
    return F.concat(F.regexp_extract(sig, PATTERN, 1), F.lit(":era="), F.regexp_extract(sig, PATTERN, 2))


def provider(sig: Column) -> Column:
    return F.regexp_extract(sig, PATTERN, 1)
