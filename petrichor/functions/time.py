"""Timestamp arithmetic on TIMESTAMP_NTZ columns that hold UTC; independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE_ZONE = "Asia/Seoul"  # fixed value: archive keys are written in this zone
MICROS_PER_MINUTE = 60_000_000


def epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def micros(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch(), F.col(ts) if isinstance(ts, str) else ts)


def from_micros(us: Column) -> Column:
    # split in minutes and rest: the quantity argument of timestamp_add is an INT
    minutes = (us - F.pmod(us, F.lit(MICROS_PER_MINUTE))) / F.lit(MICROS_PER_MINUTE)
    rest = F.pmod(us, F.lit(MICROS_PER_MINUTE)).cast("int")
    return F.timestamp_add("MICROSECOND", rest, F.timestamp_add("MINUTE", minutes.cast("int"), epoch()))


def slot_index(ts, minutes: int = 5) -> Column:
    """Number of the fixed-width slot that holds ``ts`` (floor, never a rounding cast)."""
    us = micros(ts)
    width = F.lit(minutes * MICROS_PER_MINUTE)
    return F.call_function("div", us - F.pmod(us, width), width)


def slot_time(slot, minutes: int = 5) -> Column:
    c = F.col(slot) if isinstance(slot, str) else slot
    return F.timestamp_add("MINUTE", (c * minutes).cast("int"), epoch())


def add_minutes(ts, n) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    q = F.lit(int(n)) if isinstance(n, (int, float)) else n.cast("int")
    return F.timestamp_add("MINUTE", q, c)


def parse_slot_key(key, tz: str = ARCHIVE_ZONE) -> Column:
    """PR01: ``yyyyMMddHHmm`` in a local zone to UTC."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), F.to_timestamp_ntz(key, F.lit("yyyyMMddHHmm")))


def format_slot_key(ts, tz: str = ARCHIVE_ZONE) -> Column:
    """PR02: inverse of :func:`parse_slot_key`."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts), "yyyyMMddHHmm")


def is_slot(ts, minutes: int = 5) -> Column:
    """PR03: true on an exact slot edge."""
    return F.pmod(micros(ts), F.lit(minutes * MICROS_PER_MINUTE)) == 0


def history_slots(slot, n: int = 12) -> Column:
    """PR04: the n causal slots that end at the issue slot."""
    return F.sequence(slot - (n - 1), slot)


def target_slots(slot, lead_slots, n: int = 7) -> Column:
    """PR05: the n slots that end at issue + lead."""
    return F.sequence(slot + lead_slots - (n - 1), slot + lead_slots)


def dependency_slots(slot, history: int = 12, horizon: int = 72) -> Column:
    """PR06: every slot the item depends on."""
    return F.sequence(slot - (history - 1), slot + horizon)


def endpoint_slots(slot, lead_slots, history: int = 12, n: int = 7) -> Column:
    """PR07: history and target slots; a slot in both is named once."""
    return F.array_union(history_slots(slot, history), target_slots(slot, lead_slots, n))


def iso_utc(ts) -> Column:
    """ISO text with an explicit zero offset, as hashed by the identities."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def floor_hour(ts) -> Column:
    """Whole hour by slot arithmetic: date_trunc() would leave TIMESTAMP_NTZ and depend on the session zone."""
    return slot_time(slot_index(ts, 60), 60)


def ceil_hour(ts) -> Column:
    t = floor_hour(ts)
    return F.when(t == ts, t).otherwise(F.timestamp_add("HOUR", F.lit(1), t))


def native_hours(ts, n: int = 8) -> Column:
    """PR22: n whole hours from the hour of the issue time."""
    h = floor_hour(ts)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.timestamp_add("HOUR", i, h))


def trajectory_mask(hour, t0, horizon_minutes: int = 360) -> Column:
    """PR23: hours up to the rounded-up end of the horizon."""
    return hour <= ceil_hour(add_minutes(t0, horizon_minutes))


def access_mask(hour, t0, lead_minutes, mode: Column, horizon_minutes: int = 360) -> Column:
    """PR23: access under a mode: whole trajectory, causal to the target end, or none."""
    full = trajectory_mask(hour, t0, horizon_minutes)
    causal = full & (hour <= add_minutes(t0, lead_minutes))
    return F.when(mode == "full_trajectory", full).when(mode == "target_end_causal", causal).otherwise(F.lit(False))


def issue_causal_mask(valid_time, interval_end, t0) -> Column:
    """PR24: known at issue time."""
    return (valid_time <= t0) & (interval_end <= t0)


def verification_time(t0, lead_minutes) -> Column:
    """PR20: centre of the accumulation window."""
    return add_minutes(t0, lead_minutes - 15)


def solar_time(ts, longitude) -> Column:
    """Mean solar time: four minutes of time per degree, no equation of time."""
    return from_micros(micros(ts) + F.round(longitude * 240_000_000).cast("long"))


def day_fraction_hours(ts) -> Column:
    day = 86_400_000_000
    return F.pmod(micros(ts), F.lit(day)) / F.lit(3_600_000_000.0)


def annual_phase(ts) -> Column:
    """Part of the year gone, leap years included."""
    y = F.year(ts)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(leap, F.lit(366.0)).otherwise(F.lit(365.0))
    return (F.dayofyear(ts) - 1 + day_fraction_hours(ts) / 24.0) / days


def solar_bin(hour) -> Column:
    """PR21: quarter of the solar day."""
    return F.floor(hour / 6.0).cast("int")


def season(ts) -> Column:
    m = F.month(ts)
    return (F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM")
            .when(m.isin(6, 7, 8), "JJA").otherwise("SON"))


def intensity_bin(v, edges=(0.1, 1.0, 5.0)) -> Column:
    """PR21: class number = how many thresholds are reached (inclusive)."""
    return sum(((v >= e).cast("int") for e in edges), F.lit(0))


def expand_mask(mask, n: int = 12) -> Column:
    """PR15: lead numbers (1-based) whose bit is set."""
    return F.filter(F.sequence(F.lit(1), F.lit(n)),
                    lambda i: F.call_function("shiftright", mask, i - 1).bitwiseAND(F.lit(1)) != 0)
