"""Column functions: distances, paces, durations, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Official distances in metres, by name (fixed values).
STANDARD_DISTANCES = {"5k": 5000.0, "10k": 10000.0, "half_marathon": 21097.5, "marathon": 42195.0}
RUNNING_KINDS = ("running", "trail_running", "treadmill_running")
RIEGEL_EXPONENT = 1.06


def is_running(kind: Column) -> Column:
    return kind.isin(*RUNNING_KINDS)


def half_up(x: Column, places: int, precision: int = 18) -> Column:
    """Round half up on the decimal form and keep a fixed scale; null stays null."""
    return F.round(x, places).cast(f"decimal({precision},{places})")


def seconds_to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a duration in seconds, half up."""
    return F.round(seconds.cast("decimal(20,6)") * 1000).cast("bigint")


def effective_ms(moving_ms: Column, elapsed_ms: Column) -> Column:
    return F.when(moving_ms > 0, moving_ms).otherwise(elapsed_ms)


def pace(duration_ms: Column, distance_m: Column) -> Column:
    """Seconds per kilometre; null without time or distance."""
    return F.when((duration_ms > 0) & (distance_m > 0), duration_ms / distance_m.cast("double"))


def local_date(ts: Column, zone: Column, fallback: Column, known_zones: Column) -> Column:
    """The calendar date in ``zone``, or in ``fallback`` where the zone is null or not a known one."""
    return F.to_date(F.from_utc_timestamp(ts, F.when(F.array_contains(known_zones, zone), zone).otherwise(fallback)))


def deviation_pct(distance_m: Column, official_m: float) -> Column:
    return F.abs(distance_m.cast("double") - official_m) / official_m * 100


def standard_distance(distance_m: Column, tolerance_pct: float = 3.0) -> Column:
    """The name of the nearest standard distance within the tolerance, else null; nearness is relative deviation."""
    pairs = [F.struct(deviation_pct(distance_m, m).alias("off"), F.lit(name).alias("name")) for name, m in STANDARD_DISTANCES.items()]
    best = F.least(*pairs)
    return F.when((distance_m > 0) & (best["off"] <= tolerance_pct), best["name"])


def official_metres(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STANDARD_DISTANCES.items() for x in pair])[name]


def riegel(seconds: Column, from_m: Column, to_m: Column) -> Column:
    """Predicted time over another distance."""
    return seconds * F.pow(to_m / from_m, F.lit(RIEGEL_EXPONENT))


def distance_band(distance_km: Column) -> Column:
    return F.when(distance_km < 5, "5k").when(distance_km < 10, "10k").when(distance_km < 21.0975, "half_marathon").otherwise("marathon")


def reliable_timing(moving: Column, elapsed: Column) -> Column:
    """Elapsed time is at least moving time and at most a tenth longer."""
    return (elapsed >= moving) & (elapsed <= moving * 1.10)


def strong_training(distance_km: Column, moving_s: Column, elapsed_s: Column) -> Column:
    return reliable_timing(moving_s, elapsed_s) & (distance_km >= 3.0) & (moving_s >= 720) & (moving_s / distance_km < 270.0)


def heart_rate_zone(bpm: Column, max_bpm: Column) -> Column:
    """1 to 5, by share of the maximum: below 60, 70, 80, 90 % and above."""
    ratio = bpm / max_bpm
    return F.when(ratio < 0.6, 1).when(ratio < 0.7, 2).when(ratio < 0.8, 3).when(ratio < 0.9, 4).when(ratio.isNotNull(), 5)


def clock(seconds: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from an hour on; null stays null."""
    s = F.round(seconds).cast("bigint")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(s.isNotNull(), F.when(s < 3600, short).otherwise(long))


def pace_display(seconds_per_km: Column) -> Column:
    """``M:SS /km`` with whole seconds, half to even; ``Unavailable`` for null."""
    s = F.bround(seconds_per_km).cast("bigint")
    return F.when(s.isNull(), "Unavailable").otherwise(F.format_string("%d:%02d /km", F.floor(s / 60), s % 60))


def duration_range(distance_km: Column, faster: Column, slower: Column) -> Column:
    """The planned time of a session from the faster to the slower pace (s/km), as clock times; null if anything is."""
    return F.concat(clock(distance_km * faster), F.lit("-"), clock(distance_km * slower))


def clock_to_ms(text: Column) -> Column:
    """Milliseconds of ``M:SS`` or ``H:MM:SS`` (seconds may have decimals); null where it is neither."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("decimal(12,3)")
    n = F.size(parts)
    minutes, seconds = F.when(n == 3, number(2)).when(n == 2, number(1)), F.when(n == 3, number(3)).when(n == 2, number(2))
    hours = F.when(n == 3, number(1)).when(n == 2, F.lit(0))
    good = (seconds >= 0) & (seconds < 60) & (minutes >= 0) & ((n == 2) | (minutes < 60)) & (hours >= 0)
    return F.when(good, ((hours * 3600 + minutes * 60 + seconds) * 1000).cast("bigint"))


def fingerprint(athlete: Column, provider: Column, start: Column, kind: Column, distance_m: Column, elapsed_ms: Column) -> Column:
    """SHA-256 over the identifying fields of one provider's record, pipe-joined; a null distance is empty."""
    fields = (athlete.cast("string"), provider, F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'"), kind, F.coalesce(distance_m.cast("decimal(12,3)").cast("string"), F.lit("")), elapsed_ms.cast("string"))
    return F.sha2(F.concat_ws("|", *fields), 256)


def review_token(dataset_version: Column, activity_id: Column) -> Column:
    """An identifier that does not tell the activity."""
    return F.sha2(F.concat_ws(":", dataset_version, activity_id.cast("string")), 256)


def week_start(day: Column) -> Column:
    """The Monday of a date's week."""
    return F.to_date(F.date_trunc("week", day))
