"""Cleaning and classification of scheduled-versus-actual records, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transport codes and the products and groups they are read into, times of day, limits in seconds.
PRODUCTS = {
    "BUS": ("CAR", "EV", "KB", "B", "EXB", "BN", "BP", "RUB"),
    "TRAM": ("T",),
    "METRO": ("M",),
    "SCHIFF": ("BAT", "FAE"),
    "ZAHNRADBAHN": ("GB", "PB", "SL", "ASC", "FUN", "CC"),
    "ZUG": ("ZUG", "TGV", "EST", "IC", "ICE", "RJX", "EC", "IR", "IRE", "ATZ", "ARZ", "NJ", "EN", "RB", "TER", "RE", "R", "PE", "S", "SN", "EXT"),
}
MODE_GROUPS = {
    "Train": ("ZUG", "IC", "ICE", "IR", "RE", "S", "SN", "R", "RB", "TGV", "EC", "IRE", "RJX", "NJ", "EN", "EST", "PE", "ATZ", "ARZ", "TER", "EXT"),
    "Bus": ("BUS", "CAR", "EV", "KB", "B", "EXB", "BN", "BP", "RUB"),
    "Tram": ("T", "TRAM"),
    "Metro": ("M", "METRO"),
    "Ship": ("BAT", "FAE", "SCHIFF"),
    "Other": ("GB", "PB", "SL", "ASC", "FUN", "CC"),
}
TIME_OF_DAY = (("early_morning", 4, 6), ("morning_rush", 6, 9), ("midday", 9, 16), ("evening_rush", 16, 19), ("evening", 19, 22), ("night", 22, 28))
TIGHTNESS = (("tight", 300), ("normal", 900))
DELAY_CLASSES = (("on_time", 60), ("minor", 300), ("moderate", 600))


def choose(pairs, default) -> Column:
    """CASE over (condition, value) pairs."""
    pairs = list(pairs)
    start = F.when(pairs[0][0], F.lit(pairs[0][1]))
    return reduce(lambda c, p: c.when(p[0], F.lit(p[1])), pairs[1:], start).otherwise(default)


def status(c: Column) -> Column:
    """Upper-case and trimmed; a blank status is a forecast."""
    return F.when(F.trim(c) == "", F.lit("PROGNOSE")).otherwise(F.upper(F.trim(c)))


def not_failed(c: Column) -> Column:
    """True unless the flag says so: null counts as not failed."""
    return (c == F.lit(False)) | c.isNull()


def present(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def product(transport: Column, product_id: Column) -> Column:
    """The product that a transport code stands for, else the record's own product."""
    code, own = F.upper(F.trim(transport)), F.upper(F.trim(product_id))
    code = F.when(code == "BUS", F.lit("B")).otherwise(code)
    return choose([(code.isin(*codes), name) for name, codes in PRODUCTS.items()], own)


def mode_group(transport: Column, groups: dict[str, tuple[str, ...]] = MODE_GROUPS) -> Column:
    """The group of a transport code; Unknown for any other."""
    code = F.upper(F.trim(transport))
    return choose([(code.isin(*codes), name) for name, codes in groups.items()], F.lit("Unknown"))


def delay_seconds(scheduled: Column, actual: Column) -> Column:
    return F.unix_timestamp(actual) - F.unix_timestamp(scheduled)


def label_minutes(delay: Column, low: float = 0.0, high: float = 60.0) -> Column:
    return F.least(F.greatest(delay, F.lit(low)), F.lit(high))


def severity(delay: Column) -> Column:
    capped = label_minutes(delay, 0.0, 120.0)
    return choose([(capped == 0, "NO DELAY"), (capped <= 3, "NORMAL DELAY")], F.lit("EXCESSIVE_DELAY"))


def time_of_day(hour: Column) -> Column:
    """By the hour of service, which may pass 24; hours before four count as night."""
    return choose([((hour >= a) & (hour < b), name) for name, a, b in TIME_OF_DAY], F.lit("night"))


def tightness(buffer_seconds: Column, transfers: Column) -> Column:
    return F.when(transfers == 0, F.lit("none")).otherwise(choose([(buffer_seconds < limit, name) for name, limit in TIGHTNESS], F.lit("comfortable")))


def delay_class(delay: Column) -> Column:
    return choose([(delay <= limit, name) for name, limit in DELAY_CLASSES], F.lit("severe"))


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def day_type(holiday: Column, bridge: Column, before: Column, after: Column) -> Column:
    return F.when(holiday == 1, 1).when((bridge == 1) | (before == 1) | (after == 1), 2).otherwise(0)


def stratum(*parts: Column) -> Column:
    return F.concat_ws("__", *[p.cast("string") for p in parts])


def line_label(short_name: Column, trip_name: Column, route_id: Column) -> Column:
    return F.coalesce(F.nullif(short_name, F.lit("")), trip_name, route_id)


def with_prefix(agency: Column, prefix: str = "85:") -> Column:
    return F.when(F.instr(agency, ":") == 0, F.concat(F.lit(prefix), agency)).otherwise(agency)


def stop_number(stop_id: Column) -> Column:
    """The number before a platform's suffix; null where it isn't a number."""
    head = F.split_part(stop_id, F.lit(":"), F.lit(1))
    return F.when(head.rlike("^[0-9]{1,9}$"), head.cast("int"))


def sound_edge(dep: Column, arr: Column, dep_stop: Column, arr_stop: Column) -> Column:
    """No missing or backward time, no loop, and not the mark of a clock that slipped a day: 24 to 30 hours."""
    took = arr - dep
    slipped = (took >= 86_400) & (took - 86_400 <= 21_600)
    return dep.isNotNull() & arr.isNotNull() & (arr >= dep) & (dep_stop != arr_stop) & ~slipped


def only_for(condition: Column, columns: list[str], suffix: str) -> dict[str, Column]:
    """Each column where the condition holds, else 0."""
    return {f"{c}{suffix}": F.when(condition, F.col(c)).otherwise(F.lit(0.0)) for c in columns}


def fill_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's mean over the table, 0 where it has none. One aggregation, whose single row is joined."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.join(means).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def ml_columns(df: DataFrame, categorical: list[str], numeric: list[str], label: str) -> DataFrame:
    fixed = {c: F.when(present(F.col(c).cast("string")), F.col(c).cast("string")).otherwise(F.lit("UNKNOWN")) for c in categorical}
    fixed |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    return df.withColumns(fixed | {label: F.col(label).cast("double")})
