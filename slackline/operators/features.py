"""Delay features: cleaned events, historical aggregates, weather and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slackline.functions import cleaning
from slackline.functions.clock import DAY
from slackline.functions.quantiles import LEVELS, exact_percentiles

# Key sets of the historical aggregates.
KEY_SETS = (("bpuic",), ("transport",), ("bpuic", "hour"), ("transport", "hour"), ("dow", "hour"), ("bpuic", "dow"), ("bpuic", "month"))


def level_names(prefix: str, levels: Sequence[float] = LEVELS) -> list[str]:
    return [f"{prefix}_p{round(q * 100):02d}" for q in levels]


def history(train: DataFrame, keys: Sequence[str], value: str, prefix: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """n, mean and percentiles of a value for each key."""
    found = train.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_n"), F.avg(value).alias(f"{prefix}_mean"), exact_percentiles(F.col(value), levels).alias("_p"))
    return found.select(*keys, f"{prefix}_n", f"{prefix}_mean", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(level_names(prefix, levels))])


def overall(train: DataFrame, value: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """One row: mean and percentiles of the whole training table."""
    found = train.agg(F.avg(value).alias("all_mean"), exact_percentiles(F.col(value), levels).alias("_p"))
    return found.select("all_mean", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(level_names("all", levels))])


def with_history(rows: DataFrame, train: DataFrame, value: str, key_sets: Sequence[Sequence[str]] = KEY_SETS, levels: Sequence[float] = LEVELS) -> DataFrame:
    """``rows`` with every key set's aggregates; where a key is new, the whole table's mean and percentiles and a count of 0.

    Each key set is one aggregation with partial sums and one left join on its key. The tables of
    aggregates have a row a key, so Spark broadcasts those whose size allows it.
    """
    result = rows.join(overall(train, value, levels))
    for keys in key_sets:
        prefix = "h_" + "_".join(keys)
        found = history(train, keys, value, prefix, levels)
        result = result.join(found, list(keys), "left")
        fill = {f"{prefix}_n": F.coalesce(F.col(f"{prefix}_n"), F.lit(0)), f"{prefix}_mean": F.coalesce(F.col(f"{prefix}_mean"), F.col("all_mean"))}
        fill |= {n: F.coalesce(F.col(n), F.col(a)) for n, a in zip(level_names(prefix, levels), level_names("all", levels), strict=True)}
        result = result.withColumns(fill)
    return result.drop("all_mean", *level_names("all", levels))


def clean_events(raw: DataFrame, start: str, end: str, operators: Sequence[str] = ()) -> DataFrame:
    """Raw records (source columns as text) to labelled delays of trips that ran and were observed."""
    rows = raw.filter(F.col("operating_day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    rows = rows.filter(cleaning.not_failed(F.col("failed"))).filter("arr_time is not null and arr_actual is not null and arr_status is not null")
    rows = rows.withColumn("arr_status", cleaning.status(F.col("arr_status"))).filter("arr_status <> 'UNBEKANNT'")
    if operators:
        rows = rows.filter(F.col("operator_id").isin(*operators))
    own = F.col("product_id") if "product_id" in rows.columns else F.col("transport")
    rows = rows.withColumn("product", cleaning.product(F.col("transport"), own))
    rows = rows.filter(cleaning.present(F.col("trip_id")) & cleaning.present(F.col("operator_id")) & cleaning.present(F.col("transport")) & cleaning.present(F.col("product")))
    minutes = cleaning.delay_seconds(F.col("arr_time"), F.col("arr_actual")) / 60.0
    rows = rows.withColumn("delay_min", minutes).withColumn("label_delay_min", cleaning.label_minutes(F.col("delay_min")))
    return rows.withColumns({"hour": F.hour("arr_time"), "day_of_week": F.dayofweek("arr_time"), "month": F.month("arr_time")})


def clean_stations(lines: DataFrame) -> DataFrame:
    """station, lat and lon from one column of comma-separated text; a header row among the data goes, as do rows without a place."""
    part = F.split("ws_name", ",")
    rows = lines.select(F.trim(F.get(part, F.lit(0))).alias("station"), F.get(part, F.lit(1)).try_cast("double").alias("lat"), F.get(part, F.lit(2)).try_cast("double").alias("lon"))
    return rows.filter("station <> '' and lower(station) <> 'station' and lat is not null and lon is not null")


def hourly_weather(history_rows: DataFrame, zone: str = "Europe/Zurich") -> DataFrame:
    """One observation a station and local hour: the earliest, by time and then by every value."""
    local = history_rows.withColumn("hour_start", F.date_trunc("hour", F.from_utc_timestamp("valid_time_gmt", zone)))
    values = F.struct("valid_time_gmt", "temp", "rh", "dewpt", "uv_index")
    first = local.groupBy("location_id", "hour_start").agg(F.min(values).alias("v"))
    return first.select(F.col("location_id").alias("station"), "hour_start", "v.temp", "v.rh", "v.dewpt", "v.uv_index")


def climatology(weather: DataFrame, columns: Sequence[str] = ("temp", "rh", "dewpt", "uv_index")) -> DataFrame:
    return weather.groupBy("station", F.month("hour_start").alias("month")).agg(*[F.avg(c).alias(c) for c in columns])


def with_weather(rows: DataFrame, station_of: DataFrame, weather: DataFrame, columns: Sequence[str], stop: str = "bpuic", time: str = "arr_time") -> DataFrame:
    """The weather of the stop's station in the event's hour; what is missing becomes the column's mean; values count for buses only."""
    placed = rows.join(station_of.select(F.col("stop").alias(stop), "station"), stop, "left").withColumn("hour_start", F.date_trunc("hour", time))
    filled = cleaning.fill_means(placed.join(weather.select("station", "hour_start", *columns), ["station", "hour_start"], "left"), list(columns))
    return filled.withColumns(cleaning.only_for(F.col("product") == "BUS", list(columns), "_bus"))


# --- calendars -----------------------------------------------------------------------------------

# Holidays on a fixed date (month, day), and days from Easter Sunday, for all cantons.
FIXED_HOLIDAYS = {"new_year": (1, 1), "second_january": (1, 2), "national_day": (8, 1), "christmas": (12, 25), "st_stephen": (12, 26)}
EASTER_HOLIDAYS = {"good_friday": -2, "easter_monday": 1, "ascension": 39, "whit_monday": 50}


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, from the golden number and the epact."""
    div = lambda a, b: F.floor(a / b)
    golden, century = F.pmod(year, F.lit(19)), div(year, 100)
    moon = F.pmod(19 * golden + century - div(century, 4) - div(8 * century + 13, 25) + 15, F.lit(30))
    moon = moon - div(moon, 28) * (1 - div(moon, 28) * div(F.lit(29), moon + 1) * div(21 - golden, 11))
    sunday = F.pmod(year + div(year, 4) + moon + 2 - century + div(century, 4), F.lit(7))
    offset = moon - sunday  # days from the 28th of March on
    return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(28)), offset.cast("int"))


def public_holidays(spark: SparkSession, first_year: int, last_year: int, cantons: Sequence[str]) -> DataFrame:
    """(canton, day, name) by rule."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    fixed = [F.struct(F.lit(n).alias("name"), F.make_date(F.col("y"), F.lit(m), F.lit(d)).alias("day")) for n, (m, d) in FIXED_HOLIDAYS.items()]
    moved = [F.struct(F.lit(n).alias("name"), F.date_add(easter(F.col("y")), d).alias("day")) for n, d in EASTER_HOLIDAYS.items()]
    days = years.select(F.inline(F.array(*fixed, *moved)))
    return days.withColumn("canton", F.explode(F.array(*[F.lit(c) for c in cantons]))).select("canton", "day", "name")


def holiday_flags(holidays: DataFrame) -> DataFrame:
    """(canton, day, holiday, before, after, bridge) of days on which a flag is set.

    A bridge is a Friday after a holiday on Thursday, or a Monday before one on Tuesday.
    """
    h = holidays.select("canton", "day").distinct()
    flag = lambda shift, name, cond=F.lit(True): h.filter(cond).select("canton", F.date_add("day", shift).alias("day"), F.lit(name).alias("flag"))
    found = flag(0, "holiday").union(flag(-1, "before")).union(flag(1, "after"))
    found = found.union(flag(1, "bridge", F.dayofweek("day") == 5)).union(flag(-1, "bridge", F.dayofweek("day") == 3))
    return found.groupBy("canton", "day").agg(*[F.max((F.col("flag") == n).cast("int")).alias(n) for n in ("holiday", "before", "after", "bridge")])


def period_flags(periods: DataFrame, kinds: Sequence[str] = ("public_holiday", "school_holiday")) -> DataFrame:
    """Periods (start_date, end_date, kind) to a row a day with a 0/1 column a kind and the flags around public holidays."""
    days = periods.select(F.explode(F.sequence("start_date", "end_date")).alias("day"), "kind")
    wide = days.groupBy("day").pivot("kind", list(kinds)).count().na.fill(0)
    wide = wide.select("day", *[(F.col(k) > 0).cast("int").alias(k) for k in kinds])
    public = days.filter(F.col("kind") == kinds[0]).select("day").distinct()
    before, after = (public.select(F.date_add("day", s).alias("day"), F.lit(1).alias(n)).distinct() for s, n in ((-1, "before"), (1, "after")))
    friday = public.filter(F.dayofweek("day") == 5).select(F.date_add("day", 1).alias("day"))
    monday = public.filter(F.dayofweek("day") == 3).select(F.date_sub("day", 1).alias("day"))
    bridge = friday.unionByName(monday).distinct().withColumn("bridge", F.lit(1))
    merged = wide.join(before, "day", "full").join(after, "day", "full").join(bridge, "day", "full")
    return merged.na.fill(0)


def with_calendar(rows: DataFrame, flags: DataFrame, canton: str, day: str) -> DataFrame:
    """Flags of the row's canton and day, 0 where none is set, and the day's type."""
    names = ("holiday", "before", "after", "bridge")
    f = flags.select(F.col("canton").alias("_canton"), F.col("day").alias("_day"), *names)
    joined = rows.join(f, (F.col(canton) == F.col("_canton")) & (F.col(day) == F.col("_day")), "left").drop("_canton", "_day").na.fill(0, list(names))
    return joined.withColumn("day_type", cleaning.day_type(*[F.col(c) for c in ("holiday", "bridge", "before", "after")]))


def flags_of(queries: DataFrame, flags: DataFrame, known: Sequence[str], default: str = "ZH") -> DataFrame:
    """Single days' flags: an unknown canton counts as the default one."""
    canton = F.when(F.col("canton").isin(*known), F.col("canton")).otherwise(F.lit(default))
    return with_calendar(queries.withColumn("used", canton), flags, "used", "day")


# --- matching timetable and observations ------------------------------------------------------------


def align_trips(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """(planned trip, day, observed trip) whose every planned stop is met by an observed one.

    planned: trip_id, stop, agency, arr, dep (clock text, null at the ends). observed: the same with
    day and obs_trip. Stops match on stop and agency, and on both clocks, where null equals null.
    """
    o = observed.select(F.col("obs_trip"), "day", F.col("stop").alias("_stop"), F.col("agency").alias("_agency"), F.col("arr").alias("_arr"), F.col("dep").alias("_dep"))
    same = (F.col("stop") == F.col("_stop")) & (F.col("agency") == F.col("_agency")) & F.col("arr").eqNullSafe(F.col("_arr")) & F.col("dep").eqNullSafe(F.col("_dep"))
    met = planned.join(o, same).groupBy("trip_id", "day", "obs_trip").agg(F.count_distinct("stop").alias("met"))
    size = planned.groupBy("trip_id").agg(F.count_distinct("stop").alias("size"))
    return met.join(size, "trip_id").filter("met = size").select("trip_id", "day", "obs_trip")


def match_trips(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """(obs_trip, trip_id) of observed trips and the planned trips they run: clocks meet, then the first met stop's day is one of
    the plan's days, then every stop of the observed trip that any such plan meets is met by this one.

    planned: trip_id, stop, agency, stop_sequence, arr, dep (seconds since midnight, which may pass 24 hours), runs (array of booleans,
    Monday first). observed: obs_trip, stop, agency, arr, dep, weekday (0 is Monday); a null clock meets any. Stops meet by equality on
    one known clock, so that no join goes by stop alone but for stops without any clock.
    """
    at = lambda c: F.col(c) % DAY
    p = planned.select("trip_id", "stop", "agency", "stop_sequence", at("arr").alias("_arr"), at("dep").alias("_dep"), "runs")
    o = observed.select("obs_trip", F.col("stop").alias("_stop"), F.col("agency").alias("_agency"), at("arr").alias("_a"), at("dep").alias("_d"), "weekday")
    place = (F.col("_stop") == F.col("stop")) & (F.col("_agency") == F.col("agency"))
    parts = [("_d is not null", F.col("_dep") == F.col("_d")), ("_d is null and _a is not null", F.col("_arr") == F.col("_a")), ("_d is null and _a is null", F.lit(True))]
    met = None
    for which, same in parts:
        joined = o.filter(which).join(p, place & same).filter("_a is null or _a = _arr")
        rows = joined.select("obs_trip", "trip_id", "stop", "stop_sequence", F.coalesce(F.get("runs", "weekday"), F.lit(False)).alias("runs_then"))
        met = rows if met is None else met.unionByName(rows)
    first = F.min(F.struct("stop_sequence", (~F.col("runs_then")).alias("idle")))
    pairs = met.groupBy("obs_trip", "trip_id").agg(first.alias("first"), F.collect_set("stop").alias("stops")).filter("not first.idle")
    all_met = pairs.select("obs_trip", F.explode("stops").alias("stop")).groupBy("obs_trip").agg(F.count_distinct("stop").alias("n"))
    return pairs.join(all_met, "obs_trip").filter(F.size("stops") == F.col("n")).select("obs_trip", "trip_id")


def sliding_percentile(rows: DataFrame, key: str, time: str, value: str, q: float, hours_back: int) -> DataFrame:
    """(hour_start, key, p): the percentile over the current hour and ``hours_back`` before it, one row a key and hour."""
    hourly = rows.withColumn("hour_start", F.date_trunc("hour", time)).withColumn("_h", F.unix_timestamp("hour_start"))
    w = Window.partitionBy(key).orderBy("_h").rangeBetween(-3600 * hours_back, 0)
    return hourly.withColumn("p", F.percentile_approx(value, F.lit(q), F.lit(1_000_000)).over(w)).groupBy("hour_start", key).agg(F.max("p").alias("p"))


def worst_of_hour(rows: DataFrame, value: str, first: int = 5) -> DataFrame:
    """The ``first`` ranks of each hour, ties kept."""
    w = Window.partitionBy("hour_start").orderBy(F.desc(value))
    return rows.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= first)
