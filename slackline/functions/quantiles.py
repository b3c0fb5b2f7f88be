"""Delay distributions as seven quantiles, and probabilities read from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The levels that distributions are stored at.
LEVELS = (0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.95)
DEFAULT_Q = 0.75
UNKNOWN = 0.5


def levels_column() -> Column:
    return F.array(*[F.lit(x) for x in LEVELS])


def confidence(q: Column) -> Column:
    """A share between 0 and 1 from a share or a percentage; the default for null."""
    share = F.when(q > 1, q / 100.0).otherwise(q.cast("double"))
    return F.when(share.isNull(), F.lit(DEFAULT_Q)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def clean(quantiles: Column) -> Column:
    """As many numbers as there are levels, none below 0, in order; missing ones are 0."""
    padded = F.concat(F.slice(quantiles, 1, len(LEVELS)), F.array_repeat(F.lit(0.0), len(LEVELS)))
    sound = F.transform(F.slice(padded, 1, len(LEVELS)), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(x.cast("double"), F.lit(0.0))))
    return F.array_sort(sound)


def at_level(quantiles: Column, q: Column) -> Column:
    """The quantile of the lowest level that is q or more; the last one beyond all levels."""
    place = F.array_position(F.transform(levels_column(), lambda x: x >= q), True).cast("int")
    return F.when(place > 0, F.get(quantiles, place - 1)).otherwise(F.try_element_at(quantiles, F.lit(-1)))


def _line(x: Column, x0: Column, p0: Column, x1: Column, p1: Column) -> Column:
    return p0 + (x - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (p1 - p0)


def chance_within(quantiles: Column, headway: Column) -> Column:
    """P(delay <= headway) as the scan sees it: linear between quantiles and from 0 to the first, 1 beyond the last."""
    n = len(LEVELS)
    get = lambda k: F.get(quantiles, F.lit(k))
    chance = F.lit(1.0)
    for k in range(n - 1, 0, -1):
        between = F.coalesce(_line(headway, get(k - 1), F.lit(LEVELS[k - 1]), get(k), F.lit(LEVELS[k])), F.lit(LEVELS[k]))
        chance = F.when(headway <= get(k), between).otherwise(chance)
    first = F.when(get(0) > 0, F.lit(LEVELS[0]) * headway / F.nullif(get(0), F.lit(0.0))).otherwise(F.lit(0.0))
    return F.when(headway <= get(0), first).otherwise(chance)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: a column expression that is used several times would be copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def points(quantiles: Column) -> Column:
    """(x, p) of a distribution for chance_from(): quantiles below 0 count as 0, missing ones go with their level,
    and equal quantiles count with their highest level. Null without any."""
    pairs = F.filter(F.arrays_zip(quantiles.alias("x"), levels_column().alias("p")), lambda v: v["x"].isNotNull() & ~F.isnan(v["x"]) & v["p"].isNotNull())

    def ordered(s):
        return F.zip_with(F.array_sort(F.transform(s, lambda v: F.greatest(v["x"].cast("double"), F.lit(0.0)))), F.transform(s, lambda v: v["p"]), lambda x, p: F.struct(x.alias("x"), p.alias("p")))

    once = let(let(pairs, ordered), lambda z: F.filter(z, lambda v, i: F.coalesce(F.get(z, i + 1)["x"] != v["x"], F.lit(True))))
    return F.when(F.size(once) > 0, once)


def chance_from(known: Column, headway: Column) -> Column:
    """P(delay <= headway) from points(): 0 for a negative headway, 0.5 without points; straight between points and
    from 0 to the first one, and the last slope goes on beyond the last one."""

    def read(s):
        k, first, last = s["k"], F.get(s["pts"], F.lit(0)), F.try_element_at(s["pts"], F.lit(-1))
        before, left, right, h = F.get(s["pts"], F.size(s["pts"]) - 2), F.get(s["pts"], s["k"] - 1), F.get(s["pts"], s["k"]), s["h"]
        beyond = F.when(F.size(s["pts"]) > 1, last["p"] + (last["p"] - before["p"]) / (last["x"] - before["x"]) * (h - last["x"])).otherwise(F.lit(1.0))
        inner = F.when(h <= first["x"], F.when(first["x"] == 0, first["p"]).otherwise(h / first["x"] * first["p"]))
        inner = inner.when(k >= F.size(s["pts"]), beyond).otherwise(left["p"] + (h - left["x"]) / (right["x"] - left["x"]) * (right["p"] - left["p"]))
        return F.when(h < 0, F.lit(0.0)).when(s["pts"].isNull(), F.lit(UNKNOWN)).otherwise(F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0)))

    def count(s):
        k = F.aggregate(s["pts"], F.lit(0), lambda n, pt: n + F.when(pt["x"] <= s["h"], F.lit(1)).otherwise(F.lit(0)))
        return F.struct(s["pts"].alias("pts"), s["h"].alias("h"), k.alias("k"))

    return let(let(F.struct(known.alias("pts"), headway.cast("double").alias("h")), count), read)


def chance_extrapolated(quantiles: Column, headway: Column) -> Column:
    """P(delay <= headway) as routes are judged."""
    return chance_from(points(quantiles), headway)


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.when(y >= p, q * (y - p)).otherwise((1 - q) * (p - y))


def exact_percentiles(c: Column, levels=LEVELS) -> Column:
    """Values of the group at the levels, as percentile_disc picks them, in one pass with partial aggregation."""
    return F.percentile_approx(c, [float(x) for x in levels], 1_000_000)
