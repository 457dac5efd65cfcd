"""Distances on the earth's sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut

#: Mean radius of the earth in metres.
RADIUS = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def wkt(lat: Column, lon: Column) -> Column:
    return F.format_string("POINT (%s %s)", lon, lat)


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """The point as x, y and z on the unit sphere, where neither a pole nor the date line is special."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def cell(level: Column, xyz: list[Column], side: Column, shift: list[Column] | None = None) -> Column:
    """Number of the cube of that side in which a point lies; two cubes with one number would only add candidates."""
    return F.xxhash64(level, *((F.floor(c / side) + d).cast("long") for c, d in zip(xyz, shift or [F.lit(0)] * 3, strict=True)))


def nearest(points: DataFrame, places: DataFrame, point_id: str, place_id: str, *, most_broadcast: int = 2_000_000) -> DataFrame:
    """points' id with the nearest place (lat, lon) and its metres; ties, by the millimetre, to the smaller id.

    Space is cut into cubes, by levels, each of eight times the side of the one before. At a level, a point meets
    the places of its own cube and the 26 around it; the nearest of them is the nearest of all if it is within a
    side, since whatever is not among them is farther. Other points go on to the next level; the last level's cubes
    hold all places. Points are never paired with places that far away, and no number of either is too large.

    Places of one position count once, by their smallest id, and points of one position are measured once.
    Levels begin at half the mean spacing of the places. The lists of a level, 27 times the places, are broadcast
    up to most_broadcast of them and joined by cube beyond. A point without lat or lon has no nearest place, nor
    has any if there are no places; places without lat or lon are left out.
    """
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    held = cut(places.where(there).groupBy("lat", "lon").agg(F.min(place_id).alias("id")).select("id", "lat", "lon"))
    n = held.count()
    sides = [math.sqrt(4 * math.pi / max(1, n)) / 2]
    while sides[-1] < 2:
        sides.append(8 * sides[-1])
    xyz = on_sphere(F.col("lat"), F.col("lon"))
    around = held.select(F.struct("id", "lat", "lon").alias("_place"), *(c.alias(n) for c, n in zip(xyz, ("_x", "_y", "_z"), strict=True)))
    for axis in ("_a", "_b", "_c"):
        around = around.withColumn(axis, F.explode(F.array(*map(F.lit, (-1, 0, 1)))))

    def lists(level: int, side: float) -> DataFrame:
        own = cell(F.lit(level), [F.col(c) for c in ("_x", "_y", "_z")], F.lit(side), [F.col(c) for c in ("_a", "_b", "_c")])
        return around.select(own.alias("_cell"), "_place").groupBy("_cell").agg(F.collect_list("_place").alias("_places"))

    distance = lambda x: F.struct(F.round(haversine(F.col("lat"), F.col("lon"), x["lat"], x["lon"]), 3).alias("metres"), x["id"].alias("id"))
    out = points.where(there).select("lat", "lon").distinct().withColumn("_best", F.lit(None).cast(f"struct<metres: double, id: {held.schema['id'].dataType.simpleString()}>"))
    for k, side in enumerate(sides):
        within = 2 * RADIUS * math.asin(min(1.0, side / 2)) - 0.001
        some = lists(k, side)
        settled = F.xxhash64(F.lit(-1 - k), "lat", "lon")  # spread, where null would bring all of them to one task
        keyed = out.withColumn("_cell", F.when(F.col("_best").isNull(), cell(F.lit(k), xyz, F.lit(side))).otherwise(settled))
        met = keyed.join(F.broadcast(some) if 27 * n <= most_broadcast else some, "_cell", "left")
        best = F.array(F.array_min(F.transform("_places", distance)))  # measured once, then looked at
        if k < len(sides) - 1:
            best = F.filter(best, lambda b: b["metres"] < F.lit(within))  # noqa: B023  used at once
        best = F.get(best, F.lit(0))
        out = met.select("lat", "lon", F.coalesce("_best", best).alias("_best"))
    out = points.select(point_id, "lat", "lon").join(out, ["lat", "lon"], "left")
    return out.select(point_id, F.col("_best.id").alias(place_id), F.col("_best.metres").alias("metres"))
