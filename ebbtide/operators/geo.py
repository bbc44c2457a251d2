"""Places: planar metres, nearest points, points in polygons, clusters of near records.

``project`` is a local equirectangular projection about a reference point; its
error stays under 0.1 % within 50 km of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide import config
from ebbtide.operators.graph import connected_components
from ebbtide.plans.scratch import materialize

LAT0, LNG0, M_PER_LAT, M_PER_LNG = 42.35, -71.075, 111082.0, 82400.0
#: Up to this many points are broadcast for a nearest search; more are met by grid cells.
BROADCAST_POINTS = 5_000
_ROUNDS = 16


def project(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Metres east and north of the reference point."""
    return (lng - LNG0) * M_PER_LNG, (lat - LAT0) * M_PER_LAT


def located(df: DataFrame) -> DataFrame:
    """Add planar x and y; missing and (0, 0) coordinates have none."""
    known = (F.col("lat") != 0) & (F.col("lng") != 0)
    x, y = project(F.col("lat"), F.col("lng"))
    return df.withColumns({"x": F.when(known, x), "y": F.when(known, y)})


def zone_of(distance: Column) -> Column:
    return F.when(distance.isNull(), "unknown").when(distance <= config.CAMPUS_M, "campus").when(distance <= config.NEAR_M, "near").otherwise("away")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def nearest(points: DataFrame, key: str, targets: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """(key, columns of the nearest target, distance_m in whole metres); ties go by ``order``.

    Few targets are broadcast.  Many are met through grid cells: a point is
    settled when its nearest target in the neighbouring cells is no further
    than a cell; cells double until all points are settled.
    """
    target = targets.select(*columns, F.col("x").alias("__tx"), F.col("y").alias("__ty"), F.struct(*order).alias("__order"))
    todo = points.filter("x is not null and y is not null").select(key, "x", "y")
    far = distance(F.col("x"), F.col("y"), F.col("__tx"), F.col("__ty"))

    def best(pairs: DataFrame) -> DataFrame:
        measured = pairs.withColumn("__exact", far).withColumn("distance_m", F.round("__exact"))
        return measured.groupBy(key).agg(
            F.min("__exact").alias("__exact"), F.min_by(F.struct(*columns, "distance_m"), F.struct("distance_m", "__order")).alias("__best")
        )

    if targets.count() <= BROADCAST_POINTS:
        return best(todo.crossJoin(F.broadcast(target))).select(key, "__best.*")
    target, todo, size, found = materialize(target, "targets"), materialize(todo, "points"), float(config.NEAR_M), None
    for _ in range(_ROUNDS):
        cell = [F.floor(F.col("x") / size).alias("__cx"), F.floor(F.col("y") / size).alias("__cy")]
        around = F.array(*(F.struct((F.floor(F.col("__tx") / size) + i).alias("__cx"), (F.floor(F.col("__ty") / size) + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        spread = target.select("*", F.explode(around).alias("__c")).select("*", "__c.*").drop("__c")
        settled = materialize(best(todo.select("*", *cell).join(spread, ["__cx", "__cy"])).filter(F.col("__exact") <= size).select(key, "__best"), "nearest")
        found = settled if found is None else found.unionByName(settled)
        todo = todo.join(settled, key, "left_anti")
        size *= 2
        if todo.isEmpty():
            return found.select(key, "__best.*")
    raise ValueError(f"points further than {size / 2:.0f} m from every target; are all coordinates in one projection?")


def nearest_campus(points: DataFrame, key: str, campuses: DataFrame, least: int = config.MAJOR_MIN_STUDENTS) -> DataFrame:
    """Nearest major campus of each point, its distance and zone; the larger institution wins a tie."""
    major = located(campuses.filter(F.col("typical_in_person") >= least)).filter("x is not null")
    found = nearest(located(points), key, major, ["unitid", "institution"], [-F.col("typical_in_person"), F.col("unitid")])
    joined = points.join(found.withColumnsRenamed({"unitid": "campus_unitid", "institution": "campus_institution", "distance_m": "campus_distance_m"}), key, "left")
    return joined.withColumn("campus_zone", zone_of(F.col("campus_distance_m")))


def place_once(events: DataFrame, tagger) -> DataFrame:
    """Tag each distinct coordinate once and join the tags back."""
    places = events.select("lat", "lng").distinct().withColumn("place", F.concat_ws(",", "lat", "lng"))
    tagged = tagger(places).drop("place")
    return events.join(tagged, ["lat", "lng"], "left")


def edges(corners: DataFrame) -> DataFrame:
    """Polygon edges from (town, ring position, x, y) corners."""
    ring = W.partitionBy("town").orderBy("position")
    first = W.partitionBy("town").orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return corners.select(
        "town", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(ring), F.first("x").over(first)).alias("x2"), F.coalesce(F.lead("y").over(ring), F.first("y").over(first)).alias("y2"),
    )


def segment_distance() -> Column:
    """Distance of (x, y) to the edge (x1, y1)-(x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.least(F.greatest(((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return distance(F.col("x"), F.col("y"), F.col("x1") + t * dx, F.col("y1") + t * dy)


def assign_towns(points: DataFrame, key: str, town_edges: DataFrame, snap: float = config.SNAP_M, neighbour: float = config.NEIGHBOUR_M) -> DataFrame:
    """Town of each point, and the nearest other town within ``neighbour`` metres.

    Ray casting over the edges; a point on a border goes to the alphabetically
    first town, one outside all to a town within ``snap`` metres.
    """
    placed = located(points).filter("x is not null").select(key, "x", "y")
    # only towns whose bounding box is near enough to count meet a point; the edges are joined by town
    reach = max(snap, neighbour)
    boxes = town_edges.groupBy("town").agg(*((F.min if side < 0 else F.max)(c).alias(f"{c}_{'lo' if side < 0 else 'hi'}") for c in ("x1", "y1") for side in (-1, 1)))
    few = boxes.count() <= BROADCAST_POINTS
    near_box = F.col("x").between(F.col("x1_lo") - reach, F.col("x1_hi") + reach) & F.col("y").between(F.col("y1_lo") - reach, F.col("y1_hi") + reach)
    pairs = placed.join(F.broadcast(boxes) if few else boxes, near_box).select(key, "x", "y", "town").join(town_edges, "town")
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * F.try_divide(F.col("y") - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    towns = pairs.groupBy(key, "town").agg((F.count_if(crosses) % 2 == 1).alias("odd"), F.min(segment_distance()).alias("edge_m")).withColumn("inside", F.col("odd") | (F.col("edge_m") == 0))
    own = towns.filter(F.col("inside") | (F.col("edge_m") <= snap)).groupBy(key).agg(F.min_by("town", F.struct(~F.col("inside"), F.when(F.col("inside"), 0.0).otherwise(F.col("edge_m")), F.col("town"))).alias("municipality"))
    others = towns.join(own, key, "left").filter((F.coalesce("municipality", F.lit("")) != F.col("town")))
    away = F.when(F.col("inside"), 0.0).otherwise(F.col("edge_m"))
    near = others.filter(away <= neighbour).groupBy(key).agg(F.round(F.min(away)).alias("border_distance_m"), F.min_by("town", F.struct(away, F.col("town"))).alias("nearest_other_municipality"))
    return points.join(own, key, "left").join(near, key, "left").withColumn("municipality", F.coalesce("municipality", F.lit("unknown")))


def same_station(points: DataFrame, key: str, within: float = config.SAME_STATION_M) -> DataFrame:
    """(key, station): records chained by steps of at most ``within`` metres share the smallest key.

    Records of one place count once.  Cells are so small that all places of a cell are linked: each is linked to its
    cell's smallest, and two cells once if any of their places are near enough, so no pairs are made within a cell.
    """
    side = within / 1.4143
    here = located(points).filter("x is not null").select(key, "x", "y")
    places = here.groupBy("x", "y").agg(F.min(key).alias("__place")).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    places = materialize(places, "places")
    first = materialize(places.groupBy("cx", "cy").agg(F.min("__place").alias("__cell")), "cells")
    own = places.join(first, ["cx", "cy"])
    # each pair of cells from one side only
    ahead = [(i, j) for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2) if (i, j) > (0, 0)]
    around = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in ahead))
    there = own.select(F.col("__cell").alias("__other"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.explode(around).alias("c")).select("__other", "__x", "__y", "c.*")
    across = own.join(there, ["cx", "cy"]).filter(distance(F.col("x"), F.col("y"), F.col("__x"), F.col("__y")) <= within).select("__cell", "__other").distinct()
    links = own.select(F.col("__place").alias("__cell"), F.col("__cell").alias("__other")).unionByName(across)
    found = connected_components(links, "__cell", "__other", "__place", "station")
    at = materialize(places.join(found, "__place", "left").select("x", "y", F.coalesce("station", "__place").alias("station")), "stations")
    named = here.join(at, ["x", "y"]).select(key, "station")
    return points.select(key).join(named, key, "left").withColumn("station", F.coalesce("station", key))


def groups_by_shared(members: DataFrame, area: str, town: str) -> DataFrame:
    """(area, group): areas that share a town, directly or through others, have the group of the smallest area."""
    first = members.groupBy(town).agg(F.min(area).alias("__first"))
    found = connected_components(members.join(first, town), area, "__first", area, "group")
    return members.select(area).distinct().join(found, area, "left").withColumn("group", F.coalesce("group", area))
