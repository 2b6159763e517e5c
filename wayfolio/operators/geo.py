"""Distance joins on a grid, so that no plan ever pairs everything with everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfolio.functions.places import EARTH_RADIUS_KM, haversine_km
from wayfolio.operators.ordered import first_per_key, row_numbers
from wayfolio.session import materialize

KM_PER_DEGREE = 111.19
SMALLEST_CELL = 0.001


def _row_height(km: float) -> float:
    return max(km / KM_PER_DEGREE, SMALLEST_CELL)


def _columns(cy: Column, size: float) -> Column:
    """Number of cells in a grid row: as wide as high at the row's edge towards the equator, so few near a pole."""
    edge = F.least(F.abs(cy), F.abs(cy + 1)) * size
    return F.greatest(F.lit(1), F.floor(F.lit(360 / size) * F.cos(F.radians(F.least(edge, F.lit(90.0)))))).cast("int")


def _own_cell(lat: Column, lng: Column, km: float) -> Column:
    size = _row_height(km)
    cy = F.floor(lat / size).cast("int")
    columns = _columns(cy, size)
    return F.struct(F.pmod(F.floor((lng + 180) / 360 * columns), columns).cast("int").alias("cx"), cy.alias("cy"))


def _spread(left: DataFrame, km: float, lat: str, lng: str) -> DataFrame:
    """One row per grid cell the circle around a row touches, as ``_cx`` and ``_cy``."""
    size, angle = _row_height(km), km / EARTH_RADIUS_KM
    reach = math.degrees(angle) * 1.000001
    la, lo = F.col(lat), F.col(lng)
    low, high = F.greatest(la - reach, F.lit(-90.0)), F.least(la + reach, F.lit(90.0))
    rows = F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))
    ratio = F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians(la))
    wide = F.when(F.abs(la) + reach >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001)
    columns = _columns(F.col("_cy"), size)
    place = lambda x: F.floor((x + 180) / 360 * columns).cast("int")
    whole = wide >= 180
    wanted = F.sequence(F.when(whole, 0).otherwise(place(lo - wide)), F.when(whole, columns - 1).otherwise(place(lo + wide)))
    wrapped = F.array_distinct(F.transform(wanted, lambda i: F.pmod(i, columns)))
    located = left.filter(la.isNotNull() & lo.isNotNull())
    return located.withColumn("_cy", F.explode(rows)).withColumn("_cx", F.explode(wrapped))


def _placed(right: DataFrame, km: float, lat: str, lng: str) -> DataFrame:
    """Rows with the grid cell they lie in."""
    cell = _own_cell(F.col(lat), F.col(lng), km)
    located = right.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    return located.withColumn("_cx", cell["cx"]).withColumn("_cy", cell["cy"])


def _matched(spread: DataFrame, placed: DataFrame, km: float, lat: str, lng: str, rlat: str, rlng: str) -> DataFrame:
    distance = haversine_km(F.col(lat), F.col(lng), F.col(rlat), F.col(rlng))
    joined = spread.join(placed, ["_cx", "_cy"]).withColumn("distance_km", distance)
    return joined.filter(F.col("distance_km") <= km).drop("_cx", "_cy")


def radius_pairs(left: DataFrame, right: DataFrame, km: float, lat: str, lng: str, rlat: str, rlng: str) -> DataFrame:
    """All (left, right) rows at most ``km`` apart, with ``distance_km``.

    Only the left side is spread over the cells its circle touches, so each pair appears once.
    """
    return _matched(_spread(left, km, lat, lng), _placed(right, km, rlat, rlng), km, lat, lng, rlat, rlng)


def thin(points: DataFrame, lat: str, lng: str, order: list, keep: int) -> DataFrame:
    """At most ``keep`` rows of every exact position, first in order.

    Rows at one position are equally far from everything, so a report of the first ``keep``
    rows around a point can never need more of them than that.
    """
    return first_per_key(points.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()), [lat, lng], order, keep)


# Rows of one grid cell that are joined at once.
CROWD = 2000


def first_around(
    left: DataFrame, right: DataFrame, km: float, cap: int, keys: list[str], order: str,
    lat: str, lng: str, rlat: str, rlng: str, crowd: int = CROWD,
) -> DataFrame:
    """For each left row the first ``cap`` right rows by ``order`` (unique) within ``km``.

    Without crowded cells this is one radius join. Otherwise each cell offers its first
    ``crowd`` rows, then eight times as many, and so on. A left row is settled once it holds
    ``cap`` hits that come before everything its cells still hold back, so in a dense place a
    row meets a few thousand others and not all of them, and the outcome is the same.
    """
    kept = thin(right, rlat, rlng, [order], cap)
    cells = _placed(kept, km, rlat, rlng)
    depth = max(crowd, cap)
    if cells.groupBy("_cx", "_cy").count().filter(F.col("count") > depth).isEmpty():
        pairs = radius_pairs(left, kept, km, lat, lng, rlat, rlng)
        return first_per_key(pairs, keys, [order], cap)

    ranked = materialize(row_numbers(cells, ["_cx", "_cy"], [order], "_n"))
    open_left, found = left, None
    while True:
        spread = _spread(open_left, km, lat, lng)
        offered = ranked.filter(F.col("_n") <= depth).drop("_n")
        withheld = ranked.filter(F.col("_n") == depth + 1).select("_cx", "_cy", F.col(order).alias("_next"))
        limits = spread.select(*keys, "_cx", "_cy").join(withheld, ["_cx", "_cy"]).groupBy(*keys).agg(F.min("_next").alias("_limit"))
        hits = first_per_key(_matched(spread, offered, km, lat, lng, rlat, rlng), keys, [order], cap, rank="_hit")
        hits = materialize(hits.join(limits, keys, "left"))
        full = hits.filter((F.col("_hit") == cap) & (F.col(order) < F.col("_limit"))).select(*keys)
        done = hits.filter("_limit is null").unionByName(hits.join(full, keys, "left_semi")).drop("_hit", "_limit")
        found = done if found is None else found.unionByName(done)
        open_left = materialize(open_left.join(limits, keys, "left_semi").join(full, keys, "left_anti"))
        if open_left.isEmpty():
            return found
        depth *= 8


def places_around(
    targets: DataFrame, places: DataFrame, km: float, cap: int, target_id: str = "target_id", crowd: int = CROWD,
) -> DataFrame:
    """The first ``cap`` places by id within ``km`` of each target (columns lat, lng)."""
    return first_around(targets, places, km, cap, [target_id], "id", "lat", "lng", "latitude", "longitude", crowd)


def nearest(df: DataFrame, lat: float, lng: float, k: int) -> DataFrame:
    """The k rows closest to one point; ties by id. One pass, a top-k per partition."""
    located = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    distance = haversine_km(lat, lng, F.col("latitude"), F.col("longitude"))
    # Ordering by a rounded distance keeps ties stable across engines.
    return located.withColumn("distance_km", F.round(distance, 6)).orderBy("distance_km", "id").limit(k)


#: Sides of the cells in degrees, each a quarter of the one before; the last are under a metre.
LEVELS = tuple(45 / 4**i for i in range(13))
#: A point that is left with so many candidates per place it asks for is not narrowed further.
ENOUGH = 16
#: Allowance in km for rounding in distances, far above it.
SLIP = 0.001


def _cell(value: Column, side: float, low: float) -> Column:
    return F.floor((value - low) / side).cast("bigint")


def nearest_each(points: DataFrame, places: DataFrame, k: int, key: str, enough: int = ENOUGH) -> DataFrame:
    """The k nearest places of many points (columns lat, lng), exact, by narrowing cells.

    Places are counted per cell of every level once. A point starts with the cells of the coarsest level and keeps those
    that can hold one of its k nearest: no cell whose nearest corner lies beyond the distance within which its other cells
    surely hold k. The kept cells are split in sixteen, and so on, until few places are left; only these are joined. So a
    point meets its neighbourhood, or the near edge of a far cluster, and never all places. Longitudes may go on beyond 180;
    a place whose coordinate is not a number has no position.
    """
    la, lo = F.col("latitude"), F.col("longitude")
    numbers = places.filter(~F.isnan("latitude") & ~F.isnan("longitude"))
    kept = materialize(thin(numbers, "latitude", "longitude", ["id"], k))
    around = F.pmod(lo + 180, F.lit(360.0)) - 180  # cells go from -180 to 180, longitudes may go on
    per_level = F.array(*[
        F.struct(F.lit(i).alias("level"), _cell(la, side, -90).alias("cy"), _cell(around, side, -180).alias("cx")) for i, side in enumerate(LEVELS)
    ])
    counts = kept.select(F.inline(per_level)).groupBy("level", "cy", "cx").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    located = points.filter("lat is not null and lng is not null")
    top = [F.struct(F.lit(y).cast("bigint").alias("cy"), F.lit(x).cast("bigint").alias("cx")) for y in range(5) for x in range(9)]
    open_cells = located.select(key, "lat", "lng", F.inline(F.array(*top)))
    found = None
    for level, side in enumerate(LEVELS):
        own = counts.filter(F.col("level") == level).drop("level")
        met = open_cells.join(own, ["cy", "cx"])
        south = F.col("cy") * side - 90
        middle = south + side / 2
        near = F.least(F.abs(south), F.abs(south + side))
        # along the meridian, then along the parallel: no point of the cell is farther from its middle
        reach = KM_PER_DEGREE * 1.001 * (side / 2 + side / 2 * F.when(south * (south + side) < 0, 1.0).otherwise(F.cos(F.radians(near)))) + SLIP
        away = haversine_km(F.col("lat"), F.col("lng"), middle, F.col("cx") * side - 180 + side / 2)
        bounded = met.withColumns({"_far": away + reach, "_near": away - reach})
        so_far = F.sum("n").over(W.partitionBy(key).orderBy("_far").rangeBetween(W.unboundedPreceding, W.currentRow))
        whole = W.partitionBy(key)
        limit = F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(whole)
        left = bounded.withColumn("_sum", so_far).withColumn("_limit", limit)
        left = left.filter(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit") + SLIP))
        left = materialize(left.withColumn("_left", F.sum("n").over(whole)).select(key, "lat", "lng", "cy", "cx", "_left"))
        last = level == len(LEVELS) - 1
        ready = left if last else left.filter(F.col("_left") <= enough * k)
        placed = kept.withColumns({"cy": _cell(la, side, -90), "cx": _cell(around, side, -180)})
        pairs = ready.select(key, "lat", "lng", "cy", "cx").join(placed, ["cy", "cx"]).drop("cy", "cx")
        pairs = pairs.withColumn("distance_km", F.round(haversine_km(F.col("lat"), F.col("lng"), la, lo), 6))
        ranked = first_per_key(pairs, [key], ["distance_km", "id"], k, rank="nearest_rank")
        found = ranked if found is None else found.unionByName(ranked)
        rest = left.filter(F.col("_left") > enough * k)
        if last or rest.isEmpty():
            return found
        parts = F.array(*[F.struct((F.col("cy") * 4 + y).alias("cy"), (F.col("cx") * 4 + x).alias("cx")) for y in range(4) for x in range(4)])
        open_cells = rest.select(key, "lat", "lng", F.inline(parts))
    return found


# Tile edge of the web map projection, in pixels at zoom 0.
TILE_PIXELS = 256
CLUSTER_PIXELS = 52


def grid_clusters(df: DataFrame, zoom: int, cell_px: int = CLUSTER_PIXELS) -> DataFrame:
    """Places per map cell at a zoom level: child count and centre."""
    world = TILE_PIXELS * 2 ** zoom
    la, lo = F.col("latitude"), F.col("longitude")
    sin = F.least(F.lit(0.9999), F.greatest(F.lit(-0.9999), F.sin(F.radians(la))))
    x = (lo + 180) / 360 * world
    y = (0.5 - F.log((1 + sin) / (1 - sin)) / (4 * math.pi)) * world
    return (
        df.filter(la.isNotNull() & lo.isNotNull())
        .groupBy(F.floor(x / cell_px).alias("cell_x"), F.floor(y / cell_px).alias("cell_y"))
        .agg(
            F.count(F.lit(1)).alias("places"),
            F.round(F.avg(la), 6).alias("latitude"), F.round(F.avg(lo), 6).alias("longitude"),
        )
    )


def bounds(df: DataFrame) -> DataFrame:
    """Bounding box and centre of the located rows; no row when none is located."""
    la, lo = F.col("latitude"), F.col("longitude")
    return (
        df.filter(la.isNotNull() & lo.isNotNull())
        .agg(
            F.min(la).alias("south"), F.min(lo).alias("west"), F.max(la).alias("north"), F.max(lo).alias("east"),
            F.count(F.lit(1)).alias("places"),
        )
        .filter(F.col("places") > 0)
        .withColumn("center_lat", (F.col("south") + F.col("north")) / 2)
        .withColumn("center_lng", (F.col("west") + F.col("east")) / 2)
    )
