"""A stored layout of places in which a circle is a few ranges of one key.

The key interleaves the bits of a place's row and column on a grid of 2^LEVEL by 2^LEVEL cells, so that places near one
another mostly have near keys. Files hold ranges of it, in folders by its first bits: a reader names the folders that a circle
touches, and within their files the row groups whose keys do. The folders a crowded region takes grow in files, not in size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from wayfolio.functions.places import EARTH_RADIUS_KM

LEVEL = 16
#: Leading bits of the key that name a folder; places without a position on the globe have a folder of their own.
FOLDER_BITS = 8
NOWHERE = -1
KEY_FIELDS = [StructField("place_key", LongType()), StructField("region", IntegerType())]
#: Key ranges a circle is written as; more would follow its border closer.
RANGES = 48
#: Spreads bits apart, a step per line: shift and mask.
_STEPS = [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)]


def _spread_bits(c: Column) -> Column:
    return reduce(lambda v, step: v.bitwiseOR(F.shiftleft(v, step[0])).bitwiseAND(F.lit(step[1]).cast("bigint")), _STEPS, c.cast("bigint"))


def _cell(value, low: float, width: float):
    """Number of the cell along one axis: the same formula for a column here and for an edge of a circle's box."""
    scaled = (value - low) / width * (1 << LEVEL)
    if isinstance(scaled, float):
        return min(max(math.floor(scaled), 0), (1 << LEVEL) - 1)
    return F.least(F.floor(scaled), F.lit((1 << LEVEL) - 1))


def place_key(lat: str = "latitude", lng: str = "longitude") -> Column:
    """The key of a position; null for a missing one and for one that isn't on the globe."""
    la, lo = F.col(lat).cast("double"), F.col(lng).cast("double")
    key = F.shiftleft(_spread_bits(_cell(la, -90.0, 180.0)), 1).bitwiseOR(_spread_bits(_cell(lo, -180.0, 360.0)))
    return F.when(la.between(-90, 90) & lo.between(-180, 180), key)


def boxes(lat: float, lng: float, km: float) -> list[tuple[float, float, float, float]]:
    """Boxes (south, north, west, east) that hold the circle: one, or two where it crosses 180 degrees."""
    angle = km / EARTH_RADIUS_KM
    reach = math.degrees(angle) * 1.0001 + 1e-6
    south, north = max(lat - reach, -90.0), min(lat + reach, 90.0)
    if abs(lat) + reach >= 90:
        return [(south, north, -180.0, 180.0)]
    wide = math.degrees(math.asin(min(math.sin(math.radians(reach)) / math.cos(math.radians(lat)), 1.0))) * 1.0001 + 1e-6
    middle = (lng + 180) % 360 - 180
    west, east = middle - wide, middle + wide
    if wide >= 180:
        return [(south, north, -180.0, 180.0)]
    if west < -180:
        return [(south, north, west + 360, 180.0), (south, north, -180.0, east)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    return [(south, north, west, east)]


def near_box(lat: float, lng: float, km: float, la: str = "latitude", lo: str = "longitude") -> Column:
    """Plain bounds on both coordinates that every row within the circle meets, so a scan can skip what lies outside.

    Rows with coordinates beyond the globe's pass: their distance decides.
    """
    if not -90 <= lat <= 90:
        return F.col(la).isNotNull() & F.col(lo).isNotNull()
    beyond = (F.col(la) < -90) | (F.col(la) > 90) | (F.col(lo) < -180) | (F.col(lo) > 180)
    parts = [F.col(la).between(s, n) & F.col(lo).between(w, e) for s, n, w, e in boxes(lat, lng, km)]
    return reduce(lambda a, b: a | b, parts, beyond)


def key_ranges(lat: float, lng: float, km: float, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` inclusive key ranges that hold all positions of the circle's boxes.

    Squares of the grid are quartered while they cross a border and the number of ranges allows it.
    """
    edges = [(_cell(s, -90.0, 180.0), _cell(n, -90.0, 180.0), _cell(w, -180.0, 360.0), _cell(e, -180.0, 360.0)) for s, n, w, e in boxes(lat, lng, km)]

    def meets(square) -> int:
        """0: outside all boxes, 1: across a border, 2: inside one."""
        row, column, level = square
        size = 1 << (LEVEL - level)
        r0, c0, found = row * size, column * size, 0
        for s, n, w, e in edges:
            if s <= r0 and r0 + size - 1 <= n and w <= c0 and c0 + size - 1 <= e:
                return 2
            if r0 <= n and r0 + size - 1 >= s and c0 <= e and c0 + size - 1 >= w:
                found = 1
        return found

    whole, open_squares = [], [(0, 0, 0)]
    while open_squares and open_squares[0][2] < LEVEL and len(whole) + 4 * len(open_squares) <= most:
        quarters = [(2 * r + i, 2 * c + j, level + 1) for r, c, level in open_squares for i in (0, 1) for j in (0, 1)]
        whole += [q for q in quarters if meets(q) == 2]
        open_squares = [q for q in quarters if meets(q) == 1]

    def span(square) -> tuple[int, int]:
        row, column, level = square
        first = sum(((row >> b & 1) << (2 * b + 1)) | ((column >> b & 1) << (2 * b)) for b in range(level))
        size = 1 << (2 * (LEVEL - level))
        return first * size, first * size + size - 1

    merged: list[tuple[int, int]] = []
    for low, high in sorted(map(span, whole + open_squares)):
        if merged and merged[-1][1] + 1 == low:
            merged[-1] = (merged[-1][0], high)
        else:
            merged.append((low, high))
    return merged


def write_places(places: DataFrame, path: str, files: int | None = None) -> None:
    """Store ``places`` in ranges of the key, with the columns ``place_key`` and ``region``; an earlier table is replaced."""
    keyed = places.withColumn("place_key", place_key())
    region = F.shiftright("place_key", 2 * LEVEL - FOLDER_BITS).cast("int")
    keyed = keyed.withColumn("region", F.coalesce(region, F.lit(NOWHERE)))
    # Places at one position, and those without one, are parted by a hash of their own values.
    own = F.xxhash64(*[F.col(c) for c, kind in places.dtypes if "map<" not in kind])
    spread = keyed.repartitionByRange(*([files] if files else []), "region", "place_key", own)
    spread.sortWithinPartitions("region", "place_key").write.mode("overwrite").partitionBy("region").parquet(path)


def read_places(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The stored table. With the ``schema`` of the places it was made of, a table without rows can be read too."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(StructType([*schema.fields, *KEY_FIELDS])).parquet(path)


def stored_near(stored: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """The rows of a table from ``write_places`` that may lie within the circle; the caller's distance decides.

    Folders are skipped in planning, row groups by their smallest and largest keys. Rows without a key pass only where
    their coordinates lie beyond the globe's.
    """
    if not -90 <= lat <= 90:
        return stored.drop("place_key", "region")
    ranges, shift = key_ranges(lat, lng, km), 2 * LEVEL - FOLDER_BITS
    folders = sorted({f for low, high in ranges for f in range(low >> shift, (high >> shift) + 1)})
    inside = reduce(lambda a, b: a | b, [F.col("place_key").between(low, high) for low, high in ranges])
    kept = stored.filter(F.col("region").isin([NOWHERE, *folders])).filter(inside | F.col("place_key").isNull())
    return kept.filter(near_box(lat, lng, km)).drop("place_key", "region")
