"""Transverse Mercator on the WGS84 ellipsoid, boxes and pixel grids, as Column expressions.

The projection is the published Krueger series to the fourth order in the third flattening.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.sources.tables import written

# WGS84 and the UTM grid.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EASTING, SOUTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
_TO = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_FROM = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_LATITUDE = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _angles(longitude: Column, latitude: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and distance from the central meridian of degrees, in radians."""
    return F.radians(latitude), F.radians(longitude - (zone * 6 - 183))


def _conformal(phi: Column) -> Column:
    """The tangent of the conformal latitude."""
    sine = F.sin(phi)
    return F.sinh(F.atanh(sine) - F.lit(_E) * F.atanh(F.lit(_E) * sine))


def _on_sphere(t: Column, lam: Column) -> tuple[Column, Column]:
    """Transverse latitude and longitude of a conformal latitude's tangent."""
    return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))


def _metres(xi: Column, eta: Column, south: bool) -> tuple[Column, Column]:
    """Easting and northing of a place on the transverse sphere."""
    x = eta + _sum([F.lit(a) * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(_TO)])
    y = xi + _sum([F.lit(a) * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(_TO)])
    return F.lit(SCALE * _A) * x + EASTING, F.lit(SCALE * _A) * y + (SOUTH if south else 0.0)


def to_utm(longitude: Column, latitude: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees."""
    phi, lam = _angles(longitude, latitude, zone)
    return _metres(*_on_sphere(_conformal(phi), lam), south)


def from_utm(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of metres."""
    xi = (northing - (SOUTH if south else 0.0)) / (SCALE * _A)
    eta = (easting - EASTING) / (SCALE * _A)
    u = xi - _sum([F.lit(b) * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(_FROM)])
    v = eta - _sum([F.lit(b) * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(_FROM)])
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi + _sum([F.lit(d) * F.sin(2 * (j + 1) * chi) for j, d in enumerate(_LATITUDE)])
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183), F.degrees(phi)


def projected_bounds(spark: SparkSession, box: tuple[float, float, float, float], zone: int, points: int = 21, south: bool = False) -> DataFrame:
    """The box in metres around a box (west, south, east, north) in degrees: one row of west .. north.

    Its edges are curves in the projection, so points along them are projected, not corners alone.
    """
    w, s, e, n = box
    steps = spark.range(points + 1).select((F.col("id") / float(points)).alias("t"))
    edges = F.array(*[
        F.struct((F.lit(x0) + (x1 - x0) * F.col("t")).alias("lon"), (F.lit(y0) + (y1 - y0) * F.col("t")).alias("lat"))
        for x0, y0, x1, y1 in ((w, s, e, s), (w, n, e, n), (w, s, w, n), (e, s, e, n))
    ])
    edge = steps.select(F.explode(edges).alias("p")).select("p.*")
    east, north = to_utm(F.col("lon"), F.col("lat"), zone, south)
    placed = edge.select(east.alias("x"), north.alias("y"))
    return placed.agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


SIDES = ("west", "south", "east", "north")
#: Tasks over which boxes are dealt at least.
PARTS = 32


def projected_boxes(boxes: DataFrame, key: str, zone: int, points: int = 21, south: bool = False) -> DataFrame:
    """``(key, west, south, east, north)`` in metres around each box of a table in degrees.

    ``points`` steps along each edge are projected, as edges are curves there.  A row's points stay
    in its row; the boxes are dealt out first, as a small file with many of them is one task's
    otherwise.  Boxes with a missing side come out without sides.
    """

    def edge(x0: str, y0: str, x1: str, y1: str) -> Column:
        """Angles of points from one corner to another."""

        def point(k: Column) -> Column:
            t = k / float(points)
            phi, lam = _angles(F.col(x0) + (F.col(x1) - F.col(x0)) * t, F.col(y0) + (F.col(y1) - F.col(y0)) * t, zone)
            return F.struct(_conformal(phi).alias("t"), lam.alias("lam"))

        return F.transform(F.sequence(F.lit(0), F.lit(points)), point)

    def placed(p: Column) -> Column:
        xi, eta = _on_sphere(p["t"], p["lam"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def metres(p: Column) -> Column:
        x, y = _metres(p["xi"], p["eta"], south)
        return F.struct(x.alias("x"), y.alias("y"))

    corners = (("west", "south", "east", "south"), ("west", "north", "east", "north"), ("west", "south", "west", "north"), ("east", "south", "east", "north"))
    dealt = boxes.select(key, *SIDES).repartition(max(PARTS, 4 * boxes.sparkSession.sparkContext.defaultParallelism))
    # A step of the series is a value of its own, since an expression within a lambda is computed wherever it stands.
    spots = F.transform(F.transform(F.concat(*[edge(*c) for c in corners]), placed), metres)
    found = dealt.withColumn("_p", spots)
    return found.select(key, F.array_min("_p.x").alias("west"), F.array_min("_p.y").alias("south"), F.array_max("_p.x").alias("east"), F.array_max("_p.y").alias("north"))


def windows_on_grid(boxes: DataFrame, west: float, north: float, size: float, height: int, width: int) -> DataFrame:
    """Adds to each box in metres its part within a grid, the grid's window for it and the window's own origin.

    ``empty`` says that a box does not meet the grid, or is missing; its window then has none of
    the other columns.  The grid's corner is ``west``, ``north``, its cells' side ``size``.
    """
    grid = {"west": F.lit(float(west)), "south": F.lit(float(north - height * size)), "east": F.lit(float(west + width * size)), "north": F.lit(float(north))}
    own = {s: F.col(s) for s in SIDES}
    common = common_box(own, grid)
    meets = F.coalesce((common["west"] < common["east"]) & (common["south"] < common["north"]), F.lit(False))
    cut = boxes.withColumns({f"_{s}": F.when(meets, common[s]) for s in SIDES} | {"empty": ~meets}).drop(*SIDES)
    cut = cut.withColumnsRenamed({f"_{s}": s for s in SIDES})
    window = pixel_window(own, F.lit(float(west)), F.lit(float(north)), size)
    cut = cut.withColumns(window)
    own_west, own_north = window_origin({n: F.col(n) for n in window}, F.lit(float(west)), F.lit(float(north)), size)
    return cut.withColumns({"own_west": own_west, "own_north": own_north})


def meeting_boxes(a: DataFrame, b: DataFrame, levels: int = 24, finest: float = 1e-4) -> DataFrame:
    """All pairs of rows of two tables whose boxes (``west`` .. ``north``) meet; touching counts.

    The columns of ``b`` may not be called like those of ``a``, but for the sides, which come from
    ``a``.  Cells double in side from level to level; a box lies on the finest level whose cells are
    no smaller than itself, so in four of them at most.  Two boxes meet in a cell of the coarser of
    their levels, that with the south-west corner of what they share; so the tables are joined on
    cells, no pair comes twice and none is looked for.  A box also stands in the cells of the levels
    above its own that the other table uses.  Boxes with a missing, infinite or crossed side meet
    none; ``levels`` above ``finest`` bound what a box may measure: larger ones are an error when run.
    """

    def cells(df: DataFrame, mark: str) -> DataFrame:
        good = F.lit(True)
        for s in SIDES:
            good = good & (F.abs(s) < float("inf"))
        good = good & (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north"))
        side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(finest))
        level = F.ceil(F.log2(side / finest)).cast("int")
        bound = F.when(level > levels, F.raise_error(F.lit("a box is larger than the coarsest cell")).cast("int")).otherwise(level)
        return df.filter(good).withColumn(f"_{mark}", bound)

    def spread(df: DataFrame, mark: str, used: DataFrame) -> DataFrame:
        # A row for each level that a table uses, of a few.
        df = df.join(F.broadcast(used), F.col("_level") >= F.col(f"_{mark}"))
        side = F.lit(finest) * F.pow(F.lit(2.0), F.col("_level"))
        across, up = (F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))) for low, high in (("west", "east"), ("south", "north")))
        return df.withColumn("_x", across).withColumn("_y", up)

    one, two = cells(a, "own"), cells(b, "other")
    used = one.select(F.col("_own").alias("_level")).union(two.select("_other")).distinct()
    right = spread(two, "other", used).withColumnsRenamed({s: f"_{s}" for s in SIDES})
    met = spread(one, "own", used).join(right, ["_level", "_x", "_y"]).filter(F.col("_level") == F.greatest("_own", "_other"))
    side = F.lit(finest) * F.pow(F.lit(2.0), F.col("_level"))
    first = (F.floor(F.greatest("west", "_west") / side) == F.col("_x")) & (F.floor(F.greatest("south", "_south") / side) == F.col("_y"))
    touch = boxes_meet({s: F.col(s) for s in SIDES}, {s: F.col(f"_{s}") for s in SIDES})
    return met.filter(first & touch).drop("_level", "_x", "_y", "_own", "_other", *[f"_{s}" for s in SIDES])


def meeting_facts(a: DataFrame, b: DataFrame, facts: dict[str, tuple[str, str | None]]) -> DataFrame:
    """The rows of ``a`` whose box meets a row of ``b``, with facts about the rows that it meets.

    ``facts`` has names, each with ``count``, ``min`` or ``max`` and a column of ``b``; counts have
    none and count rows.  The pairs themselves would grow with the product of the tables where many
    rows have one box, so equal boxes of either table are one: those of ``b`` meet with their facts,
    which are put together again, and those of ``a`` share what was found.  See ``meeting_boxes``.
    """
    ends = {"min": F.min, "max": F.max}
    own = [(ends[kind](column) if kind in ends else F.count("*")).alias(f"_{name}") for name, (kind, column) in facts.items()]
    together = [ends.get(kind, F.sum)(f"_{name}").alias(name) for name, (kind, _) in facts.items()]
    # Each is read twice, for its levels and its cells.
    boxes = written(a.select(*SIDES).distinct())
    others = written(b.groupBy(*SIDES).agg(*own))
    found = meeting_boxes(boxes, others).groupBy(*SIDES).agg(*together)
    return a.join(found, list(SIDES)).select(*a.columns, *facts)


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether boxes with west, south, east and north meet; touching counts."""
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])


def common_box(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The intersection of boxes that meet."""
    return {k: (F.greatest if k in ("west", "south") else F.least)(a[k], b[k]) for k in ("west", "south", "east", "north")}


def pixel_window(box: dict[str, Column], west: Column, north: Column, size: float) -> dict[str, Column]:
    """Rounded pixel offsets and lengths of a box on a grid with square pixels, counted from its north-west."""
    return {
        "col_off": F.round((box["west"] - west) / size).cast("int"),
        "row_off": F.round((north - box["north"]) / size).cast("int"),
        "width": F.round((box["east"] - box["west"]) / size).cast("int"),
        "height": F.round((box["north"] - box["south"]) / size).cast("int"),
    }


def window_origin(window: dict[str, Column], west: Column, north: Column, size: float) -> tuple[Column, Column]:
    """West and north of a window's own grid."""
    return west + window["col_off"] * size, north - window["row_off"] * size
