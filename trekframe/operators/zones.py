"""Zones of points over a covering index of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.functions.geo import wrapped_delta


#: Degrees east and north by which cells lie off the decimals, so that no corner of a zone lies on a cell's border and no edge of a plain slope meets a cell's corner.
EAST, NORTH = 0.00031415926535, 0.00027182818284


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges (zone, x1, y1, x2, y2) of rings(zone, ring, seq, lat, lng), closed and unwrapped.

    Longitudes go on without a jump along a ring, so one that crosses the
    antimeridian has edges beyond 180 degrees; each ring begins within a turn of
    its zone's first ring, so that holes lie where their zone lies.
    """
    w = Window.partitionBy("zone", "ring").orderBy("seq")
    step = F.coalesce(wrapped_delta(F.col("lng") - F.lag("lng").over(w)), F.lit(0.0))
    r = rings.withColumn("step", step).withColumn("along", F.sum("step").over(w)).withColumn("first", F.first("lng").over(w))
    r = r.withColumn("anchor", F.first("lng").over(Window.partitionBy("zone").orderBy("ring", "seq"))).withColumn("x", F.col("anchor") + wrapped_delta(F.col("first") - F.col("anchor")) + F.col("along"))
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(ends))
    return r.select("zone", F.col("x").alias("x1"), F.col("lat").alias("y1"), nxt("x").alias("x2"), nxt("lat").alias("y2")).where("x1 <> x2 OR y1 <> y2")


def _crossing(at: Column) -> Column:
    """Where an edge meets the parallel at this latitude."""
    return (F.col("x2") - F.col("x1")) * (at - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")


def zone_index(edges: DataFrame, cells: int = 720) -> DataFrame:
    """The cover of each zone by cells of 360 / cells degrees: (cx, cy, zone, x, odd, edges).

    Even-odd over all rings of a zone, so holes are rings like others.  A cell
    that no edge touches lies wholly inside or outside; the outer ones are left
    out, the inner ones have no edges.  A border cell has the edges that touch it
    and whether its south-eastern corner lies inside (odd).  x is the cell's place
    before it is wrapped round the globe.  What a cell holds depends on the detail
    of a polygon within it, not on the polygon's size.

    Corners are told from one another row by row: the crossings of a row's
    southern parallel are counted by cell, and a corner is inside if an odd number
    lies east of it.  A corner's side is that just east of it, as in zone_of_point:
    what crosses at the corner itself lies west.
    """
    size = F.lit(360.0 / cells)
    to = lambda v, shift=EAST: F.floor((v - shift) / size)
    rows = F.sequence(to(F.least("y1", "y2"), NORTH), to(F.greatest("y1", "y2"), NORTH))
    spot = edges.withColumn("y", F.explode(rows))
    # the stretch of the edge within the row, widened a little so that rounding loses no cell
    south, north = F.greatest(F.least("y1", "y2"), F.col("y") * size + NORTH), F.least(F.greatest("y1", "y2"), (F.col("y") + 1) * size + NORTH)
    level = F.col("y1") == F.col("y2")
    a, b = F.when(level, F.col("x1")).otherwise(_crossing(south)), F.when(level, F.col("x2")).otherwise(_crossing(north))
    spot = spot.withColumns({"lo": to(F.least(a, b) - 1e-9), "hi": to(F.greatest(a, b) + 1e-9)})
    border = spot.withColumn("x", F.explode(F.sequence("lo", "hi"))).groupBy("zone", "x", "y").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    base = F.col("y") * size + NORTH
    cross = edges.where("y1 <> y2").withColumn("y", F.explode(rows)).where((F.col("y1") > base) != (F.col("y2") > base))
    cross = cross.select("zone", "y", (F.ceil((_crossing(base) - EAST) / size) - 1).alias("x"))
    # a run between two neighbouring crossings' cells is inside where an odd number lies east of it
    w = Window.partitionBy("zone", "y").orderBy(F.desc("x"))
    n = cross.groupBy("zone", "y", "x").agg(F.count("*").alias("n")).withColumns({"east": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "west": F.lead("x").over(w)})
    own = n.select("zone", "y", "x", (F.col("east") % 2 == 1).alias("odd"))
    between = n.where("west IS NOT NULL AND west < x - 1 AND (east + n) % 2 = 1").withColumn("x", F.explode(F.sequence(F.col("west") + 1, F.col("x") - 1))).select("zone", "y", "x", F.lit(True).alias("odd"))
    corner = own.unionByName(between)
    both = border.join(corner, ["zone", "x", "y"], "full").withColumn("odd", F.coalesce("odd", F.lit(False))).where("edges IS NOT NULL OR odd")
    return both.select(F.pmod("x", F.lit(cells)).alias("cx"), F.col("y").alias("cy"), "zone", "x", "odd", "edges")


def zone_of_point(points: DataFrame, index: DataFrame, key: str, cells: int = 720) -> DataFrame:
    """points(key, lat, lng) with the zone that holds each, the least where several do, null where none does.

    A point meets the zones of its own cell: an equi-join, by sorting whatever size
    the index is held to have, since an estimate counts no row that a sequence of
    cells makes, and a broadcast brings the whole index to the driver.  Within a border cell
    the corner's side changes with each of the cell's edges that the way from the
    corner north along the cell's side, then west to the point, crosses.
    """
    size = F.lit(360.0 / cells)
    to = lambda v, shift: F.floor((F.col(v) - shift) / size)
    at = points.withColumns({"cx": F.pmod(to("lng", EAST), F.lit(cells)), "cy": to("lat", NORTH)})
    j = at.join(index.hint("merge"), ["cx", "cy"])
    lng = F.col("lng") + F.round((F.col("x") - to("lng", EAST)) / cells) * 360.0
    east, south, lat = (F.col("x") + 1) * size + EAST, F.col("cy") * size + NORTH, F.col("lat")

    def crossed(e: Column) -> Column:
        up = e["y1"] + (east - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        side = ((e["x1"] > east) != (e["x2"] > east)) & (up > south) & (up <= lat)
        over = e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        row = ((e["y1"] > lat) != (e["y2"] > lat)) & (over > lng) & (over <= east)
        return side.cast("int") + row.cast("int")

    turns = F.aggregate(F.transform("edges", crossed), F.lit(0), lambda a, x: a + x)
    inside = F.when(F.col("edges").isNull(), True).otherwise(F.col("odd") != (turns % 2 == 1))
    best = j.where(inside).groupBy(key).agg(F.min("zone").alias("zone"))
    return points.join(best, key, "left")
