"""Neighbourhoods in the plane and calendars of affected entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.times import lit


def near_counts(
    points: DataFrame,
    others: DataFrame,
    key: str,
    radius: float,
    cells_per_radius: int = 4,
    pairs_limit: int = 1_000_000,
    levels: int = 12,
) -> DataFrame:
    """How many `others` lie within `radius` of each point, borders included.

    Equal coordinates are summed on both sides first. A cell that lies in the circle of every point
    of another cell is counted as a whole. Pairs of cells on the border are compared point by point
    while they are sparse; dense ones are cut into quarters, of which again only the border remains.
    """
    homes = points.select("x", "y").distinct().checkpoint()
    spots = others.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    side, pairs, parts = radius / cells_per_radius, None, []
    for level in range(levels):
        near = homes.select(*_cell("h", side), "x", "y")
        far = spots.select(*_cell("s", side), F.col("x").alias("ox"), F.col("y").alias("oy"), "n")
        home_cells = near.groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("homes"))
        spot_cells = far.groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("spots"), F.sum("n").alias("n"))
        if pairs is None:
            reach = [lit(d) for d in range(-cells_per_radius - 1, cells_per_radius + 2)]
            pairs = home_cells.select("hx", "hy", F.explode(F.array(*reach)).alias("dx")).select(
                "hx", "hy", (F.col("hx") + F.col("dx")).alias("sx"), F.explode(F.array(*reach)).alias("dy")
            )
            pairs = pairs.select("hx", "hy", "sx", (F.col("hy") + F.col("dy")).alias("sy"))
        else:
            halves = F.array(lit(0), lit(1))
            for axis in ("hx", "hy", "sx", "sy"):
                rest = [c for c in pairs.columns if c != axis]
                half = pairs.select(*rest, axis, F.explode(halves).alias("_half"))
                pairs = half.select(*rest, (F.col(axis) * 2 + F.col("_half")).alias(axis))
        sized = pairs.join(home_cells, ["hx", "hy"]).join(spot_cells, ["sx", "sy"])
        gx, gy = F.abs(F.col("hx") - F.col("sx")), F.abs(F.col("hy") - F.col("sy"))
        # A hair is kept free so that rounding never counts or drops a cell that it should not.
        farthest = F.sqrt((gx + 1) * (gx + 1) + (gy + 1) * (gy + 1)) * (side * (1 + 1e-9))
        ax, ay = F.greatest(gx - 1, lit(0)), F.greatest(gy - 1, lit(0))
        nearest = F.sqrt(ax * ax + ay * ay) * (side * (1 - 1e-9))
        sized = sized.withColumn("whole", farthest <= radius).filter(nearest <= radius).checkpoint()
        inner = sized.filter("whole").groupBy("hx", "hy").agg(F.sum("n").alias("n"))
        parts.append(near.join(inner, ["hx", "hy"]).select("x", "y", "n"))
        dense = F.lit(False) if level == levels - 1 else F.col("homes") * F.col("spots") > pairs_limit
        border = sized.filter(~F.col("whole") & ~dense).select("hx", "hy", "sx", "sy")
        dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
        close = near.join(border, ["hx", "hy"]).join(far, ["sx", "sy"]).filter(F.sqrt(dx * dx + dy * dy) <= radius)
        parts.append(close.groupBy("x", "y").agg(F.sum("n").alias("n")))
        pairs = sized.filter(~F.col("whole") & dense).select("hx", "hy", "sx", "sy")
        if pairs.isEmpty():
            break
        side /= 2
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    counts = union.groupBy("x", "y").agg(F.sum("n").alias("near"))
    return points.join(counts, ["x", "y"], "left").select(key, F.coalesce("near", lit(0)).alias("near"))


def _cell(prefix: str, side: float) -> list[Column]:
    """Cell numbers; a quarter of a cell has twice its number, or one more."""
    return [F.floor(F.col(axis) / F.lit(side)).cast("bigint").alias(f"{prefix}{axis}") for axis in ("x", "y")]


def in_calendar(rows: DataFrame, calendar: DataFrame, entity: str, day: str, length: int, name: str) -> DataFrame:
    """Flag rows whose entity is listed for one of the days [d, d + length) that hold the row's day.

    The calendar is opened to the days it covers, so the join is on equal entity and day and can not
    multiply rows.
    """
    days = (
        calendar.select(entity, F.explode(F.sequence(F.col("day"), F.col("day") + lit(length - 1))).alias(day))
        .distinct()
        .withColumn("_listed", F.lit(True))
    )
    joined = rows.join(days, [entity, day], "left")
    return joined.withColumn(name, F.coalesce("_listed", F.lit(False))).drop("_listed")
