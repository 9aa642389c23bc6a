"""Terrain of gridded elevation (row, col, z): 3x3 neighbourhoods, gradients, slope, aspect and heat load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbours by letter, row by row from the upper left; e is the cell itself.
AROUND = {letter: (i // 3 - 1, i % 3 - 1) for i, letter in enumerate("abcdefghi")}


def neighbourhood(cells: DataFrame) -> DataFrame:
    """row, col and the values a to i around each cell that exists; null where there is no neighbour or value.

    Each cell sends its value to the nine cells around it, so this is one shuffle on (row, col) with partial aggregation.
    """
    sent = F.array(*[F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(k).alias("k")) for k, (dr, dc) in AROUND.items()])
    to = cells.select("z", F.explode(sent).alias("t")).select("t.*", "z")
    per = to.groupBy("row", "col").agg(F.max(F.col("k") == "e").alias("own"), *[F.max(F.when(F.col("k") == k, F.col("z"))).alias(k) for k in AROUND])
    return per.where("own").drop("own")


def gradients(cells: DataFrame, x_res: float, y_res: float) -> DataFrame:
    """row, col, dzdx, dzdy by third-order finite differences; null at edges and next to missing values."""
    whole = F.col("e").isNotNull()
    dx = ((F.col("c") + 2 * F.col("f") + F.col("i")) - (F.col("a") + 2 * F.col("d") + F.col("g"))) / (8 * x_res)
    dy = ((F.col("g") + 2 * F.col("h") + F.col("i")) - (F.col("a") + 2 * F.col("b") + F.col("c"))) / (8 * y_res)
    whole = whole & dx.isNotNull() & dy.isNotNull()
    return neighbourhood(cells).select("row", "col", F.when(whole, dx).alias("dzdx"), F.when(whole, dy).alias("dzdy"))


def slope(dx: Column, dy: Column) -> Column:
    """Degrees of the steepest slope."""
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def aspect(dx: Column, dy: Column, flat: float = -1.0) -> Column:
    """Degrees clockwise from north that the slope faces; `flat` without a slope. Rows count southwards."""
    angle = F.degrees(F.atan2(-dx, dy))
    return F.when((dx == 0) & (dy == 0), F.lit(flat)).otherwise(F.when(angle < 0, angle + 360).otherwise(angle))


# Coefficients of the published heat load equation.
HEAT_LOAD = {"start": -1.467, "cos_lat_cos_slope": 1.582, "cos_aspect_sin_slope_sin_lat": -1.500, "sin_lat_sin_slope": -0.262, "sin_aspect_sin_slope": 0.607}


def heat_load(slope_deg: Column, aspect_deg: Column, latitude_deg: Column) -> Column:
    """Unitless heat load; aspects are folded about the line from north-east to south-west. Null in, null out."""
    turned = F.radians(180 - F.abs(F.pmod(aspect_deg - 45, F.lit(360.0)) - 180))
    s, lat = F.radians(slope_deg), F.radians(latitude_deg)
    k = HEAT_LOAD
    return F.exp(
        k["start"]
        + k["cos_lat_cos_slope"] * F.cos(lat) * F.cos(s)
        + k["cos_aspect_sin_slope_sin_lat"] * F.cos(turned) * F.sin(s) * F.sin(lat)
        + k["sin_lat_sin_slope"] * F.sin(lat) * F.sin(s)
        + k["sin_aspect_sin_slope"] * F.sin(turned) * F.sin(s)
    )


def coarsen(cells: DataFrame, times: int) -> DataFrame:
    """Average resampling to cells `times` as wide: row, col, z, n of values; null values are left out."""
    if times <= 0:
        raise ValueError("times must be positive")
    at = lambda c: F.floor(F.col(c) / times).alias(c)
    return cells.groupBy(at("row"), at("col")).agg(F.avg("z").alias("z"), F.count("z").alias("n"))
