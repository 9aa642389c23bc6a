"""Preparation of boxes (xmin, ymin, xmax, ymax), by arithmetic on their sides or on the unit cells they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def area(prefix: str = "") -> Column:
    return (F.col(prefix + "xmax") - F.col(prefix + "xmin")) * (F.col(prefix + "ymax") - F.col(prefix + "ymin"))


def repaired(df: DataFrame) -> DataFrame:
    """Boxes with ordered sides; without those that are null, not finite or empty."""
    fine = df.dropna(subset=list(SIDES)).where(" AND ".join(f"NOT isnan({c}) AND abs({c}) < double('infinity')" for c in SIDES))
    out = fine.select(*[c for c in df.columns if c not in SIDES], F.least("xmin", "xmax").alias("xmin"), F.least("ymin", "ymax").alias("ymin"), F.greatest("xmin", "xmax").alias("xmax"), F.greatest("ymin", "ymax").alias("ymax"))
    return out.where("xmax > xmin AND ymax > ymin")


def clipped(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Each box's part inside the given one, a row each; those that only touch its edge go."""
    x0, y0, x1, y1 = map(F.lit, box)
    out = df.withColumns({"xmin": F.greatest("xmin", x0), "ymin": F.greatest("ymin", y0), "xmax": F.least("xmax", x1), "ymax": F.least("ymax", y1)})
    return out.where("xmax > xmin AND ymax > ymin")


def buffered(df: DataFrame, distance: float) -> DataFrame:
    """Boxes grown on all sides (shrunk, if negative); those that vanish go."""
    out = df.withColumns({"xmin": F.col("xmin") - distance, "ymin": F.col("ymin") - distance, "xmax": F.col("xmax") + distance, "ymax": F.col("ymax") + distance})
    return out.where("xmax > xmin AND ymax > ymin")


def unit_cells(df: DataFrame, size: float) -> DataFrame:
    """One row per cell (cx, cy) of the given size whose centre a box holds."""
    span = lambda lo, hi: F.sequence(F.ceil(F.col(lo) / size - 0.5), F.ceil(F.col(hi) / size - 0.5) - 1)
    held = df.where(f"ceil(xmin / {size} - 0.5) < ceil(xmax / {size} - 0.5) AND ceil(ymin / {size} - 0.5) < ceil(ymax / {size} - 0.5)")
    return held.withColumn("cx", F.explode(span("xmin", "xmax"))).withColumn("cy", F.explode(span("ymin", "ymax")))


def deoverlapped(df: DataFrame, size: float, largest_first: bool, least_area: float = 0.0, least_part: float = 0.0) -> DataFrame:
    """(id, area, part): what each box keeps when every cell goes to its first box by area (ties by id); small rests go."""
    first = -area() if largest_first else area()
    cells = unit_cells(df.select("id", *SIDES, first.alias("_o")), size)
    owner = cells.groupBy("cx", "cy").agg(F.min_by("id", F.struct("_o", "id")).alias("id"))
    kept = owner.groupBy("id").agg((F.count("*") * size * size).alias("area"))
    out = kept.join(df.select("id", area().alias("_whole")), "id").select("id", "area", (F.col("area") / F.col("_whole")).alias("part"))
    return out.where((F.col("area") >= least_area) & (F.col("part") >= least_part))


def erased(df: DataFrame, cuts: DataFrame, size: float) -> DataFrame:
    """(id, area) of the boxes' cells that no cut covers; boxes with none left go."""
    gone = unit_cells(cuts, size).select("cx", "cy").distinct()
    return unit_cells(df, size).join(gone, ["cx", "cy"], "left_anti").groupBy("id").agg((F.count("*") * size * size).alias("area"))


def dissolved_area(df: DataFrame, size: float, keys: list[str] = ()) -> DataFrame:
    """Area that the boxes of a key cover, cells counted once."""
    return unit_cells(df, size).select(*keys, "cx", "cy").distinct().groupBy(*keys).agg((F.count("*") * size * size).alias("area"))


def cell_distance(cells: DataFrame, marks: DataFrame, size: float, reach: int) -> DataFrame:
    """cells (row, col) with the distance to the nearest mark within `reach` cells (null beyond): marks are dealt to the bands of cells they can be near to."""
    band = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    m = marks.select(F.col("row").alias("mr"), F.col("col").alias("mc")).distinct()
    m = m.withColumn("br", F.explode(F.transform(around, lambda i: i + band("mr")))).withColumn("bc", F.explode(F.transform(around, lambda i: i + band("mc"))))
    own = cells.select("row", "col", band("row").alias("br"), band("col").alias("bc"))
    d2 = (F.col("row") - F.col("mr")) * (F.col("row") - F.col("mr")) + (F.col("col") - F.col("mc")) * (F.col("col") - F.col("mc"))
    near = own.join(m, ["br", "bc"]).groupBy("row", "col").agg(F.min(d2).alias("_d"))
    return cells.join(near, ["row", "col"], "left").withColumn("distance", F.when(F.col("_d") <= reach * reach, F.sqrt("_d") * size)).drop("_d")


def tiles(width: int, height: int, side: int, spark) -> DataFrame:
    """(tile, row, col, rows, cols): a grid cut into tiles of at most side x side, in reading order."""
    across, down = -(-width // side), -(-height // side)
    t = spark.range(across * down)
    row, col = F.floor(F.col("id") / across) * side, F.pmod("id", F.lit(across)) * side
    return t.select(F.col("id").alias("tile"), row.alias("row"), col.alias("col"), F.least(F.lit(side), height - row).alias("rows"), F.least(F.lit(side), width - col).alias("cols"))


def snapped(df: DataFrame, size: float) -> DataFrame:
    """Boxes grown outward to whole cells, as windows: row and column offsets and sizes."""
    lo = lambda c: F.floor(F.col(c) / size)
    hi = lambda c: F.ceil(F.col(c) / size)
    return df.select("id", lo("xmin").alias("col_off"), lo("ymin").alias("row_off"), (hi("xmax") - lo("xmin")).alias("width"), (hi("ymax") - lo("ymin")).alias("height"))


def stacked(bands: dict[str, DataFrame]) -> DataFrame:
    """(row, col, a column a band) over the cells that all bands have valid; one aggregation over their union."""
    from functools import reduce

    long = reduce(DataFrame.union, [b.select("row", "col", F.lit(n).alias("_b"), F.col("z").cast("double").alias("z")) for n, b in bands.items()])
    wide = long.groupBy("row", "col").agg(*[F.max(F.when(F.col("_b") == n, F.col("z"))).alias(n) for n in bands])
    return wide.dropna(subset=list(bands))
