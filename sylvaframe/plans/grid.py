"""Queries over gridded and placed stand-ins of the driver tables: terrain, resampling, neighbours and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvaframe.operators import points, spatial, terrain
from sylvaframe.plans.queries import over, query, rounded, table

#: Parts laid out as a grid of 40 columns, with the size as elevation.
GRID = "SELECT CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS row, CAST((p_partkey - 1) % 40 AS BIGINT) AS col, CAST(p_size AS DOUBLE) AS z FROM part"
#: Suppliers as points with a value.
POINTS = "SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS y, s_acctbal AS v, s_nationkey % 6 + 1 AS fold FROM supplier"
#: Suppliers as boxes.
BOXES = "SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 * 10 AS DOUBLE) AS xmin, CAST(s_suppkey * 53 % 97 * 10 AS DOUBLE) AS ymin, CAST(s_suppkey * 37 % 101 * 10 + 40 AS DOUBLE) AS xmax, CAST(s_suppkey * 53 % 97 * 10 + 40 AS DOUBLE) AS ymax FROM supplier"

grid, placed, boxes = over(GRID, "part"), over(POINTS, "supplier"), over(BOXES, "supplier")
_AROUND = ", ".join(f"(SELECT z FROM g n WHERE n.row = m.row + {dr} AND n.col = m.col + {dc}) AS {k}" for k, (dr, dc) in terrain.AROUND.items())
_GRADIENTS = f"""WITH g AS ({GRID}), n AS (SELECT row, col, {_AROUND} FROM g m),
d AS (SELECT row, col, e + ((c + 2 * f + i) - (a + 2 * d + g)) / 80 + ((g + 2 * h + i) - (a + 2 * b + c)) / 80 AS whole,
((c + 2 * f + i) - (a + 2 * d + g)) / 80 AS dx, ((g + 2 * h + i) - (a + 2 * b + c)) / 80 AS dy FROM n),
k AS (SELECT row, col, CASE WHEN whole IS NOT NULL THEN dx END AS dx, CASE WHEN whole IS NOT NULL THEN dy END AS dy FROM d),
s AS (SELECT row, col, dx, dy, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope,
CASE WHEN dx = 0 AND dy = 0 THEN -1 WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END AS aspect FROM k)"""


def _terrain(s, d):
    own = terrain.gradients(grid(s, d), 10.0, 10.0)
    dx, dy = F.col("dzdx"), F.col("dzdy")
    return own.select("row", "col", "dzdx", "dzdy", terrain.slope(dx, dy).alias("slope"), terrain.aspect(dx, dy).alias("aspect"))


@query("pr32_gradients", _GRADIENTS + " SELECT row, col, round(dx, 6) AS dzdx, round(dy, 6) AS dzdy FROM s")
def _(s, d):
    return rounded(_terrain(s, d).select("row", "col", "dzdx", "dzdy"), 6)


@query("pr33_slope", _GRADIENTS + " SELECT row, col, round(slope, 6) AS slope FROM s")
def _(s, d):
    return rounded(_terrain(s, d).select("row", "col", "slope"), 6)


@query("pr34_aspect", _GRADIENTS + " SELECT row, col, round(aspect, 6) AS aspect FROM s")
def _(s, d):
    return rounded(_terrain(s, d).select("row", "col", "aspect"), 6)


_FOLD = "radians(180 - abs((aspect + 315) % 360 - 180))"


@query("pr35_heat_load", _GRADIENTS + f", t AS (SELECT row, col, {_FOLD} AS a, radians(slope) AS s, radians(45.5) AS l FROM s) SELECT row, col, round(exp(-1.467 + 1.582 * cos(l) * cos(s) - 1.5 * cos(a) * sin(s) * sin(l) - 0.262 * sin(l) * sin(s) + 0.607 * sin(a) * sin(s)), 6) AS hli FROM t")
def _(s, d):
    return rounded(_terrain(s, d).select("row", "col", terrain.heat_load(F.col("slope"), F.col("aspect"), F.lit(45.5)).alias("hli")), 6)


@query("sp10_average_resample", f"WITH g AS ({GRID}) SELECT CAST(floor(row / 4) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, round(avg(z), 9) AS z, count(z) AS n FROM g GROUP BY ALL")
def _(s, d):
    return rounded(terrain.coarsen(grid(s, d), 4))


@query("sp11_class_fraction", f"WITH g AS ({GRID}) SELECT CAST(floor(row / 5) AS BIGINT) AS row, CAST(floor(col / 5) AS BIGINT) AS col, round(avg(CASE WHEN z > 30 THEN 1.0 ELSE 0.0 END), 9) AS z, count(*) AS n FROM g GROUP BY ALL")
def _(s, d):
    return rounded(terrain.coarsen(grid(s, d).withColumn("z", (F.col("z") > 30).cast("double")), 5))


@query("sp12_snapped_grid", f"WITH b AS ({BOXES}) SELECT floor((min(xmin) - 5) / 100) * 100 AS xmin, floor((min(ymin) - 5) / 100) * 100 AS ymin, ceil((max(xmax) + 5) / 100) * 100 AS xmax, ceil((max(ymax) + 5) / 100) * 100 AS ymax FROM b")
def _(s, d):
    low = lambda c: ((F.floor((F.min(c) - 5) / 100) * 100).cast("double")).alias(c)
    high = lambda c: ((F.ceil((F.max(c) + 5) / 100) * 100).cast("double")).alias(c)
    return boxes(s, d).agg(low("xmin"), low("ymin"), high("xmax"), high("ymax"))


@query("sp06_rasterise", f"WITH b AS ({BOXES}) SELECT id, r.c AS row, k.c AS col FROM b, range(0, 110) r(c), range(0, 110) k(c) WHERE k.c * 10 + 5 BETWEEN xmin AND xmax AND r.c * 10 + 5 BETWEEN ymin AND ymax")
def _(s, d):
    own = spatial.cells(boxes(s, d), 10.0)
    inside = "cx * 10 + 5 BETWEEN xmin AND xmax AND cy * 10 + 5 BETWEEN ymin AND ymax"
    return own.where(inside).selectExpr("id", "cy AS row", "cx AS col")


@query("sp20_centroids", "SELECT l_orderkey AS parcel_id, round(avg(l_linenumber * 10.0 + 5), 9) AS x, round(avg(CAST(l_partkey % 100 AS DOUBLE)), 9) AS y FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("parcel_id")).agg(F.avg(F.col("l_linenumber") * 10.0 + 5).alias("x"), F.avg((F.col("l_partkey") % 100).cast("double")).alias("y")))


@query("jn14_adjacent_groups", f"WITH RECURSIVE b AS ({BOXES}), e AS (SELECT l.id AS a, r.id AS b FROM b l JOIN b r ON l.xmin <= r.xmax AND r.xmin <= l.xmax AND l.ymin <= r.ymax AND r.ymin <= l.ymax), w AS (SELECT id, id AS c FROM b UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.id) SELECT id, min(c) AS component FROM w GROUP BY id")
def _(s, d):
    own = boxes(s, d)
    label = points.groups(points.touching(own, 40.0))
    return own.select("id").join(label, "id", "left").selectExpr("id", "coalesce(component, id) AS component")


@query("jn15_nearest", f"WITH p AS ({POINTS}), r AS (SELECT l.id, q.id AS other, sqrt((l.x - q.x) ** 2 + (l.y - q.y) ** 2) AS dist FROM p l JOIN p q ON l.fold < 4 AND q.fold >= 4), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS n FROM r) SELECT id, other, round(dist, 9) AS dist FROM k WHERE n = 1")
def _(s, d):
    own = placed(s, d)
    return rounded(points.nearest(own.where("fold < 4"), own.where("fold >= 4"), 8.0))


@query("jn18_distance_band", f"WITH p AS ({POINTS}) SELECT l.id, q.id AS other, round(sqrt((l.x - q.x) ** 2 + (l.y - q.y) ** 2), 9) AS dist FROM p l JOIN p q ON l.id <> q.id AND sqrt((l.x - q.x) ** 2 + (l.y - q.y) ** 2) <= 12")
def _(s, d):
    return rounded(points.within(placed(s, d), 12.0))


@query("jn23_tiles", f"WITH b AS ({BOXES}) SELECT id, x.i AS cx, y.i AS cy FROM b, range(0, 40) x(i), range(0, 40) y(i) WHERE x.i BETWEEN floor(xmin / 64) AND floor(xmax / 64) AND y.i BETWEEN floor(ymin / 64) AND floor(ymax / 64)")
def _(s, d):
    return spatial.cells(boxes(s, d), 64.0).select("id", "cx", "cy")


@query("ac01_variogram", f"WITH p AS ({POINTS}), r AS (SELECT sqrt((l.x - q.x) ** 2 + (l.y - q.y) ** 2) AS dist, (l.v - q.v) ** 2 AS dd FROM p l JOIN p q ON l.id < q.id) SELECT CAST(ceil(dist / 5) AS BIGINT) AS lag, count(*) AS n, round(avg(dd) / 2, 2) AS gamma FROM r WHERE dist > 0 AND dist <= 40 GROUP BY 1")
def _(s, d):
    return rounded(points.variogram(placed(s, d), "v", 8, 40.0), 2)


@query("ac05_moran", f"WITH p AS ({POINTS}), m AS (SELECT id, x, y, v - avg(v) OVER () AS z, count(*) OVER () AS n FROM p), w AS (SELECT l.id, any_value(l.z) AS z, avg(q.z) AS near, count(*) AS k FROM m l JOIN m q ON l.id <> q.id AND sqrt((l.x - q.x) ** 2 + (l.y - q.y) ** 2) <= 12 GROUP BY l.id) SELECT round(sum(z * near) / count(*) / (SELECT avg(z * z) FROM m), 6) AS moran_i, round(-1 / ((SELECT count(*) FROM p) - 1), 6) AS expected_i, round(coalesce(sum(k), 0) / (SELECT count(*) FROM p), 6) AS mean_neighbours FROM w")
def _(s, d):
    return rounded(points.moran(placed(s, d), "v", 12.0), 6)


@query("pr27_rotate", f"WITH p AS ({POINTS}), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM p) SELECT id, round(mx + (x - mx) * cos(radians(30)) - (y - my) * sin(radians(30)), 6) AS x, round(my + (x - mx) * sin(radians(30)) + (y - my) * cos(radians(30)), 6) AS y FROM p, m")
def _(s, d):
    return rounded(points.rotate(placed(s, d), 30.0).select("id", "x", "y"), 6)


@query("pr26_origin_shift", f"WITH p AS ({POINTS}) SELECT id, x - (SELECT min(x) FROM p) AS x, y - (SELECT min(y) FROM p) AS y FROM p")
def _(s, d):
    own = placed(s, d)
    low = own.agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    return own.crossJoin(F.broadcast(low)).selectExpr("id", "x - lx AS x", "y - ly AS y")


@query("pr45_interpolate", "SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 0.2 WHEN p_size <= 20 THEN 0.2 + (p_size - 10) * 0.04 WHEN p_size <= 40 THEN 0.6 + (p_size - 20) * 0.015 ELSE 0.9 END, 9) AS y FROM part")
def _(s, d):
    return rounded(points.interpolate(table(s, d, "part"), F.col("p_size"), [(10, 0.2), (20, 0.6), (40, 0.9)]).select("p_partkey", "y"))
