"""Distances in feature space: weighted standardising, nearest neighbours by cells and boxes, applicability."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators import points

#: Reference rows of a cell, and rows of a leaf within it.
BLOCK, LEAF = 16_384, 64
#: Of mean distances: Chebyshev nodes a side of a cell, points of a cell at least, and the gap of two cells over the longer diagonal from which nodes stand for points.
ORDER, LEAST, FAR = 12, 512, 1.0


def fitted(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation (0 becomes 1) of each column as arrays `means` and `sds`."""
    sd = lambda c: F.stddev_pop(c)
    return df.agg(F.array(*[F.avg(c) for c in columns]).alias("means"), F.array(*[F.when(sd(c) == 0, 1.0).otherwise(sd(c)) for c in columns]).alias("sds"))


def scaled(df: DataFrame, columns: list[str], model: DataFrame, weights: list[float]) -> DataFrame:
    """df with `x`, the columns standardised by the one row of `fitted` and weighted."""
    x = [((F.col(c) - F.get("means", F.lit(i))) / F.get("sds", F.lit(i)) * w) for i, (c, w) in enumerate(zip(columns, weights, strict=True))]
    return df.crossJoin(F.broadcast(model)).withColumn("x", F.array(*x)).drop("means", "sds")


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows of x in leaves of at most `size`: halves along the widest side, again and again."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        wide = np.ptp(x[at], axis=0).argmax()
        half = len(at) // 2
        order = np.argpartition(x[at, wide], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def _least_two(x: np.ndarray, ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of references of one place and group, the two with the smallest ids: a query meets itself in one at most."""
    order = np.lexsort((ids, group, *x.T))
    same = (x[order][1:] == x[order][:-1]).all(1) & (group[order][1:] == group[order][:-1])
    return order[np.concatenate(([True, True], ~(same[1:] & same[:-1])))[: len(order)]]


def _met(r: np.ndarray, ri: np.ndarray, rg: np.ndarray, q: np.ndarray, qi: np.ndarray, qg: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and id of each query's nearest reference (inf: none within its bound); a leaf of queries meets leaves by the gap between boxes."""
    keep = _least_two(r, ri, rg)
    r, ri, rg = r[keep], ri[keep], rg[keep]
    best, who = np.where(bound < np.inf, bound * bound * (1 + 1e-9), np.inf), np.full(len(q), np.iinfo(np.int64).max)
    refs = _leaves(r, LEAF)
    low, high = np.stack([r[at].min(0) for at in refs]), np.stack([r[at].max(0) for at in refs])
    for own in _leaves(q, LEAF):
        gap = (np.maximum(0, np.maximum(low - q[own].max(0), q[own].min(0) - high)) ** 2).sum(1)
        order = np.argsort(gap, kind="stable")
        d, w = best[own], who[own]
        done, step = 0, 2
        while done < len(order) and gap[order[done]] <= d.max() * (1 + 1e-9):
            at = np.concatenate([refs[j] for j in order[done : done + step]])
            at = at[np.argsort(ri[at])]
            d2 = ((q[own][:, None, :] - r[None, at, :]) ** 2).sum(2)
            d2[(qi[own][:, None] == ri[None, at]) | ((qg[own][:, None] == rg[None, at]) & (qg[own][:, None] >= 0))] = np.inf
            b = d2.argmin(1)
            e, v = d2[np.arange(len(own)), b], ri[at][b]
            closer = (e < d) | ((e == d) & (e < np.inf) & (v < w))
            d, w = np.where(closer, e, d), np.where(closer, v, w)
            done += step
        best[own], who[own] = d, w
    return np.where(who == np.iinfo(np.int64).max, np.inf, best), who


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cell, part, role, id, g, bound, x, sorted by the first three with references (role 0) before queries: the nearest of each query's cell."""
    ref: list[tuple] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        cell, part, role, i, g, bound = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        x = _matrix(b.column(6), b.num_rows)
        cut = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), b.num_rows]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if (cell[s], part[s]) != now:
                now, ref = (cell[s], part[s]), []
            if role[s] == 0:
                ref.append((x[s:e], i[s:e], g[s:e]))
                continue
            if not ref:
                continue
            ref = [tuple(np.concatenate(c) for c in zip(*ref, strict=True))]
            d2, who = _met(*ref[0], x[s:e], i[s:e], g[s:e], bound[s:e])
            ok = np.isfinite(d2)
            yield pa.RecordBatch.from_arrays([pa.array(i[s:e][ok]), pa.array(who[ok]), pa.array(np.sqrt(d2[ok]))], names=["id", "nearest", "distance"])


def _reached(cuts: np.ndarray, base: np.ndarray, wide: int):
    """Rows id, g, x, nearest, distance, lo, hi with the cells `from` to `to` that the distance (or, without, twice as many as lo to hi) reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(2), b.num_rows)[:, wide]
            d = b.column(4).to_numpy(zero_copy_only=False).astype(float)
            lo, hi = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (5, 6))
            far = np.where(np.isnan(d), 0, d * (1 + 1e-9))
            low, high = base[np.searchsorted(cuts, v - far, "right")], base[np.searchsorted(cuts, v + far, "right") + 1] - 1
            more = np.where(np.isnan(d) & (hi >= lo), hi - lo + 1, 0)
            low, high = np.minimum(low, np.where(hi >= lo, lo - more, low)), np.maximum(high, np.where(hi >= lo, hi + more, high))
            ends = [pa.array(x.astype(np.int32)) for x in (np.maximum(low, 0), np.minimum(high, base[-1] - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns, *ends], names=[*b.schema.names, "from", "to"])

    return run


def nearest(queries: DataFrame, reference: DataFrame, apart: str | None = None) -> DataFrame:
    """(id, nearest, distance): the nearest reference of each query in `x`, by Euclid, ties to the smallest id; never itself.

    apart: a column of whole numbers from 0; references of a query's own group don't count. References are cut at quantiles of the column
    that varies most into cells of about BLOCK rows (several of them for one value that so many share). A query meets its own cell, then
    those within the distance that it has found, or twice as many cells if it has found none; so the result is exact. References with a
    null or NaN in x don't count; such queries have null nearest and distance.
    """
    group = F.col(apart).cast("long") if apart else F.lit(-1).cast("long")
    cols = lambda df: df.select(F.col("id").cast("long").alias("id"), group.alias("g"), "x")
    lacks = F.coalesce(F.exists("x", lambda c: c.isNull() | F.isnan(c)), F.lit(True))
    r, q = cols(reference).where(~lacks), cols(queries)
    lost, q = q.where(lacks), q.where(~lacks)
    none = lambda df: df.select("id", F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias("distance"))
    sides, n_refs = r.agg(F.max(F.size("x")), F.count("*")).first()
    if not n_refs:
        return none(lost).distinct()
    spread = r.agg(*[F.var_pop(F.get("x", F.lit(i))).alias(f"v{i}") for i in range(sides)]).first()
    wide, pieces = int(np.argmax([v or 0 for v in spread])), -(-n_refs // BLOCK)
    found = r.agg(F.percentile_approx(F.get("x", F.lit(wide)), [i / pieces for i in range(1, pieces)], 100 * pieces).alias("c")).first()[0] if pieces > 1 else []
    cuts, times = np.unique(np.array(found, float), return_counts=True)
    # The part from a cut on holds as many cells as there are cuts of that value.
    base = np.concatenate(([0, 1], 1 + np.cumsum(times))).astype(np.int64)
    parts = max(1, -(-q.count() // (len(found) + 1) // (4 * BLOCK)))
    state = q.selectExpr("id", "g", "x", "cast(NULL AS long) AS nearest", "cast(NULL AS double) AS distance", "0 AS lo", "-1 AS hi")
    form = "id long, g long, x array<double>, nearest long, distance double, lo int, hi int"
    reach = lambda df: df.mapInArrow(_reached(cuts, base, wide), form + ", from int, to int")
    own = reach(r.selectExpr("id", "g", "x", "id AS nearest", "cast(0 AS double) AS distance", "0 AS lo", "-1 AS hi"))
    own = own.selectExpr("cast(`from` + pmod(xxhash64(id), `to` - `from` + 1) AS int) AS cell", f"explode(sequence(0, {parts - 1})) AS part", "0 AS role", "id", "g", "cast(0 AS double) AS bound", "x")
    own = points._shared(own)
    while True:
        todo = points._shared(reach(state))
        new = "`from` < lo OR `to` > hi OR hi < lo"
        if not todo.where(new).limit(1).count():
            out = todo.where("distance IS NOT NULL").groupBy("id").agg(F.min_by("nearest", F.struct("distance", "nearest")).alias("nearest"), F.min("distance").alias("distance"))
            return out.unionByName(none(lost).join(out.select("id"), "id", "left_anti").distinct())
        go = todo.where(new).selectExpr("explode(filter(sequence(`from`, `to`), c -> c < lo OR c > hi OR hi < lo)) AS cell", f"cast(pmod(xxhash64(id), {parts}) AS int) AS part", "1 AS role", "id", "g", "coalesce(distance, double('Infinity')) AS bound", "x")
        # Only cells that queries go to are worked on.
        both = own.join(F.broadcast(go.select("cell").distinct()), "cell", "left_semi").select(go.columns).union(go).repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
        met = both.mapInArrow(_nearest, "id long, nearest long, distance double").groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("m"))
        best = F.when(F.col("distance").isNull(), F.col("m")).otherwise(F.least(F.struct("distance", "nearest"), F.coalesce("m", F.struct("distance", "nearest"))))
        state = todo.join(met, "id", "left").withColumn("b", best).selectExpr("id", "g", "x", "b.nearest AS nearest", "b.distance AS distance", "`from` AS lo", "`to` AS hi")


def _nodes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The ORDER Chebyshev nodes a side of a box, as points."""
    t = (np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER)) + 1) / 2
    return np.stack(np.meshgrid(*[a + (b - a) * t for a, b in zip(low, high, strict=True)], indexing="ij"), axis=-1).reshape(-1, len(low))


def _moments(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights at the box's nodes that stand for the points' weights w: sums of a smooth function over the points become sums over the nodes."""
    low, side = x.min(0), np.ptp(x, axis=0)
    angle = (2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER)
    steps = np.arange(ORDER)
    basis = np.cos(steps[:, None] * angle[None, :]) * np.where(steps == 0, 1, 2)[:, None] / ORDER
    out = w[:, None]
    for k in range(x.shape[1]):
        t = np.arccos(np.clip(2 * (x[:, k] - low[k]) / (side[k] or 1) - 1, -1, 1))
        out = (out[:, :, None] * (np.cos(t[:, None] * steps) @ basis)[:, None, :]).reshape(len(x), -1)
    return out.sum(0)


def _total(x: np.ndarray, w: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """Sum of w v |x - y| over all points of both, in blocks that stay in the processor's cache."""
    total, rows = 0.0, max(1, 65_536 // len(y))
    for s in range(0, len(x), rows):
        d = np.zeros((len(x[s : s + rows]), len(y)))
        for k in range(x.shape[1]):
            apart = x[s : s + rows, k, None] - y[None, :, k]
            d += np.multiply(apart, apart, out=apart)
        total += float(w[s : s + rows] @ (np.sqrt(d, out=d) @ v))
    return total


def _cells(size: int, moments: bool):
    """Rows part, cell, low, high, moments, x, w: the points x (weights w) of a partition in compact cells of at most `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0)[0].as_py(), _matrix(b.column(1), b.num_rows), b.column(2).to_numpy(zero_copy_only=False).astype(float)) for b in batches if b.num_rows]
        if not parts:
            return
        x, w = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        for i, at in enumerate(_leaves(x, size)):
            own = x[at]
            blobs = [own.min(0), own.max(0), _moments(own, w[at]) if moments else np.zeros(0), own, w[at]]
            cols = [pa.array([parts[0][0]], pa.int32()), pa.array([i], pa.int32()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in blobs]]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "cell", "low", "high", "moments", "x", "w"])

    return run


def _apart(low: np.ndarray, high: np.ndarray, i: int) -> np.ndarray:
    """Whether each cell from i on is so far from cell i that the distance between them is smooth on both."""
    gap = np.sqrt((np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:])) ** 2).sum(1))
    diagonal = np.sqrt(((high - low) ** 2).sum(1))
    return gap > FAR * np.maximum(diagonal[i:], diagonal[i])


def _far(low: np.ndarray, high: np.ndarray, moments: np.ndarray):
    """Sums between each cell (column 0) and those after it that are apart, by their moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                to = i + np.flatnonzero(_apart(low, high, i))
                own = _nodes(low[i], high[i])
                out.append(math.fsum(_total(own, moments[i], _nodes(low[j], high[j]), moments[j]) for j in to.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["total"])

    return run


def _near(sides: int):
    """Sums between the points of two cells: columns same (a cell with itself counts half), x, w, y, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for same, *blobs in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                x, w, y, v = (np.frombuffer(c) for c in blobs)
                out.append(_total(x.reshape(-1, sides), w, y.reshape(-1, sides), v) * (0.5 if same else 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["total"])

    return run


def _all_pairs(df: DataFrame, sides: int, rows: int) -> float:
    """Sum of distances over all unordered pairs of the rows of df, all finite."""
    nodes = ORDER**sides
    size = int(min(BLOCK, max(LEAST, (rows * float(nodes) ** 2 / 7) ** (1 / 3))))
    slabs = max(1, round((rows / size) ** 0.5))
    spread = df.agg(*[F.max(F.get("x", F.lit(i))) - F.min(F.get("x", F.lit(i))) for i in range(sides)]).first()
    dealt_out = df.groupBy("x").agg(F.count("*").cast("double").alias("w")).repartitionByRange(slabs, F.get("x", F.lit(int(np.argmax(spread)))))
    moments = 2 * nodes <= size
    cells = points._shared(dealt_out.select(F.spark_partition_id().alias("part"), "x", "w").mapInArrow(_cells(size, moments), "part int, cell int, low binary, high binary, moments binary, x binary, w binary"))
    found = cells.select("part", "cell", "low", "high", "moments").orderBy("part", "cell").collect()
    low, high, weights = (np.stack([np.frombuffer(r[c]) for r in found]) for c in ("low", "high", "moments"))
    spark, n, total = df.sparkSession, len(found), 0.0
    near = [i + (np.flatnonzero(~_apart(low, high, i)) if moments else np.arange(n - i)) for i in range(n)]
    if sum(map(len, near)) < n * (n + 1) // 2:
        # Dealt by turns, since the first cells have the most after them.
        tasks = -(-n // 16)
        whole = spark.range(0, n, 1, 1).repartition(tasks, F.col("id") % tasks).mapInArrow(_far(low, high, weights), "total double")
        total = math.fsum(r.total for r in whole.collect())
    pairs = pa.table({"i": np.repeat(np.arange(n), [len(x) for x in near]), "j": np.concatenate(near)})
    mine = [(i, r.part, r.cell) for i, r in enumerate(found)]
    named = cells.join(F.broadcast(spark.createDataFrame(mine, "i long, part int, cell int")), ["part", "cell"]).select("i", "x", "w")
    both = spark.createDataFrame(pairs).join(named, "i").join(named.selectExpr("i AS j", "x AS y", "w AS v"), "j")
    tasks = -(-pairs.num_rows // 64)
    met = both.selectExpr("i = j AS same", "x", "w", "y", "v").repartition(tasks).mapInArrow(_near(sides), "total double")
    return math.fsum([total, *(r.total for r in met.collect())])


def mean_distance(df: DataFrame) -> DataFrame:
    """One row: mean distance in `x` over all ordered pairs of rows with different ids, total / (n (n - 1)); null without such pairs.

    Every pair counts. Rows are gathered in compact cells: pairs of points in cells that lie apart are summed by the cells' moments at
    Chebyshev nodes (to about 1e-10 of the mean), all others one by one. Rows with a null in x or id don't count.
    """
    own = points._shared(df.where("id IS NOT NULL").where(~F.coalesce(F.exists("x", lambda c: c.isNull()), F.lit(True))).select("id", "x"))
    sides, rows = own.agg(F.max(F.size("x")), F.count("*")).first()
    apart = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, x: s + x))
    repeated = own.groupBy("id").agg(F.count("*").alias("m")).where("m > 1")
    squares = rows + (repeated.agg(F.sum(F.col("m") * (F.col("m") - 1))).first()[0] or 0)
    count, mean = rows * rows - squares, None
    if count:
        odd = own.where(F.exists("x", lambda c: F.isnan(c) | (F.abs(c) == float("inf"))))
        if odd.limit(1).count():
            mean = odd.crossJoin(own.selectExpr("id AS j", "x AS y")).where("id <> j").agg(F.avg(apart)).first()[0]
        else:
            total = 2 * _all_pairs(own, sides, rows)
            if squares > rows:
                some = own.join(repeated, "id")
                total -= some.join(some.selectExpr("id", "x AS y"), "id").agg(F.sum(apart)).first()[0]
            mean = total / count
    return df.sparkSession.createDataFrame([(mean,)], "mean double")


def dissimilarity(distance: Column, mean: Column) -> Column:
    """Dissimilarity index: distance over the mean distance of the training rows."""
    return distance / mean


def upper_fence(df: DataFrame, value: str) -> DataFrame:
    """One row: the largest value that isn't over Q3 + 1.5 IQR."""
    fence = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select((F.get("q", F.lit(1)) * 2.5 - F.get("q", F.lit(0)) * 1.5).alias("_f"))
    return df.crossJoin(F.broadcast(fence)).where(F.col(value) <= F.col("_f")).agg(F.max(value).alias("threshold"))


def mask_sensitivity(df: DataFrame, di: str, thresholds: dict[str, float], mask: Column) -> DataFrame:
    """(rule, threshold, inside, inside_masked, slope): parts of the rows under each threshold, in all and among the masked, and the part a hundredth of di adds."""
    specs = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(float(v)).alias("threshold")) for k, v in thresholds.items()])
    own = df.withColumn("s", F.explode(specs)).select(di, mask.alias("_m"), "s.*")
    hit = (F.col(di) <= F.col("threshold")).cast("double")
    more = (F.col(di) <= F.col("threshold") + 0.01).cast("double")
    return own.groupBy("rule", "threshold").agg(F.avg(hit).alias("inside"), F.avg(F.when(F.col("_m"), hit)).alias("inside_masked"), (F.avg(more) - F.avg(hit)).alias("slope"))
