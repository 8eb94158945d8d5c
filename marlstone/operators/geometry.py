"""Geometry on points, segments, rings and grids as column expressions and joins."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import frame
from ..plans.storage import stored
from .corpus import table

# Metres a degree, along the equator and along a meridian.
EAST, NORTH = 111320.0, 110574.0


def projected(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and south of (lat0, lon0), equirectangular."""
    return (lon - lon0) * (EAST * math.cos(math.radians(lat0))), (F.lit(lat0) - lat) * NORTH


def unprojected(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Latitude and longitude of metres east and south: the inverse."""
    return F.lit(lat0) - y / NORTH, x / (EAST * math.cos(math.radians(lat0))) + lon0


def coordinates(spark: SparkSession, sf_dir: str, n: int, scale: float) -> DataFrame:
    """(vec_id, label, c0 ...): the first components of each vector; short vectors give nulls."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.get("embedding", F.lit(i)).cast("double") * scale).alias(f"c{i}") for i in range(n)])


@frame("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE / 100 + 28.6 AS lat, embedding[2]::DOUBLE / 100 + 77.2 AS lon FROM embeddings), m AS (SELECT *, (lon - 77.2) * 111320.0 * cos(radians(28.6)) AS x, (28.6 - lat) * 110574.0 AS y FROM p)
SELECT vec_id, round(x, 3) AS x, round(y, 3) AS y, floor(x / 10)::BIGINT AS cx, floor(y / 10)::BIGINT AS cy, round(lat, 9) AS lat, round(lon, 9) AS lon FROM m""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres around the middle of the box, the cell of ten metres, and the way back to latitude and longitude."""
    v = coordinates(spark, sf_dir, 2, 0.01)
    x, y = projected(F.col("c0") + 28.6, F.col("c1") + 77.2, 28.6, 77.2)
    found = v.select("vec_id", x.alias("x"), y.alias("y"))
    lat, lon = unprojected(F.col("x"), F.col("y"), 28.6, 77.2)
    cell = lambda c: F.floor(F.col(c) / 10).cast("long")
    return found.select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), cell("x").alias("cx"), cell("y").alias("cy"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


def crossings(a: Column, b: Column) -> Column:
    """Where, from 0 to 1 along the way from a to b, whole numbers are crossed."""
    low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
    return F.when((a != b) & (low <= high), F.transform(F.sequence(low, high), lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))


def segment_cells(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The grid cells (x, y) that a segment passes, in order: one for each stretch between crossings of the grid's lines,
    named by the stretch's middle."""
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings(x0, x1), crossings(y0, y1))))
    middles = F.when((x0 == x1) & (y0 == y1), F.array(F.lit(0.0))).otherwise(F.transform(F.slice(cuts, F.lit(2), F.size(cuts)), lambda t, i: (t + F.get(cuts, i)) / 2))
    return F.transform(middles, lambda t: F.struct(F.floor(x0 + t * (x1 - x0)).cast("int").alias("x"), F.floor(y0 + t * (y1 - y0)).cast("int").alias("y")))


SEGMENT_SQL = "v AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x0, embedding[2]::DOUBLE * 100 AS y0, embedding[3]::DOUBLE * 100 AS x1, embedding[4]::DOUBLE * 100 AS y1 FROM embeddings)"


@frame(f"""
WITH {SEGMENT_SQL}, c AS (SELECT vec_id, x0, y0, x1, y1, unnest(range(floor(least(x0, x1))::INT, floor(greatest(x0, x1))::INT + 1)) AS x FROM v),
s AS (SELECT vec_id, x, CASE WHEN x1 = x0 THEN y0 ELSE y0 + (greatest(least(x0, x1), x) - x0) / (x1 - x0) * (y1 - y0) END AS ya, CASE WHEN x1 = x0 THEN y1 ELSE y0 + (least(greatest(x0, x1), x + 1) - x0) / (x1 - x0) * (y1 - y0) END AS yb FROM c)
SELECT vec_id, x::INT AS x, unnest(range(floor(least(ya, yb))::INT, floor(greatest(ya, yb))::INT + 1))::INT AS y FROM s""")
def polyline_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells of the segment from each vector's first two components to its next two, a hundred cells to a unit."""
    cells = segment_cells(*(F.col(f"c{i}") for i in range(4)))
    return coordinates(spark, sf_dir, 4, 100.0).dropna().select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.x", "c.y").distinct()


def clipped(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """(a, b): the part, from 0 to 1, of a segment inside a box (left, top, right, bottom); null if there is none. Each axis
    allows an interval of the way; the part is what all allow."""

    def allowed(p: Column, q: Column, low: float, high: float) -> tuple[Column, Column]:
        one, two = (F.lit(low) - p) / F.nullif(q - p, F.lit(0.0)), (F.lit(high) - p) / F.nullif(q - p, F.lit(0.0))
        inside = F.when((p >= low) & (p <= high), F.lit(0.0)).otherwise(F.lit(2.0))
        return F.coalesce(F.least(one, two), inside), F.coalesce(F.greatest(one, two), F.lit(1.0))

    (ax, bx), (ay, by) = allowed(x0, x1, box[0], box[2]), allowed(y0, y1, box[1], box[3])
    a, b = F.greatest(F.lit(0.0), ax, ay), F.least(F.lit(1.0), bx, by)
    return F.when(a <= b, F.struct(a.alias("a"), b.alias("b")))


@frame(f"""
WITH {SEGMENT_SQL}, t AS (SELECT vec_id, x0, y0, x1, y1, [0.0, 1.0] || CASE WHEN x1 <> x0 THEN [(-5 - x0) / (x1 - x0), (5 - x0) / (x1 - x0)] ELSE [] END || CASE WHEN y1 <> y0 THEN [(-5 - y0) / (y1 - y0), (5 - y0) / (y1 - y0)] ELSE [] END AS ts FROM v),
i AS (SELECT vec_id, list_filter(ts, lambda t: t >= 0 AND t <= 1 AND abs(x0 + t * (x1 - x0)) <= 5 + 1e-9 AND abs(y0 + t * (y1 - y0)) <= 5 + 1e-9) AS ok FROM t)
SELECT vec_id, round(list_min(ok), 6) AS a, round(list_max(ok), 6) AS b FROM i WHERE len(ok) > 0""")
def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each vector's segment inside a box of ten cells."""
    part = clipped(*(F.col(f"c{i}") for i in range(4)), (-5.0, -5.0, 5.0, 5.0))
    return coordinates(spark, sf_dir, 4, 100.0).dropna().select("vec_id", part.alias("p")).where("p is not null").select("vec_id", F.round("p.a", 6).alias("a"), F.round("p.b", 6).alias("b"))


def edges_of(points: DataFrame, ring: str, order: str) -> DataFrame:
    """(ring, x, y, x2, y2): each point of a ring with the next, the last with the first."""
    w = Window.partitionBy(ring).orderBy(order)
    first = lambda c: F.first(c).over(Window.partitionBy(ring).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return points.select(ring, order, "x", "y", F.coalesce(F.lead("x").over(w), first("x")).alias("x2"), F.coalesce(F.lead("y").over(w), first("y")).alias("y2"))


def ring_cells(edges: DataFrame, ring: str) -> DataFrame:
    """(ring, x, y): cells whose centre lies inside a ring by the even-odd rule. On each row of cells, the edges that cross
    its middle are put in order; cells between an odd crossing and the next are inside."""
    low, high = F.ceil(F.least("y", "y2") - 0.5), F.ceil(F.greatest("y", "y2") - 0.5) - 1
    rows = edges.where(low <= high).select(ring, "x", "y", "x2", "y2", F.explode(F.sequence(low, high)).alias("row"))
    cut = F.col("x") + (F.col("row") + 0.5 - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    cuts = rows.groupBy(ring, "row").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("cuts") / 2).cast("int")), lambda i: F.struct(F.ceil(F.get("cuts", i * 2 - 2) - 0.5).alias("a"), (F.ceil(F.get("cuts", i * 2 - 1) - 0.5) - 1).alias("b")))
    spans = cuts.where("size(cuts) > 1").select(ring, "row", F.explode(pairs).alias("p")).where("p.a <= p.b")
    return spans.select(ring, F.explode(F.sequence("p.a", "p.b")).alias("x"), "row").select(ring, F.col("x").cast("int").alias("x"), F.col("row").cast("int").alias("y"))


def label_rings(spark: SparkSession, sf_dir: str, scale: float) -> DataFrame:
    """Each label's vectors as a ring in order of their ids."""
    return edges_of(coordinates(spark, sf_dir, 2, scale).select("label", "vec_id", F.col("c0").alias("x"), F.col("c1").alias("y")).dropna(), "label", "vec_id")


RING_SQL = """
v AS (SELECT label, vec_id, embedding[1]::DOUBLE * SCALE AS x, embedding[2]::DOUBLE * SCALE AS y FROM embeddings),
e AS (SELECT label, vec_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""


@frame(f"""
WITH {RING_SQL.replace('SCALE', '40')}, box AS (SELECT label, floor(min(x))::INT AS x0, ceil(max(x))::INT AS x1, floor(min(y))::INT AS y0, ceil(max(y))::INT AS y1 FROM v GROUP BY label),
c AS (SELECT label, x, unnest(range(y0, y1)) AS y FROM (SELECT label, unnest(range(x0, x1)) AS x, y0, y1 FROM box) b)
SELECT c.label, c.x::INT AS x, c.y::INT AS y FROM c JOIN e ON c.label = e.label WHERE (e.y <= c.y + 0.5) <> (e.y2 <= c.y + 0.5) AND c.x + 0.5 < e.x + (c.y + 0.5 - e.y) * (e.x2 - e.x) / (e.y2 - e.y) GROUP BY c.label, c.x, c.y HAVING count(*) % 2 = 1""")
def filled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells inside the ring that each label's vectors make, forty cells to a unit."""
    return ring_cells(label_rings(spark, sf_dir, 40.0), "label")


def ring_measures(edges: DataFrame, ring: str) -> DataFrame:
    """(ring, points, area, mean of the corners, box)."""
    area = F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2
    box = [f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"))]
    return edges.groupBy(ring).agg(F.count(F.lit(1)).alias("points"), area.alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), *box)


@frame(f"""
WITH {RING_SQL.replace('SCALE', '1')} SELECT label, count(*) AS points, round(abs(sum((x2 - x) * (y2 + y))) / 2, 6) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM e GROUP BY label""")
def shoelace_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centre and box of the ring that all of a label's vectors make."""
    found = ring_measures(label_rings(spark, sf_dir, 1.0), "label")
    return found.select("label", "points", *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy", "x0", "y0", "x1", "y1")])


def closed_rings(ways: list[list[int]]) -> list[list[int]]:
    """Rings of way fragments, as a walk over the graph of their end nodes: each way joins two; from the least unused way on,
    the walk leaves each node by the least way that is left. What comes back to its start with three nodes or more is a ring."""
    ways = [list(w) for w in ways if w]
    at: dict[int, set[int]] = {}
    for k, w in enumerate(ways):
        for end in (w[0], w[-1]):
            at.setdefault(end, set()).add(k)
    unused, rings = set(range(len(ways))), []
    for begin in range(len(ways)):
        if begin not in unused:
            continue
        path, taken = list(ways[begin]), [begin]
        unused.discard(begin)
        while path[0] != path[-1] and (left := at[path[-1]] & unused):
            k = min(left)
            unused.discard(k)
            taken.append(k)
            path.extend(ways[k][1:] if ways[k][0] == path[-1] else ways[k][-2::-1])
        if path[0] == path[-1] and len(path) > 3:
            rings.append(path)
    return rings


def assembled(members: DataFrame) -> DataFrame:
    """(relation, ring, nodes) of ``members`` (relation, way, nodes): rings of a relation's ways; one task a relation."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = closed_rings([list(x) for x in pdf.sort_values("way")["nodes"]])
        return pd.DataFrame({"relation": [pdf["relation"].iloc[0]] * len(rings), "ring": range(len(rings)), "nodes": rings}).astype({"ring": "int32"})

    return members.groupBy("relation").applyInPandas(join, f"relation {members.schema['relation'].dataType.simpleString()}, ring int, nodes {members.schema['nodes'].dataType.simpleString()}")


@frame("SELECT n_regionkey AS relation, 0 AS ring, count(*) + 1 AS nodes FROM nation GROUP BY n_regionkey")
def region_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region in a circle, as ways of two nodes in any direction, assembled to one ring a region."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    each = table(spark, sf_dir, "nation").withColumn("next", F.coalesce(F.lead("n_nationkey").over(w), F.first("n_nationkey").over(w)))
    turned = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_nationkey", "next")).otherwise(F.array("next", "n_nationkey"))
    ways = each.select(F.col("n_regionkey").alias("relation"), F.col("n_nationkey").alias("way"), turned.alias("nodes"))
    return assembled(ways).select("relation", "ring", F.size("nodes").cast("long").alias("nodes"))


def grid_edges(cells: DataFrame, metres: float = 10.0) -> DataFrame:
    """(u, v, cost) between neighbours of ``cells`` (node, x, y, cost a metre; null is impassable), also across corners, but
    only where both cells beside the corner may be passed. A step costs its length times the mean of both cells' costs."""
    free = cells.where("cost is not null")
    beside = free.select("x", "y")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    moves = free.select("node", "x", "y", "cost", F.explode(steps).alias("d")).select(F.col("node").alias("u"), "cost", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    to = free.select("x", "y", F.col("node").alias("v"), F.col("cost").alias("there"))
    found = moves.join(to, ["x", "y"])
    slanted = (F.col("x") != F.col("ox")) & (F.col("y") != F.col("oy"))
    for a, b in (("ox", "y"), ("x", "oy")):  # the cells beside the corner
        side = beside.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(True).alias("fine"))
        found = found.join(side, (F.col(a) == F.col("sx")) & (F.col(b) == F.col("sy")), "left").where(~slanted | F.col("fine")).drop("sx", "sy", "fine")
    long = F.when(slanted, F.lit(metres * math.sqrt(2))).otherwise(F.lit(metres))
    return found.select("u", "v", (long * (F.col("cost") + F.col("there")) / 2).alias("cost"), long.alias("metres"))


def walks(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, cost, metres): the cheapest way from each of ``starts`` (start) to each node it reaches, over ``edges``
    (u, v, cost, metres), and its length. Rounds relax the edges of what got cheaper, from all starts at once, until
    nothing does; costs are to be above zero."""
    edges = stored(edges, "walk-edges")
    first = starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("metres"))
    known = fresh = stored(first, "walks")
    while True:
        step = fresh.join(edges.withColumnsRenamed({"cost": "more", "metres": "length"}), fresh["node"] == edges["u"]).select("start", F.col("v").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), (F.col("metres") + F.col("length")).alias("metres"))
        least = lambda df: df.groupBy("start", "node").agg(F.min(F.struct("cost", "metres")).alias("b")).select("start", "node", "b.*")
        old = known.select("start", "node", F.col("cost").alias("had"))
        fresh = stored(least(step).join(old, ["start", "node"], "left").where("had is null or cost < had - 1e-9").select("start", "node", "cost", "metres"), "walks")
        if not fresh.limit(1).count():
            return known
        known = stored(least(known.unionByName(fresh)), "walks")


def nation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as five rows of five cells; a name's length is a cell's cost, and every seventh nation from the fourth on is impassable."""
    key, long = F.col("n_nationkey"), F.length("n_name").cast("double")
    return table(spark, sf_dir, "nation").select(key.alias("node"), (key % 5).alias("x"), F.floor(key / 5).cast("int").alias("y"), F.when(key % 7 != 3, long).alias("cost"))


GRID_SQL = """
g AS (SELECT n_nationkey AS node, n_nationkey % 5 AS x, n_nationkey // 5 AS y, length(n_name)::DOUBLE AS cost FROM nation WHERE n_nationkey % 7 <> 3),
edge AS (SELECT a.node AS u, b.node AS v, CASE WHEN a.x <> b.x AND a.y <> b.y THEN 10 * sqrt(2) ELSE 10 END AS m, (a.cost + b.cost) / 2 AS c FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.node <> b.node
  WHERE (a.x = b.x OR a.y = b.y) OR (EXISTS (SELECT 1 FROM g s WHERE s.x = a.x AND s.y = b.y) AND EXISTS (SELECT 1 FROM g s WHERE s.x = b.x AND s.y = a.y))),
dist AS (SELECT a.node AS u, b.node AS v, CASE WHEN a.node = b.node THEN 0.0 ELSE coalesce((SELECT m * c FROM edge e WHERE e.u = a.node AND e.v = b.node), 1e9) END AS d FROM g a, g b)"""


def doubled(n: int) -> str:
    """Least costs over up to 2 ** n steps, by squaring n times."""
    steps = [f"d{i + 1} AS (SELECT a.u, b.v, min(a.d + b.d) AS d FROM {'dist' if not i else f'd{i}'} a JOIN {'dist' if not i else f'd{i}'} b ON a.v = b.u GROUP BY a.u, b.v)" for i in range(n)]
    return ", ".join(steps)


@frame(f"WITH {GRID_SQL}, {doubled(5)} SELECT u::INT AS start, v::INT AS node, round(d, 6) AS cost FROM d5 WHERE d < 1e8")
def grid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest ways between all cells of a grid, without cutting corners."""
    grid = stored(nation_grid(spark, sf_dir), "grid")
    found = walks(grid_edges(grid), grid.where("cost is not null").select(F.col("node").alias("start")))
    return found.select(F.col("start").cast("int").alias("start"), F.col("node").cast("int").alias("node"), F.round("cost", 6).alias("cost"))


@frame(f"""
WITH {GRID_SQL.replace('length(n_name)::DOUBLE AS cost', '1.0 AS cost')}, {doubled(5)}
SELECT u::INT AS first, v::INT AS second, greatest(1, round(d / 75))::INT AS minutes FROM d5 WHERE u < v AND d < 1e8""")
def walk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes on foot between all pairs of cells that can be reached, at 75 metres a minute and one minute at least."""
    grid = stored(nation_grid(spark, sf_dir).withColumn("cost", F.when(F.col("cost").isNotNull(), F.lit(1.0))), "grid")
    found = walks(grid_edges(grid), grid.where("cost is not null").select(F.col("node").alias("start"))).where("start < node")
    return found.select(F.col("start").cast("int").alias("first"), F.col("node").cast("int").alias("second"), F.greatest(F.lit(1), F.round(F.col("metres") / 75)).cast("int").alias("minutes"))


def snapped(points: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """``points`` (point, x, y) with the nearest passable cell (cx, cy, distance) among those up to ``reach`` cells away, ties
    to the lesser (cy, cx); null if none is. Each point asks for the cells around it by key, so that no pair is tried in vain."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    own = points.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).withColumn("cx", (F.floor("x") + F.col("dx")).cast("int")).withColumn("cy", (F.floor("y") + F.col("dy")).cast("int"))
    free = cells.select(F.col("x").cast("int").alias("cx"), F.col("y").cast("int").alias("cy")).distinct()
    far = F.sqrt(F.pow(F.col("cx") + 0.5 - F.col("x"), 2) + F.pow(F.col("cy") + 0.5 - F.col("y"), 2))
    best = own.join(free, ["cx", "cy"]).groupBy("point").agg(F.min(F.struct(F.round(far, 9).alias("distance"), "cy", "cx")).alias("b"))
    return points.join(best, "point", "left").select("point", "x", "y", F.col("b.cx").alias("cx"), F.col("b.cy").alias("cy"), F.col("b.distance").alias("distance"))


@frame("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 4 + 2 AS x, embedding[2]::DOUBLE * 4 + 2 AS y FROM embeddings), g AS (SELECT n_nationkey % 5 AS cx, n_nationkey // 5 AS cy FROM nation WHERE n_nationkey % 7 <> 3),
d AS (SELECT vec_id, cx, cy, round(sqrt((cx + 0.5 - x) ** 2 + (cy + 0.5 - y) ** 2), 9) AS distance FROM p JOIN g ON abs(cx - floor(x)) <= 2 AND abs(cy - floor(y)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cy, cx) AS n FROM d)
SELECT p.vec_id, r.cx::INT AS cx, r.cy::INT AS cy, round(r.distance, 6) AS distance FROM p LEFT JOIN r ON p.vec_id = r.vec_id AND n = 1""")
def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest passable cell of the nations' grid to each vector's first two components, up to two cells away."""
    points = coordinates(spark, sf_dir, 2, 4.0).select(F.col("vec_id").alias("point"), (F.col("c0") + 2).alias("x"), (F.col("c1") + 2).alias("y"))
    found = snapped(points, nation_grid(spark, sf_dir).where("cost is not null"), 2)
    return found.select(F.col("point").alias("vec_id"), "cx", "cy", F.round("distance", 6).alias("distance"))
