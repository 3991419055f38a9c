"""Overlay of points, lines and cells: bounding boxes are dealt to tiles, tiles are equi-joined, exact tests follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def tiles(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """The (tx, ty) tiles that a box touches, as an array; a box wider than a tile touches several."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(x1, x2), lambda x: F.transform(span(y1, y2), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def points_in_cells(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``points`` (lon, lat, ...) with the cell_id of the box cell (x1, y1, x2, y2) that holds them; lower bounds are inside."""
    p = points.withColumn("tx", F.floor(F.col("lon") / size)).withColumn("ty", F.floor(F.col("lat") / size))
    c = cells.select("cell_id", "x1", "y1", "x2", "y2", F.explode(tiles(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)).alias("t")).select("*", "t.tx", "t.ty").drop("t")
    j = p.join(c, ["tx", "ty"]).where("lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2")
    return j.drop("tx", "ty", "x1", "y1", "x2", "y2")


def edges_in_cells(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(edge columns, cell_id, t0, t1): the part of each edge inside each box cell, as shares of the edge.

    Liang-Barsky clipping as an expression; a point contact gives no part. A pair is found in one tile only: that of the
    lower left corner of the overlap of the two boxes, so no distinct is needed.
    """
    lo = lambda a, b: F.least(F.col(a), F.col(b))
    hi = lambda a, b: F.greatest(F.col(a), F.col(b))
    e = edges.withColumn("t", F.explode(tiles(lo("lon1", "lon2"), lo("lat1", "lat2"), hi("lon1", "lon2"), hi("lat1", "lat2"), size)))
    c = cells.select("cell_id", "x1", "y1", "x2", "y2", F.explode(tiles(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)).alias("t"))
    j = e.join(c, "t")
    owner = (F.col("t.tx") == F.floor(F.greatest(F.col("x1"), lo("lon1", "lon2")) / size)) & (F.col("t.ty") == F.floor(F.greatest(F.col("y1"), lo("lat1", "lat2")) / size))
    j = j.where(owner)
    t0, t1 = clip_to_box(*[F.col(x) for x in ("lon1", "lat1", "lon2", "lat2", "x1", "y1", "x2", "y2")])
    return j.withColumn("t0", t0).withColumn("t1", t1).where("t0 < t1").drop("t", "x1", "y1", "x2", "y2")


def clip_to_box(lon1: Column, lat1: Column, lon2: Column, lat2: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(t0, t1): the part of an edge inside a box as shares of the edge, t0 < t1 if there is one. Edges along a lower bound are inside."""
    dx, dy = lon2 - lon1, lat2 - lat1

    def bound(d: Column, at: Column, low: Column, high: Column, entering: bool) -> Column:
        near = F.when(d > 0, (low - at) / d).when(d < 0, (high - at) / d)
        far = F.when(d > 0, (high - at) / d).when(d < 0, (low - at) / d)
        inside = (at >= low) & (at < high)
        return F.coalesce(near if entering else far, F.when(inside, 0.0 if entering else 1.0).otherwise(2.0 if entering else -1.0))

    t0 = F.greatest(F.lit(0.0), bound(dx, lon1, x1, x2, True), bound(dy, lat1, y1, y2, True))
    t1 = F.least(F.lit(1.0), bound(dx, lon1, x1, x2, False), bound(dy, lat1, y1, y2, False))
    return t0, t1


XY = ("lon1", "lat1", "lon2", "lat2")


def _dealt(d: DataFrame, p: str, size: float) -> DataFrame:
    """The different edges of ``d`` with their tiles; columns begin with ``p``."""
    box = [F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2")]
    return d.select(*XY).distinct().select(*[F.col(c).alias(p + c) for c in XY], F.explode(tiles(*box, size)).alias("t"))


def _crossed_shapes(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_lon1 ... a_lat2, b_lon1 ... b_lat2, u, lon, lat): the ``crossings`` of the different edges, however many lines they are part of."""
    j = _dealt(a, "a_", size).join(_dealt(b, "b_", size), "t")
    rx, ry = F.col("a_lon2") - F.col("a_lon1"), F.col("a_lat2") - F.col("a_lat1")
    sx, sy = F.col("b_lon2") - F.col("b_lon1"), F.col("b_lat2") - F.col("b_lat1")
    qx, qy = F.col("b_lon1") - F.col("a_lon1"), F.col("b_lat1") - F.col("a_lat1")
    cross = rx * sy - ry * sx
    some = F.nullif(cross, F.lit(0.0))  # parallel edges have no share
    u, v = (qx * sy - qy * sx) / some, (qx * ry - qy * rx) / some
    j = j.where(cross != 0).withColumn("u", u).withColumn("v", v).where("u > 0 AND u < 1 AND v > 0 AND v < 1")
    j = j.withColumn("lon", F.col("a_lon1") + F.col("u") * rx).withColumn("lat", F.col("a_lat1") + F.col("u") * ry)
    own = (F.col("t.tx") == F.floor(F.col("lon") / size)) & (F.col("t.ty") == F.floor(F.col("lat") / size))
    return j.where(own).drop("t", "v")


def _named(d: DataFrame, p: str) -> DataFrame:
    return d.select(*[F.col(c).alias(p + c) for c in ("line", "pos", *XY)])


def crossings(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_line, a_pos, b_line, b_pos, u, lon, lat): proper crossings of edges of ``a`` and ``b``, found in their shared tiles; u is the share of a's edge.

    Edges that many lines have in common are crossed once; the lines' names are joined to what is found.
    """
    keys = lambda p: [p + c for c in XY]
    found = _crossed_shapes(a, b, size).join(_named(a, "a_"), keys("a_")).join(_named(b, "b_"), keys("b_"))
    return found.select("a_line", "a_pos", "b_line", "b_pos", "u", "lon", "lat")


def ordered_crossings(a: DataFrame, b: DataFrame, size: float, digits: int) -> DataFrame:
    """(a_line, a_pos, b_line, b_pos, nth): the ``crossings`` of each edge of ``a`` numbered by (u rounded to ``digits``, b_line, b_pos).

    The order is that of the edge's place: it is found once for all lines that share the edge.
    """
    keys = lambda p: [p + c for c in XY]
    w = Window.partitionBy(*keys("a_")).orderBy(F.round("u", digits), "b_line", "b_pos")
    met = _crossed_shapes(a, b, size).join(_named(b, "b_"), keys("b_")).select(*keys("a_"), "b_line", "b_pos", F.row_number().over(w).cast("long").alias("nth"))
    return met.join(_named(a, "a_"), keys("a_")).select("a_line", "a_pos", "b_line", "b_pos", "nth")


def within(points: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """``points`` with the ``others`` (other, lon, lat) at ``metres`` or less: other, distance.

    Cartesian tiles as wide as the radius, so poles and the date line are no special cases: each point is in one tile,
    each other in its own and the 26 around it, and a pair meets once.
    """

    def tile(lon: Column, lat: Column, offsets: list[tuple[int, int, int]]) -> Column:
        x, y, z = [F.floor(c * (geo.RADIUS / (metres * 1.001))) for c in geo.unit_xyz(lon, lat)]
        return F.explode(F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y"), (z + k).alias("z")) for i, j, k in offsets]))

    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    p = points.withColumn("__tile", tile(F.col("lon"), F.col("lat"), [(0, 0, 0)]))
    o = others.select("other", F.col("lon").alias("__lon"), F.col("lat").alias("__lat"), tile(F.col("lon"), F.col("lat"), around).alias("__tile"))
    d = p.join(o, "__tile").withColumn("distance", geo.haversine(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat")))
    return d.where(F.col("distance") <= metres).drop("__tile", "__lon", "__lat")


def snap(points: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """(id, other): each point (id, lon, lat) with the first of the ``others`` within ``metres``, by the order of ``other``."""
    return within(points, others, metres).groupBy("id").agg(F.min("other").alias("other"))


def erase_loops(cells: Column) -> Column:
    """An array of cells without what lies between the first and the last visit of a cell, walked from the start."""
    n = F.size(cells)

    def step(s: Column, i: Column) -> Column:
        here = F.get(cells, i)
        onward = (n - F.array_position(F.reverse(cells), here) + 1).cast("int")
        return F.when(i == s["next"], F.struct(onward.alias("next"), F.concat(s["out"], F.array(here)).alias("out"))).otherwise(s)

    start = F.struct(F.lit(0).alias("next"), F.slice(cells, 1, 0).alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])).otherwise(cells)


def burn(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell_id, segment, stream_order, downstream): attributes of the last edge (by ``pos``) that leaves a cell's centre; -1 where none does."""
    at = cells.select("cell_id", geo.vertex_key(F.col("lon"), F.col("lat")).alias("__key"))
    e = edges.withColumn("__key", geo.vertex_key(F.col("lon1"), F.col("lat1"))).join(at, "__key").drop("__key")
    end = at.withColumnRenamed("cell_id", "__down")
    e = e.withColumn("__key", geo.vertex_key(F.col("lon2"), F.col("lat2"))).join(end, "__key", "left")
    last = e.groupBy("cell_id").agg(F.max_by(F.struct("segment", "stream_order", "__down"), "pos").alias("v"))
    value = lambda c: F.coalesce(F.col("v")[c], F.lit(-1)).cast("long")
    return cells.select("cell_id").join(last, "cell_id", "left").select("cell_id", value("segment").alias("segment"), value("stream_order").alias("stream_order"), value("__down").alias("downstream"))


def ring_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """(x1, y1, x2, y2) of an array of (lon, lat) structs."""
    x, y = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def ring_sides(ring: Column, lon: Column, lat: Column) -> Column:
    """For each side of a convex ring (either way round) how far inside of it the point lies: below 0 is outside, 0 on the side."""
    n = F.size(ring)
    nxt = lambda i: F.element_at(ring, F.pmod(i + 1, n) + 1)
    turn = F.aggregate(F.transform(ring, lambda p, i: p["lon"] * nxt(i)["lat"] - nxt(i)["lon"] * p["lat"]), F.lit(0.0), lambda a, x: a + x)
    way = F.when(turn < 0, -1.0).otherwise(1.0)
    return F.transform(ring, lambda p, i: way * ((nxt(i)["lon"] - p["lon"]) * (lat - p["lat"]) - (nxt(i)["lat"] - p["lat"]) * (lon - p["lon"])))


def half_planes(ring: Column, turn: Column) -> Column:
    """(x, y, ex, ey) of each side of a convex ring: ex * (lat - y) - ey * (lon - x) is how far inside of it a place lies. ``turn`` is the ring's ``winding``."""
    n = F.size(ring)
    way = F.when(turn < 0, -1.0).otherwise(1.0)

    def side(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.pmod(i + 1, n) + 1)
        return F.struct(p["lon"].alias("x"), p["lat"].alias("y"), (way * (q["lon"] - p["lon"])).alias("ex"), (way * (q["lat"] - p["lat"])).alias("ey"))

    return F.transform(ring, side)


def winding(ring: Column) -> Column:
    """Twice the signed area of a ring in square degrees: above 0 if it runs counterclockwise."""
    n = F.size(ring)
    nxt = lambda i: F.element_at(ring, F.pmod(i + 1, n) + 1)
    return F.aggregate(F.transform(ring, lambda p, i: p["lon"] * nxt(i)["lat"] - nxt(i)["lon"] * p["lat"]), F.lit(0.0), lambda a, x: a + x)


def clip_to_planes(lon1: Column, lat1: Column, lon2: Column, lat2: Column, planes: Column) -> Column:
    """(t0, t1, enters, leaves): the part of an edge inside a convex ring's ``half_planes`` as shares of the edge, t0 > t1 if there is none.

    enters and leaves are the sides of the ring (from 0) through which the edge comes and goes, -1 where it ends inside.
    A touch is a part without length.
    """
    inside = lambda s, lon, lat: s["ex"] * (lat - s["y"]) - s["ey"] * (lon - s["x"])
    sides = F.transform(planes, lambda s: F.struct(inside(s, lon1, lat1).alias("a"), inside(s, lon2, lat2).alias("b")))

    def side(s: Column, x: Column) -> Column:
        i, a, b = s["i"], x["a"], x["b"]
        at = a / (a - b)
        enters, leaves = (a < 0) & (b >= 0), (a >= 0) & (b < 0)
        later, sooner = enters & (at > s["t0"]), leaves & (at < s["t1"])
        out = (a < 0) & (b < 0)
        return F.struct(
            (i + 1).alias("i"),
            F.when(out, 2.0).when(enters, F.greatest(s["t0"], at)).otherwise(s["t0"]).alias("t0"),
            F.when(leaves, F.least(s["t1"], at)).otherwise(s["t1"]).alias("t1"),
            F.when(later, i).otherwise(s["enters"]).alias("enters"),
            F.when(sooner, i).otherwise(s["leaves"]).alias("leaves"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(-1).alias("enters"), F.lit(-1).alias("leaves"))
    return F.aggregate(sides, start, side, lambda s: F.struct(s["t0"].alias("t0"), s["t1"].alias("t1"), s["enters"].alias("enters"), s["leaves"].alias("leaves")))


def _met(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``edges`` joined to the ``cells`` (box in __x1 to __y2) whose boxes they meet, each pair once.

    Edges and cells are dealt to tiles of ``size``; a pair is tested in the tile of the lower left corner of their boxes' overlap only.
    """
    low, high = (lambda a, b: F.least(F.col(a), F.col(b))), (lambda a, b: F.greatest(F.col(a), F.col(b)))
    box = low("lon1", "lon2"), low("lat1", "lat2"), high("lon1", "lon2"), high("lat1", "lat2")
    e = edges.withColumn("__t", F.explode(tiles(*box, size)))
    c = cells.withColumn("__t", F.explode(tiles(F.col("__x1"), F.col("__y1"), F.col("__x2"), F.col("__y2"), size)))
    j = e.join(c, "__t").where((box[0] <= F.col("__x2")) & (box[2] >= F.col("__x1")) & (box[1] <= F.col("__y2")) & (box[3] >= F.col("__y1")))
    j = j.where((F.col("__t.tx") == F.floor(F.greatest(F.col("__x1"), box[0]) / size)) & (F.col("__t.ty") == F.floor(F.greatest(F.col("__y1"), box[1]) / size)))
    return j.drop("__t", "__x1", "__y1", "__x2", "__y2")


def edges_in_rings(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(edge columns, cell_id, t0, t1, enters, leaves): the part of each edge in each convex cell (cell_id, ring), as ``clip_to_planes``.

    Borders belong to both cells, so an edge along one has a part in each; a touch has t0 = t1. Half-planes are made once
    a cell, and a pair is clipped once: the filter on the clip is inside a generator, which no filter is pushed through.
    """
    c = cells.select("cell_id", "ring", F.explode(F.array(winding(F.col("ring")))).alias("__turn"))
    c = c.select("cell_id", half_planes(F.col("ring"), F.col("__turn")).alias("__planes"), *[b.alias(n) for b, n in zip(ring_box(F.col("ring")), ("__x1", "__y1", "__x2", "__y2"), strict=True)])
    j = _met(edges, c, size)
    clip = clip_to_planes(*[F.col(x) for x in ("lon1", "lat1", "lon2", "lat2")], F.col("__planes"))
    j = j.withColumn("__c", F.explode(F.filter(F.array(clip), lambda x: x["t0"] <= x["t1"])))
    return j.select("*", "__c.*").drop("__c", "__planes")


def _crossed(ax: Column, ay: Column, bx: Column, by: Column, sides: Column, closed: bool) -> Column:
    """Where the straight line a to b crosses ``sides`` (x1, y1, x2, y2), as sorted (t, side): between odd and even places it is inside.

    A side is crossed if its ends lie on different sides of the line; ends on the line count to its left (``closed``) or right.
    """
    off = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    left = (lambda d: d >= 0) if closed else (lambda d: d > 0)

    def place(s: Column, i: Column) -> Column:
        d1, d2 = off(s["x1"], s["y1"]), off(s["x2"], s["y2"])
        share = d1 / (d1 - d2)
        x, y = s["x1"] + share * (s["x2"] - s["x1"]), s["y1"] + share * (s["y2"] - s["y1"])
        along = F.when(F.abs(bx - ax) >= F.abs(by - ay), (x - ax) / (bx - ax)).otherwise((y - ay) / (by - ay))
        return F.when(left(d1) != left(d2), F.struct(along.alias("t"), i.alias("side")))

    return F.array_sort(F.filter(F.transform(sides, place), lambda p: p.isNotNull()))


def _inner_parts(places: Column) -> Column:
    """The parts (t0, t1, enters, leaves) within 0 to 1 between odd and even ``places``."""
    half = F.floor(F.size(places) / 2).cast("int")

    def part(k: Column) -> Column:
        a, b = F.element_at(places, 2 * k + 1), F.element_at(places, 2 * k + 2)
        begins, ends = a["t"] >= 0, b["t"] <= 1
        return F.struct(F.when(begins, a["t"]).otherwise(0.0).alias("t0"), F.when(ends, b["t"]).otherwise(1.0).alias("t1"), F.when(begins, a["side"]).otherwise(-1).alias("enters"), F.when(ends, b["side"]).otherwise(-1).alias("leaves"))

    every = F.transform(F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>")), part)
    return F.filter(every, lambda p: p["t0"] <= p["t1"])


def edges_in_polygons(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(edge columns, cell_id, t0, t1, enters, leaves): the parts of each edge in each cell (cell_id, rings) of any shape.

    ``rings`` is an array of open rings, the first the border and the others holes or islands in any order: a place is
    inside by the even-odd rule over all sides. An edge may have several parts in a cell; borders belong to both cells,
    and a touch at a corner is a part without length. Sides are numbered through all rings from 0. The crossings of an
    edge with all sides are sorted, and parts lie between odd and even ones. Lines along a side are taken as a little left
    and as a little right of it, and the two results are joined.
    """
    nxt = lambda ring, i: F.element_at(ring, F.pmod(i + 1, F.size(ring)) + 1)
    ends = lambda p, q: F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2"))
    sides = F.flatten(F.transform("rings", lambda ring: F.transform(ring, lambda p, i: ends(p, nxt(ring, i)))))
    box = ring_box(F.flatten("rings"))
    c = cells.select("cell_id", sides.alias("__sides"), *[b.alias(n) for b, n in zip(box, ("__x1", "__y1", "__x2", "__y2"), strict=True)])
    line = [F.col(x) for x in ("lon1", "lat1", "lon2", "lat2")]
    found = F.concat(*[_inner_parts(_crossed(*line, F.col("__sides"), closed)) for closed in (False, True)])

    def join(done: Column, p: Column) -> Column:
        # parts come in the order of their beginnings; one that begins within the last is the same part
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["t0"].alias("t0"), F.greatest(last["t1"], p["t1"]).alias("t1"), last["enters"].alias("enters"), F.when(p["t1"] > last["t1"], p["leaves"]).otherwise(last["leaves"]).alias("leaves"))
        shared = (F.size(done) > 0) & (p["t0"] <= last["t1"])
        return F.when(shared, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(p)))

    none = F.array().cast("array<struct<t0:double,t1:double,enters:int,leaves:int>>")
    joined = F.aggregate(F.array_sort(found), none, join)
    return _met(edges, c, size).withColumn("__c", F.explode(joined)).select("*", "__c.*").drop("__c", "__sides")


def part_ends() -> tuple[Column, Column, Column, Column]:
    """The ends (lon, lat, lon, lat) of the part t0 to t1 of an edge."""
    at = lambda t, a, b: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    return at("t0", "lon1", "lon2"), at("t0", "lat1", "lat2"), at("t1", "lon1", "lon2"), at("t1", "lat1", "lat2")


def reaches(parts: DataFrame) -> DataFrame:
    """(line, cell_id, reach, first, last, t0, t1, enters, leaves, length): parts that follow each other in a cell as one.

    ``parts`` are those of ``edges_in_rings`` with (line, seq), the edges of a line numbered without gaps. Touches belong
    to no reach. reach counts from 1 within line and cell; first and last are the edges at its ends.
    """
    w = Window.partitionBy("line", "cell_id").orderBy("seq", "t0")
    d = parts.where("t0 < t1").withColumn("length", geo.haversine(*part_ends()))
    goes_on = (F.lag("seq").over(w) == F.col("seq") - 1) & (F.lag("t1").over(w) == 1.0) & (F.col("t0") == 0.0)
    d = d.withColumn("reach", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min(F.struct("seq", "t0", "enters")), F.max(F.struct("seq", "t1", "leaves"))
    g = d.groupBy("line", "cell_id", "reach").agg(first.alias("a"), last.alias("b"), F.sum("length").alias("length"))
    return g.select("line", "cell_id", "reach", F.col("a.seq").alias("first"), F.col("b.seq").alias("last"), "a.t0", "b.t1", "a.enters", "b.leaves", "length")


def intersected_cells(parts: DataFrame) -> DataFrame:
    """(cell_id, reaches, length): cells that a line runs through or touches, with the number and the greatest length of their reaches; 0 for a touch."""
    g = reaches(parts).groupBy("cell_id").agg(F.count("*").alias("reaches"), F.max("length").alias("length"))
    return parts.select("cell_id").distinct().join(g, "cell_id", "left").select("cell_id", F.coalesce("reaches", F.lit(0)).alias("reaches"), F.coalesce("length", F.lit(0.0)).alias("length"))


def outlet_cell(parts: DataFrame, segments: DataFrame) -> DataFrame:
    """(line, cell_id): the cell in which the line of the greatest segment (line, segment) ends, as far as it lies in cells."""
    top = segments.agg(F.max_by("line", F.struct("segment", "line")).alias("line"))
    return parts.where("t0 < t1").join(top, "line").groupBy("line").agg(F.max_by("cell_id", F.struct("seq", "t1", "cell_id")).alias("cell_id"))


def meetings(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(lon, lat, line): the distinct points in which lines of ``a`` and ``b`` meet, each with the least line of ``b`` there.

    Crossings, shared ends, ends on the other line, and the first point (along ``a``) of edges that run together. Points
    are the same up to 1e-9 degrees. Edges that many lines have in common meet once, by the least of b's lines.
    """
    a = a.select(*XY, F.lit(0).alias("line")).distinct()
    b = b.groupBy(*XY).agg(F.min("line").alias("line"))

    def dealt(d: DataFrame, p: str) -> DataFrame:
        box = [F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2")]
        named = [F.col(c).alias(p + c) for c in ("line", "lon1", "lat1", "lon2", "lat2")]
        return d.select(*named, box[0].alias(p + "x"), box[1].alias(p + "y"), box[2].alias(p + "x2"), box[3].alias(p + "y2"), F.explode(tiles(*box, size)).alias("t"))

    own = (F.col("t.tx") == F.floor(F.greatest("a_x", "b_x") / size)) & (F.col("t.ty") == F.floor(F.greatest("a_y", "b_y") / size))
    j = dealt(a, "a_").join(dealt(b, "b_"), "t").where("a_x <= b_x2 AND b_x <= a_x2 AND a_y <= b_y2 AND b_y <= a_y2").where(own)
    rx, ry = F.col("a_lon2") - F.col("a_lon1"), F.col("a_lat2") - F.col("a_lat1")
    sx, sy = F.col("b_lon2") - F.col("b_lon1"), F.col("b_lat2") - F.col("b_lat1")
    qx, qy = F.col("b_lon1") - F.col("a_lon1"), F.col("b_lat1") - F.col("a_lat1")
    cross, slack = rx * sy - ry * sx, 1e-12
    some = F.nullif(cross, F.lit(0.0))  # parallel edges have no share
    u, v = (qx * sy - qy * sx) / some, (qx * ry - qy * rx) / some
    meet = u.between(-slack, 1 + slack) & v.between(-slack, 1 + slack)
    # along a: where b begins and ends, if the two lie on one straight line
    f = (qx * rx + qy * ry) / (rx * rx + ry * ry)
    g = f + (sx * rx + sy * ry) / (rx * rx + ry * ry)
    from_, to = F.greatest(F.least(f, g), F.lit(0.0)), F.least(F.greatest(f, g), F.lit(1.0))
    level = F.abs(cross) <= 1e-12 * F.sqrt((rx * rx + ry * ry) * (sx * sx + sy * sy))
    same = F.abs(qx * ry - qy * rx) <= 1e-12 * F.sqrt(rx * rx + ry * ry)
    at = F.when(level, F.when(same & (from_ <= to + slack), from_)).otherwise(F.when(meet, u))
    d = j.withColumn("u", at).where("u IS NOT NULL").select((F.col("a_lon1") + F.col("u") * rx).alias("lon"), (F.col("a_lat1") + F.col("u") * ry).alias("lat"), F.col("b_line").alias("line"))
    return d.groupBy(geo.vertex_key(F.col("lon"), F.col("lat")).alias("key")).agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.min("line").alias("line")).drop("key")


def inside_rings(points: DataFrame, sides: DataFrame, size: float) -> DataFrame:
    """(id, polygon): the points (id, lon, lat) that lie inside polygons given by their sides (polygon, lon1, lat1, lon2, lat2).

    Even-odd rule over the sides to the east, in bands of latitude; lower and left borders are inside. Holes are sides
    of the same polygon. Any polygon may have any number of sides: they are never gathered.
    """
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    s = sides.where("lat1 != lat2").withColumn("__band", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    p = points.select("id", "lon", "lat", F.floor(F.col("lat") / size).alias("__band"))
    spans = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    east = F.col("lon") < F.col("lon1") + (F.col("lon2") - F.col("lon1")) * (F.col("lat") - F.col("lat1")) / (F.col("lat2") - F.col("lat1"))
    crossed = p.join(s, "__band").where(spans & east).groupBy("id", "polygon").agg((F.count("*") % 2).alias("odd"))
    return crossed.where("odd = 1").select("id", "polygon")


def ring_edges(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, pos, lon1, lat1, lon2, lat2): the sides of open rings."""
    n = F.size(ring)
    side = F.transform(ring, lambda p, i: F.struct(p["lon"].alias("lon1"), p["lat"].alias("lat1"), F.element_at(ring, F.pmod(i + 1, n) + 1)["lon"].alias("lon2"), F.element_at(ring, F.pmod(i + 1, n) + 1)["lat"].alias("lat2")))
    return rings.select(key, F.posexplode(side).alias("pos", "s")).select(key, "pos", "s.*")


def cells_in_boundary(cells: DataFrame, boundary: DataFrame, size: float) -> DataFrame:
    """(cell_id, polygon): convex cells (cell_id, ring) that lie in or meet polygons given by their sides.

    A side meets the cell, or no side does and the cell's first corner is inside the polygon.
    """
    met = edges_in_rings(boundary, cells, size).select("cell_id", "polygon").distinct()
    corner = F.col("ring")[0]
    within_ = inside_rings(cells.select(F.col("cell_id").alias("id"), corner["lon"].alias("lon"), corner["lat"].alias("lat")), boundary, size)
    return met.unionByName(within_.withColumnRenamed("id", "cell_id")).distinct()


def boundary_cells(cells: DataFrame, boundary: DataFrame, size: float) -> DataFrame:
    """(cell_id, polygon): convex cells that overlap polygons given by their sides: neither lies wholly in the other.

    A side runs through the inside of the cell, and not all sides of the polygon lie in it.
    """
    parts = edges_in_rings(boundary, cells, size).where("t0 < t1")
    x1, y1, x2, y2 = part_ends()
    d = parts.withColumn("__x", (x1 + x2) / 2).withColumn("__y", (y1 + y2) / 2).join(cells.select("cell_id", "ring"), "cell_id")
    d = d.withColumn("__in", F.array_min(ring_sides(F.col("ring"), F.col("__x"), F.col("__y"))) > 1e-15)
    per = d.groupBy("cell_id", "polygon").agg(F.max("__in").alias("through"), F.count_if((F.col("t0") == 0.0) & (F.col("t1") == 1.0)).alias("whole"))
    sides = boundary.groupBy("polygon").agg(F.count("*").alias("sides"))
    return per.where("through").join(sides, "polygon").where("whole < sides").select("cell_id", "polygon")


def restrict(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """The cells (cell_id, neighbors, ...) that are ``kept`` (cell_id), their neighbours likewise, and ocean: corners without a neighbour.

    ocean counts the corners less the neighbours and may be below 0 where cells have neighbours across corners.
    """
    k = kept.select("cell_id").distinct()
    d = cells.join(k, "cell_id", "left_semi")
    near = d.select("cell_id", F.explode("neighbors").alias("n")).join(k.withColumnRenamed("cell_id", "n"), "n", "left_semi")
    lists = near.groupBy("cell_id").agg(F.array_sort(F.collect_list("n")).alias("__n"))
    d = d.join(lists, "cell_id", "left").withColumn("neighbors", F.coalesce("__n", F.array().cast("array<long>"))).drop("__n")
    return d.withColumn("ocean", (F.size("ring") - F.size("neighbors")).cast("long"))


def cut_places(a: DataFrame, b: DataFrame, size: float, same=None, group=None) -> DataFrame:
    """(line, pos, u): where edges of ``a`` are met by those of ``b``, as shares of a's edge; where they run together, the ends of b's.

    ``same`` makes a condition of the two lines' names, where not all pairs of lines are meant. With ``group``, a function
    of a line's name, lines of one group only meet: a join by group and tile, however many groups share a tile.
    """

    def dealt(d: DataFrame, p: str) -> DataFrame:
        box = [F.least("lon1", "lon2"), F.least("lat1", "lat2"), F.greatest("lon1", "lon2"), F.greatest("lat1", "lat2")]
        named = [F.col(c).alias(p + c) for c in ("line", "pos", "lon1", "lat1", "lon2", "lat2")]
        return d.select(*named, box[0].alias(p + "x"), box[1].alias(p + "y"), box[2].alias(p + "x2"), box[3].alias(p + "y2"), (group(F.col("line")) if group else F.lit(0)).alias("group"), F.explode(tiles(*box, size)).alias("t"))

    own = (F.col("t.tx") == F.floor(F.greatest("a_x", "b_x") / size)) & (F.col("t.ty") == F.floor(F.greatest("a_y", "b_y") / size))
    j = dealt(a, "a_").join(dealt(b, "b_"), ["group", "t"] if group else "t").where("a_x <= b_x2 AND b_x <= a_x2 AND a_y <= b_y2 AND b_y <= a_y2").where(own)
    j = j.where(same(F.col("a_line"), F.col("b_line"))) if same else j
    rx, ry = F.col("a_lon2") - F.col("a_lon1"), F.col("a_lat2") - F.col("a_lat1")
    sx, sy = F.col("b_lon2") - F.col("b_lon1"), F.col("b_lat2") - F.col("b_lat1")
    qx, qy = F.col("b_lon1") - F.col("a_lon1"), F.col("b_lat1") - F.col("a_lat1")
    cross, square = rx * sy - ry * sx, rx * rx + ry * ry
    some = F.nullif(cross, F.lit(0.0))  # parallel edges have no share
    u, v = (qx * sy - qy * sx) / some, (qx * ry - qy * rx) / some
    level = F.abs(cross) <= 1e-12 * F.sqrt(square * (sx * sx + sy * sy))
    f = (qx * rx + qy * ry) / square
    along = F.array(f, f + (sx * rx + sy * ry) / square)
    found = F.when(level, F.when(F.abs(qx * ry - qy * rx) <= 1e-12 * F.sqrt(square), along)).when(v.between(-1e-12, 1 + 1e-12), F.array(u))
    return j.select(F.col("a_line").alias("line"), F.col("a_pos").alias("pos"), F.explode(found).alias("u")).where("u > 0 AND u < 1").distinct()


def points_in_rings(points: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(key): the points (key, group, own, lon, lat) that lie strictly inside a convex ring (group, part, ring) of their group other than their own part."""
    p = points.withColumn("__t", F.struct(F.floor(F.col("lon") / size).alias("tx"), F.floor(F.col("lat") / size).alias("ty")))
    # box and half-planes are made once a ring
    r = rings.select("group", "part", "ring", F.explode(F.array(winding(F.col("ring")))).alias("__turn"))
    r = r.select("group", "part", half_planes(F.col("ring"), F.col("__turn")).alias("__planes"), *[b.alias(n) for b, n in zip(ring_box(F.col("ring")), ("__x1", "__y1", "__x2", "__y2"), strict=True)])
    r = r.withColumn("__t", F.explode(tiles(*[F.col(c) for c in ("__x1", "__y1", "__x2", "__y2")], size)))
    j = p.join(r, ["group", "__t"]).where("part != own AND lon BETWEEN __x1 AND __x2 AND lat BETWEEN __y1 AND __y2")
    inside = F.forall("__planes", lambda s: s["ex"] * (F.col("lat") - s["y"]) - s["ey"] * (F.col("lon") - s["x"]) > 1e-13)
    return j.where(inside).select("key").distinct()


def _turned(degrees: Column) -> Column:
    """A difference of longitudes as the shorter way round, from -180 to below 180."""
    return degrees - 360.0 * F.floor((degrees + 180.0) / 360.0)


def unwrapped_ring(ring: Column) -> Column:
    """A ring without jumps at the date line: each corner the shorter way from the last, the least longitude from -180 to below 180.

    A ring round a pole doesn't come back to its beginning: it is closed over the pole's latitude, so that it holds the cap.
    """
    follow = lambda done, p: F.concat(done, F.array(F.struct((F.element_at(done, -1)["lon"] + _turned(p["lon"] - F.element_at(done, -1)["lon"])).alias("lon"), p["lat"].alias("lat"))))
    way = F.aggregate(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1), follow)

    def closed(w: Column) -> Column:
        first, last = w[0], F.element_at(w, -1)
        end = last["lon"] + _turned(first["lon"] - last["lon"])
        pole = F.when(F.aggregate(w, F.lit(0.0), lambda a, p: a + p["lat"]) < 0, -90.0).otherwise(90.0)
        over = F.array(F.struct(end.alias("lon"), first["lat"].alias("lat")), F.struct(end.alias("lon"), pole.alias("lat")), F.struct(first["lon"].alias("lon"), pole.alias("lat")))
        return F.when(F.abs(end - first["lon"]) > 180.0, F.concat(w, over)).otherwise(w)

    def shifted(w: Column) -> Column:
        least = F.array_min(F.transform(w, lambda p: p["lon"]))
        return F.transform(w, lambda p: F.struct((p["lon"] - 360.0 * F.floor((least + 180.0) / 360.0)).alias("lon"), p["lat"].alias("lat")))

    return F.aggregate(F.array(F.lit(0)), way, lambda w, _: closed(w), shifted)


def unwrapped_edges(edges: DataFrame, reach: float) -> DataFrame:
    """Edges without jumps at the date line, and copies a turn further where cells reach over it: to the longitude ``reach``.

    An edge over the date line runs on beyond 180, and has a copy that begins before -180; an edge west of ``reach`` - 360
    has a copy east of 180. So an edge and a cell (``unwrapped_ring``) meet in one place, wherever they lie.
    """
    base = F.col("lon1") - 360.0 * F.floor((F.least("lon1", F.col("lon1") + _turned(F.col("lon2") - F.col("lon1"))) + 180.0) / 360.0)
    d = edges.withColumn("__to", base + _turned(F.col("lon2") - F.col("lon1"))).withColumn("lon1", base).withColumn("lon2", F.col("__to")).drop("__to")
    low, high = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    turns = F.filter(F.array(F.lit(0.0), F.when(high >= 180.0, -360.0), F.when(low + 360.0 <= reach, 360.0)), lambda t: t.isNotNull())
    d = d.withColumn("__turn", F.explode(turns))
    return d.withColumn("lon1", F.col("lon1") + F.col("__turn")).withColumn("lon2", F.col("lon2") + F.col("__turn")).drop("__turn")


def edges_round_the_globe(edges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(edge columns, cell_id, t0, t1, enters, leaves): ``edges_in_polygons`` for cells (cell_id, ring) that may lie on the date line or round a pole.

    Longitudes of the edges come back unwrapped. An edge takes the shorter way round; a cell of 179 to -179 is two degrees
    wide, and is dealt to the tiles of those only.
    """
    c = cells.select("cell_id", F.array(unwrapped_ring(F.col("ring"))).alias("rings"))
    reach = c.agg(F.max(F.array_max(F.transform(F.col("rings")[0], lambda p: p["lon"])))).first()[0]
    e = unwrapped_edges(edges, 180.0 if reach is None or reach < 180.0 else float(reach))
    return edges_in_polygons(e, c, size)


def points_on_edges(edges: DataFrame, points: DataFrame, size: float = 0.25) -> DataFrame:
    """(line, pos, id, lon, lat, along): the ``points`` (id, lon, lat) strictly inside ``edges`` (line, pos, lon1 ... lat2), as ``geo.point_on_edge``.

    along is the distance from the start of the edge. Different places and edges meet once; the names of all points and
    lines that share them are joined to what is found.
    """
    found = places_on_edges(edges, points, size)
    return found.join(edges.select("line", "pos", *XY), list(XY)).join(points.select("id", "lon", "lat"), ["lon", "lat"]).select("line", "pos", "id", "lon", "lat", "along")


def places_on_edges(edges: DataFrame, points: DataFrame, size: float = 0.25) -> DataFrame:
    """(lon1 ... lat2, lon, lat, along): the different places of ``points`` strictly inside the different ``edges``.

    along is the distance from the start of the edge. Edges and points meet in tiles. A detour below a metre holds all
    points of a narrow ellipse round the edge, and a great circle leaves the box of its ends towards the pole: the box has
    a margin for both.
    """
    length = geo.haversine(*[F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")])
    far = F.least(F.lit(89.9), F.greatest(F.abs("lat1"), F.abs("lat2")))
    metres = F.sqrt(2 * length + 1) / 2 + length * length / (8 * geo.RADIUS) * F.tan(F.radians(far)) + 1
    up = F.degrees(metres / geo.RADIUS) * 1.01
    aside = up / F.cos(F.radians(far))
    box = [F.least("lon1", "lon2") - aside, F.least("lat1", "lat2") - up, F.greatest("lon1", "lon2") + aside, F.greatest("lat1", "lat2") + up]
    e = edges.select(*XY).distinct().select(*XY, *[b.alias(n) for b, n in zip(box, ("__x1", "__y1", "__x2", "__y2"), strict=True)])
    e = e.withColumn("__t", F.explode(tiles(F.col("__x1"), F.col("__y1"), F.col("__x2"), F.col("__y2"), size)))
    p = points.select("lon", "lat").distinct().select("lon", "lat", F.struct(F.floor(F.col("lon") / size).alias("tx"), F.floor(F.col("lat") / size).alias("ty")).alias("__t"))
    j = e.join(p, "__t").where("lon BETWEEN __x1 AND __x2 AND lat BETWEEN __y1 AND __y2")
    ends = [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    j = j.where(geo.point_on_edge(F.col("lon"), F.col("lat"), *ends) == 1)
    return j.select(*XY, "lon", "lat", geo.haversine(ends[0], ends[1], F.col("lon"), F.col("lat")).alias("along"))
