"""River-network operators over DataFrames.

A network is a table of lines (line, start, end, ...); ``start`` and ``end`` are vertex keys of any orderable type. A
tree network also has ``down``, the line that starts where a line ends (null at the outlet). No operator depends on the
order of rows: ties are settled by columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.iterate import discard, together, until_empty, written


def vertices(lines: DataFrame) -> DataFrame:
    """(vertex): the distinct end points."""
    return lines.select(F.col("start").alias("vertex")).union(lines.select(F.col("end").alias("vertex"))).distinct()


def split_to_edges(points: DataFrame, line: str, order: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(line, pos, lon1, lat1, lon2, lat2) from vertices in ``order`` within each line; zero-length edges are left out."""
    w = Window.partitionBy(line).orderBy(*order)
    d = points.select(line, F.row_number().over(w).cast("long").alias("pos"), F.col(lon).alias("lon1"), F.col(lat).alias("lat1"), F.lead(lon).over(w).alias("lon2"), F.lead(lat).over(w).alias("lat2"))
    return d.where("lon2 IS NOT NULL AND (lon1 != lon2 OR lat1 != lat2)")


def split_at_vertices(points: DataFrame, line: str, order: list[str], cut: Column) -> DataFrame:
    """(line, piece, points): lines cut at the vertices where ``cut`` holds; a line of fewer than two cuts is dropped.

    A piece holds its cut vertices at both ends; what lies before the first or after the last cut is not part of a piece.
    """
    w = Window.partitionBy(line).orderBy(*order)
    d = points.withColumn("__cut", F.coalesce(cut, F.lit(False)).cast("int"))
    d = d.withColumn("__pos", F.row_number().over(w)).withColumn("__piece", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__cuts", F.sum("__cut").over(Window.partitionBy(line)))
    inner = d.where("__piece >= 1 AND __piece < __cuts").select(line, F.col("__piece").alias("piece"), "__pos", "lon", "lat")
    last = d.where("__cut = 1 AND __piece >= 2").select(line, (F.col("__piece") - 1).alias("piece"), "__pos", "lon", "lat")
    pieces = inner.unionByName(last).groupBy(line, "piece").agg(F.array_sort(F.collect_list(F.struct("__pos", "lon", "lat"))).alias("p"))
    return pieces.select(line, "piece", F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def split_at_foreign(edges: DataFrame, points: DataFrame, size: float = 0.25) -> DataFrame:
    """(line, piece, points): lines (line, pos, lon1 ... lat2) cut at ``points`` (id, lon, lat) that are their vertices or lie on their edges.

    As ``split_at_vertices``: a piece holds its cuts at both ends, and a line of fewer than two cuts is dropped.
    """
    from . import overlay

    on = overlay.places_on_edges(edges, points, size).join(edges, list(overlay.XY)).select("line", "pos", "along", "lon", "lat", F.lit(True).alias("foreign"))
    start = edges.select("line", "pos", F.lit(0.0).alias("along"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat"), F.lit(False).alias("foreign"))
    end = edges.groupBy("line").agg(F.max_by(F.struct("pos", "lon2", "lat2"), "pos").alias("e")).select("line", (F.col("e.pos") + 1).alias("pos"), F.lit(0.0).alias("along"), F.col("e.lon2").alias("lon"), F.col("e.lat2").alias("lat"), F.lit(False).alias("foreign"))
    key = geo.vertex_key(F.col("lon"), F.col("lat"))
    own = points.select(key.alias("__key")).distinct().withColumn("__own", F.lit(True))
    d = start.unionByName(end).unionByName(on).withColumn("__key", key).join(own, "__key", "left").drop("__key")
    # places of one line that are equal and follow each other are one
    w = Window.partitionBy("line").orderBy("pos", "along")
    d = d.withColumn("__same", (F.lag("lon").over(w) == F.col("lon")) & (F.lag("lat").over(w) == F.col("lat"))).where("NOT coalesce(__same, false)")
    return split_at_vertices(d, "line", ["pos", "along"], F.col("foreign") | F.col("__own").isNotNull())


def headwaters(lines: DataFrame) -> DataFrame:
    """The lines that start where no line ends."""
    return lines.join(lines.select(F.col("end").alias("start")).distinct(), "start", "left_anti")


def with_headwater_order(lines: DataFrame) -> DataFrame:
    """``stream_order`` 1 for headwaters, else -1."""
    ends = lines.select(F.col("end").alias("start")).distinct().withColumn("__ends", F.lit(True))
    return lines.join(ends, "start", "left").withColumn("stream_order", F.when(F.col("__ends").isNull(), 1).otherwise(-1)).drop("__ends")


def remove_loops(lines: DataFrame, priority: list[Column]) -> DataFrame:
    """One line out of each start vertex: the first by ``priority``."""
    w = Window.partitionBy("start").orderBy(*priority)
    return lines.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def remove_small_rivers(lines: DataFrame, threshold: float) -> DataFrame:
    """Drop headwaters (order 1) of ``threshold`` metres or less that are no dam; a network of a single line stays."""
    only = lines.limit(2).agg(F.count("*").alias("__few"))
    keep = (F.col("dam") == 1) | (F.col("stream_order") != 1) | (F.col("length") > threshold) | (F.col("__few") == 1)
    return lines.crossJoin(F.broadcast(only)).where(keep).drop("__few")  # one row


def degrees(lines: DataFrame) -> DataFrame:
    """(vertex, n_in, n_out): lines that end and start there."""
    both = lines.select(F.col("end").alias("vertex"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(lines.select("start", F.lit(0), F.lit(1)))
    return both.groupBy("vertex").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def classify(lines: DataFrame, outlet) -> DataFrame:
    """(vertex, connectivity, kind) with kind outlet, headwater, middle or confluence.

    A headwater line gives its start a connectivity of 1 whatever else meets there; all other ends add 1. The outlet is a
    confluence if more than one line ends there.
    """
    head = F.col("stream_order") == 1
    at_start = lines.select(F.col("start").alias("vertex"), F.lit(1).alias("n"), (head & (F.col("end") != F.lit(outlet))).alias("h"))
    at_end = lines.select(F.col("end").alias("vertex"), F.lit(1).alias("n"), F.lit(False).alias("h"))
    d = at_start.union(at_end).groupBy("vertex").agg(F.sum("n").alias("n"), F.bool_or("h").alias("h"))
    d = d.withColumn("connectivity", F.when(F.col("h"), 1).otherwise(F.col("n")).cast("long"))
    out, n = F.col("vertex") == F.lit(outlet), F.col("connectivity")
    kind = F.when((n >= 3) | (out & (n > 1)), "confluence").when(out, "outlet").when(n == 1, "headwater").otherwise("middle")
    return d.select("vertex", "connectivity", kind.alias("kind"))


def confluences(lines: DataFrame) -> DataFrame:
    """(vertex, upstream, downstream): two lines or more end there; downstream is the last line that starts there."""
    up = lines.groupBy(F.col("end").alias("vertex")).agg(F.sort_array(F.collect_list("line")).alias("upstream")).where(F.size("upstream") > 1)
    down = lines.groupBy(F.col("start").alias("vertex")).agg(F.max("line").alias("downstream"))
    return up.join(down, "vertex", "left")


def downstream_lines(lines: DataFrame) -> DataFrame:
    """Add ``down``, the line that starts at the end of each line (the last by number); null at an outlet."""
    starts = lines.groupBy(F.col("start").alias("end")).agg(F.max("line").alias("down"))
    return lines.join(starts, "end", "left")


def _most_rounds(rows: int) -> int:
    """Doublings that reach the end of any path among so many rows."""
    return max(1, rows).bit_length() + 1


def _hop(rows: DataFrame, far: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``far`` (__at, ...) on ``key``; rows without a key meet themselves, so that nulls don't share a task."""
    return rows.withColumn("__key", F.coalesce(key, "line")).join(far.withColumnRenamed("__at", "__key"), "__key", "left").drop("__key")


def jump(tree: DataFrame, value: str, drop_cycles: bool = False) -> DataFrame:
    """(line, root, total): ``value`` summed over the line and everything downstream of it, by pointer doubling.

    ``tree`` has (line, down, value). Each round makes pointers four times as long, so that rounds grow with the logarithm
    of the depth. A line that has reached its root is looked up by others, but neither moved nor written again. Lines on a
    cycle, or above one, have no root: an error, or left out with ``drop_cycles``.
    """
    open_ = F.count_if(F.col("to").isNotNull())
    now = written(tree.select("line", F.col("down").alias("to"), F.col("line").alias("root"), F.col(value).alias("total")), open=open_, rows=F.count("*"))
    rounds, most = [now], _most_rounds(now.seen["rows"])
    while now.seen["open"]:
        if len(rounds) > most:
            if drop_cycles:
                break
            raise RuntimeError("lines on a cycle stay open")
        moving = now.where("to IS NOT NULL")
        known = together(rounds).where("to IS NULL").unionByName(moving)
        far = known.select(F.col("line").alias("__at"), F.col("to").alias("__to"), F.col("root").alias("__root"), F.col("total").alias("__total"))
        for _ in range(3):
            more = F.when(F.col("to").isNotNull(), F.col("__total"))
            moving = _hop(moving, far, "to").select("line", F.when(F.col("to").isNotNull(), F.col("__to")).alias("to"), F.when(F.col("to").isNotNull(), F.coalesce("__root", "root")).otherwise(F.col("root")).alias("root"), (F.col("total") + F.coalesce(more, F.lit(0))).alias("total"))
        now = written(moving, open=open_)
        rounds.append(now)
    return together(rounds).where("to IS NULL").select("line", "root", "total")


def subtree_sum(tree: DataFrame, value: str) -> DataFrame:
    """(line, total): ``value`` summed over the line and everything upstream of it; each round reaches four times as far.

    Only lines whose pointer is not past the root are moved; what reaches a line after that is written as a row of its
    own, and the rows of a line are added up at the end.
    """
    open_ = F.count_if(F.col("to").isNotNull())
    now = written(tree.select("line", F.col("down").alias("to"), F.col(value).alias("total"), F.lit(True).alias("own")), open=open_, rows=F.count("*"))
    rounds, most = [now], _most_rounds(now.seen["rows"])
    while now.seen["open"]:
        if len(rounds) > most:
            raise RuntimeError("lines on a cycle stay open")
        moving = now.where("to IS NOT NULL")
        far = moving.select(F.col("line").alias("__at"), F.col("to").alias("__to"))
        way = moving.withColumn("to1", F.col("to"))
        for i in (1, 2, 3):
            way = _hop(way, far, f"to{i}").withColumn(f"to{i + 1}", F.when(F.col(f"to{i}").isNotNull(), F.col("__to"))).drop("__to")
        reached = way.select(F.explode(F.array("to1", "to2", "to3")).alias("line"), "total").where("line IS NOT NULL").groupBy("line").agg(F.sum("total").alias("__more"))
        onward = way.select("line", F.col("to4").alias("to"), "total", "own")
        j = onward.join(reached, "line", "full")
        now = written(j.select("line", "to", (F.coalesce("total", F.lit(0)) + F.coalesce("__more", F.lit(0))).alias("total"), F.coalesce("own", F.lit(False)).alias("own")), open=open_)
        rounds.append(now)
    summed = together(rounds).where("to IS NULL").groupBy("line").agg(F.sum("total").alias("total"), F.max("own").alias("own"))
    return summed.where("own").select("line", "total")


def shreve(tree: DataFrame) -> DataFrame:
    """(line, stream_order): the number of headwaters upstream."""
    ups = tree.where("down IS NOT NULL").select(F.col("down").alias("line")).distinct().withColumn("__up", F.lit(1))
    d = tree.join(ups, "line", "left").withColumn("__head", F.when(F.col("__up").isNull(), 1).otherwise(0).cast("long"))
    return subtree_sum(d, "__head").select("line", F.col("total").alias("stream_order"))


def _after(plus: Column, steps: Column, x: Column) -> Column:
    """The order that a function (plus, steps) gives for the order ``x``: steps[x] for the least ones, else x + plus."""
    return F.when(x <= F.size(steps), F.get(steps, (x - 1).cast("int"))).otherwise(x + plus)


def strahler(tree: DataFrame) -> DataFrame:
    """(line, stream_order): headwaters 1; where all upstream orders are equal one more, else their greatest.

    A single upstream line also counts as all equal. By tree contraction: each round settles the lines whose upstream
    lines are all settled, and a line with one unsettled upstream line keeps its order as a function of that line's;
    such functions are composed by pointer doubling. A chain takes rounds by the logarithm of its length. Lines on a
    cycle are an error.
    """
    nothing = F.array().cast("array<long>")
    start = tree.select("line", "down", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast(tree.schema["line"].dataType).alias("up"), F.lit(0).cast("long").alias("plus"), nothing.alias("steps"), F.lit(None).cast("long").alias("stream_order"))
    counts = {"open": F.count_if(F.col("stream_order").isNull()), "settled": F.count("stream_order")}
    rounds = [written(start, **counts)]
    while True:
        now = rounds[-1]
        if not now.seen["open"]:
            return together(rounds).where("stream_order IS NOT NULL").select("line", "stream_order")
        if len(rounds) > 1 and not now.seen["settled"]:
            raise RuntimeError("lines on a cycle stay open")
        is_open = F.col("stream_order").isNull()
        kids = now.where("down IS NOT NULL").groupBy(F.col("down").alias("line")).agg(F.count_if(is_open).alias("__n"), F.min(F.when(is_open, F.col("line"))).alias("__kid"), F.min("stream_order").alias("__lo"), F.max("stream_order").alias("__hi"))
        # a pointer may have moved to a line that was settled some rounds ago
        known = together(rounds).where("stream_order IS NOT NULL").unionByName(now.where(is_open))
        far = known.select(F.col("line").alias("__at"), F.col("up").alias("__up"), F.col("plus").alias("__plus"), F.col("steps").alias("__steps"), F.col("stream_order").alias("__order"))
        # lines without a pointer look at themselves: no null keys, which would all meet in one task
        s = now.where(is_open).withColumn("__at", F.coalesce("up", "line")).join(far, "__at", "left").join(kids, "line", "left")
        s = s.withColumn("lo", F.least("lo", "__lo")).withColumn("hi", F.greatest("hi", "__hi"))
        lo, hi, up = F.col("lo"), F.col("hi"), F.col("up")
        full = F.when(lo.isNull(), 1).when(lo == hi, hi + 1).otherwise(hi)
        order = F.when(F.coalesce("__n", F.lit(0)) == 0, full).when(up.isNotNull() & F.col("__order").isNotNull(), _after(F.col("plus"), F.col("steps"), F.col("__order")))
        begins, moves = up.isNull() & (F.col("__n") == 1), up.isNotNull() & F.col("__up").isNotNull()
        first = F.when(lo.isNull(), nothing).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), hi), lambda x: F.when((lo == hi) & (x == hi), hi + 1).otherwise(hi)))
        n = F.greatest(F.size("__steps"), F.size("steps") - F.col("__plus")).cast("long")
        through = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), lambda x: _after(F.col("plus"), F.col("steps"), _after(F.col("__plus"), F.col("__steps"), x)))).otherwise(nothing)
        new = s.select(
            "line", "down", "lo", "hi", F.when(begins, F.col("__kid")).when(moves, F.col("__up")).otherwise(up).alias("up"),
            F.when(begins, F.when(lo.isNull(), 1).otherwise(0).cast("long")).when(moves, F.col("plus") + F.col("__plus")).otherwise(F.col("plus")).alias("plus"),
            F.when(begins, first).when(moves, through).otherwise(F.col("steps")).alias("steps"), order.cast("long").alias("stream_order"),
        )
        rounds.append(written(new, **counts))


def segments(tree: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(line, segment): n + 1 - rank in the pre-order from the outlet, siblings by line number; the outlet is n.

    The rank of a line is one more than that of the line below, plus the sizes of the earlier branches there. ``sizes``
    (line, total), the lines upstream of each and itself, may be given where they are known.
    """
    sizes = subtree_sum(tree.withColumn("__one", F.lit(1).cast("long")), "__one") if sizes is None else sizes
    sized = tree.join(sizes, "line")
    w = Window.partitionBy("down").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    step = sized.withColumn("__before", F.coalesce(F.sum("total").over(w), F.lit(0)) + 1).drop("total")
    n = tree.agg(F.count("*").alias("__n"))
    return jump(step, "__before").crossJoin(F.broadcast(n)).select("line", (F.col("__n") + 1 - F.col("total")).alias("segment"))  # one row


def merge(lines: DataFrame, middle: DataFrame) -> DataFrame:
    """(line, first, parts, length, dam?): chains through ``middle`` (vertex) become one line, named by their downstream piece.

    ``lines`` has (line, start, end, down, length); a column ``dam``, where there is one, becomes the pieces' greatest. first is the uppermost piece, parts the number of pieces.
    """
    at = middle.select(F.col("vertex").alias("end")).withColumn("__middle", F.lit(True))
    links = lines.join(at, "end", "left").select("line", F.when(F.col("__middle"), F.col("down")).alias("down"), "length").withColumn("__one", F.lit(1).cast("long"))
    dam = ["dam"] if "dam" in lines.columns else []
    placed = jump(links, "__one").join(lines.select("line", "length", *dam), "line")
    return placed.groupBy(F.col("root").alias("line")).agg(F.max_by("line", "total").alias("first"), F.count("*").alias("parts"), F.sum("length").alias("length"), *[F.max(c).alias(c) for c in dam])


def small_river_rounds(lines: DataFrame, outlet, threshold: float, rounds: int = 3) -> DataFrame:
    """(line, start, end, length, dam) after ``rounds`` of dropping small headwaters and merging the chains that this leaves."""
    now = written(lines.select("line", "start", "end", "length", "dam"))
    for _ in range(rounds):
        kept = written(with_headwater_order(remove_small_rivers(with_headwater_order(now), threshold).drop("stream_order")))
        middle = classify(kept, outlet).where("kind = 'middle'").select("vertex")
        merged = merge(downstream_lines(kept), middle)
        first = kept.select(F.col("line").alias("first"), "start")
        now = written(merged.join(first, "first").join(kept.select("line", "end"), "line").select("line", "start", "end", "length", "dam"))
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the least node of its component.

    Each round takes the least root among the neighbours, then the root of the root, so that long chains shorten fast.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    state = written(first.select("node", F.least("node", "b").alias("root"), F.col("node").alias("was")))

    def step(d: DataFrame) -> DataFrame:
        near = both.join(d.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("__near"))
        moved = d.join(near, "node").select("node", F.least("root", "__near").alias("__root"), F.col("root").alias("was"))
        far = d.select(F.col("node").alias("__root"), F.col("root").alias("__far"))
        return moved.join(far, "__root").select("node", F.least("__root", "__far").alias("root"), "was")

    # one round more after the first, for nodes that start at their least neighbour
    return until_empty(written(step(state)), step, lambda d: d.where("root != was")).select("node", "root")


def trace_downstream(starts: DataFrame, topology: DataFrame, known: DataFrame) -> DataFrame:
    """(id): the ``starts`` and all that lies downstream of them by ``topology`` (from, to), up to the ``known`` ids.

    Known ids end the walk and are not part of the result; null ids and links to null are no links. Runs of ids with one
    way on are walked in one round, whatever their length: rounds follow the number of branchings on a walk.
    """
    links = topology.select(F.col("from").alias("id"), "to").where("`from` IS NOT NULL AND to IS NOT NULL").distinct().join(known.select("id").distinct(), "id", "left_anti")
    links = written(links.join(known.select(F.col("id").alias("to")).distinct(), "to", "left_anti").select("id", "to"))
    ways = links.groupBy("id").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    single = written(ways.where("n = 1").select(F.col("id").alias("line"), "to"))
    inside = single.select(F.col("line").alias("to"), F.col("line").alias("down"))
    runs = written(single.join(inside, "to", "left").select("line", "down", F.lit(1).cast("long").alias("one")))
    done = written(jump(runs, "one", drop_cycles=True).select("line", "root"))
    # where each run's walk goes on: the link of its last id; what is on or above a cycle is walked step by step
    last = done.join(single.withColumnRenamed("line", "root"), "root").select(F.col("line").alias("id"), "to")
    onward = written(last.unionByName(links.join(done.select(F.col("line").alias("id")), "id", "left_anti")))
    new = written(starts.select("id").where("id IS NOT NULL").distinct().join(known.select("id"), "id", "left_anti"))
    rounds = [new]
    while not new.isEmpty():
        ahead = new.join(onward, "id").select(F.col("to").alias("id")).distinct()
        new = written(ahead.join(together(rounds), "id", "left_anti"))
        rounds.append(new)
    entered = together(rounds)
    # all ids of a run below one that is entered
    hits = runs.join(done.select("line"), "line", "left_semi").join(entered.select(F.col("id").alias("line"), F.lit(1).cast("long").alias("hit")), "line", "left")
    passed = subtree_sum(hits.select("line", "down", F.coalesce("hit", F.lit(0)).cast("long").alias("hit")), "hit").where("total > 0").select(F.col("line").alias("id"))
    return passed.unionByName(entered).distinct()


def distances(edges: DataFrame, origin) -> DataFrame:
    """(vertex, dist): the least number of edges between ``origin`` and each vertex of the undirected ``edges`` (id, u, v) that it reaches.

    Runs of vertices with two edges become one edge, by pointer doubling over both directions, and dead ends are taken
    off, as long as that shortens the network: a tree is gone after rounds by the logarithm of its size. What is left,
    where every vertex has three edges or more, is relaxed round by round; then the vertices taken off are put back.
    """
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType
    now = written(edges.where("u != v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.lit(1).cast("long").alias("w")))
    off: list[DataFrame] = []  # (vertex, anchor, d), in the order in which vertices were taken off
    size = now.count()
    while size:
        ends = now.select(F.col("u").alias("vertex")).union(now.select("v")).groupBy("vertex").agg(F.count("*").alias("n")).where(F.col("vertex") != F.lit(origin))
        through = written(ends.where("n = 2").select("vertex"))
        short = now
        if not through.isEmpty():
            # each edge in both directions: from tail to head, and on from heads with two edges
            name = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
            halves = written(now.select(F.col("u").alias("tail"), F.col("v").alias("head"), "w").union(now.select("v", "u", "w")).select("tail", "head", "w", name("tail", "head").alias("line")))
            step = halves.join(through.withColumnRenamed("vertex", "head"), "head").select("tail", "head", "line")
            leave = halves.select(F.col("tail").alias("head"), F.col("head").alias("__next"))
            step = step.join(leave, "head").where("tail != __next").select("line", name("head", "__next").alias("down"))
            ways = halves.join(step, "line", "left").select("line", "down", "w")
            far = written(jump(ways, "w", drop_cycles=True).select("line", "root", "total"))
            places = written(far.join(through, F.col("line.a") == F.col("vertex")).select("vertex", F.col("root.b").alias("anchor"), F.col("total").alias("d")))
            back = far.select(F.struct(F.col("line.b").alias("a"), F.col("line.a").alias("b")).alias("line"), F.col("root.b").alias("u"), F.col("total").alias("__back"))
            # an edge's two walks meet in it: their lengths hold its own twice
            whole = far.join(back, "line").join(halves.select("line", "w"), "line").select("u", F.col("root.b").alias("v"), (F.col("total") + F.col("__back") - F.col("w")).alias("w"))
            short = written(whole.where("u < v").groupBy("u", "v").agg(F.min("w").alias("w")))
            off.append(places)
        dead = short.select(F.col("u").alias("vertex"), F.col("v").alias("anchor"), F.col("w").alias("d")).union(short.select("v", "u", "w"))
        alone = short.select(F.col("u").alias("vertex")).union(short.select("v")).groupBy("vertex").agg(F.count("*").alias("n")).where((F.col("n") == 1) & (F.col("vertex") != F.lit(origin))).select("vertex")
        leaves = written(dead.join(alone, "vertex"))
        off.append(leaves)
        new = written(short.join(leaves.select(F.col("vertex").alias("u")), "u", "left_anti").join(leaves.select(F.col("vertex").alias("v")), "v", "left_anti").select("u", "v", "w"))
        discard(now)
        now, before, size = new, size, new.count()
        if size == before:
            break
    both = written(now.union(now.select("v", "u", "w")).toDF("u", "v", "w"))
    reached = written(spark.createDataFrame([(origin,)], "vertex " + kind.simpleString()).select("vertex", F.lit(0).cast("long").alias("dist")))
    found = [reached]
    while not reached.isEmpty():
        ahead = reached.join(both.withColumnRenamed("u", "vertex"), "vertex").groupBy(F.col("v").alias("vertex")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        best = together(found).groupBy("vertex").agg(F.min("dist").alias("__best"))
        reached = written(ahead.join(best, "vertex", "left").where("__best IS NULL OR dist < __best").select("vertex", "dist"))
        found.append(reached)
    for placed in reversed(off):
        known = together(found).groupBy(F.col("vertex").alias("anchor")).agg(F.min("dist").alias("dist"))
        found.append(written(placed.join(known, "anchor").select("vertex", (F.col("dist") + F.col("d")).alias("dist"))))
    return together(found).groupBy("vertex").agg(F.min("dist").alias("dist"))


def orient(lines: DataFrame, outlet) -> DataFrame:
    """(line, start, end, level, turned): lines walked outward from ``outlet`` over either end; unreached lines are dropped.

    Vertices are in the order of (lines from the outlet, vertex), and every line runs to the lesser of its ends, so that
    no cycle is left, braided or not. The level is the number of lines from the outlet, that of the end plus one. Null
    ends are never reached; a line that ends where it starts is dropped.
    """
    dist = written(distances(lines.select(F.col("start").alias("u"), F.col("end").alias("v")), outlet))
    at = lambda end: dist.select(F.col("vertex").alias(end), F.col("dist").alias("__" + end))
    d = lines.select("line", "start", "end").where("start != end").join(at("start"), "start").join(at("end"), "end")
    turn = (F.col("__start") < F.col("__end")) | ((F.col("__start") == F.col("__end")) & (F.col("start") < F.col("end")))
    ends = [F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("start", "end"), ("end", "start"))]
    return d.select("line", *ends, (F.least("__start", "__end") + 1).cast("int").alias("level"), turn.cast("int").alias("turned"))


def carried_mark(rows: DataFrame, keys: list[str], order: list[Column], sets: Column, turns: Column) -> DataFrame:
    """Add ``mark``, 0 or 1: the state of a mark before each row, walked in ``order`` within ``keys``.

    A row whose ``sets`` is 0 or 1 sets the mark, one whose ``turns`` holds turns it, others leave it; it begins with 0.
    A running count of turns and the last row that sets tell the state, so that no walk is gathered.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("__turn", F.coalesce(turns, F.lit(False)).cast("int"))
    d = d.withColumn("__turns", F.coalesce(F.sum("__turn").over(before), F.lit(0)))
    d = d.withColumn("__set", F.when(sets.isNotNull(), F.struct(sets.alias("v"), F.col("__turns").alias("n"))))
    found = F.last("__set", ignorenulls=True).over(before)
    mark = (F.coalesce(found["v"], F.lit(0)) + F.col("__turns") - F.coalesce(found["n"], F.lit(0))) % 2
    return d.withColumn("mark", mark.cast("int")).drop("__turn", "__turns", "__set")


def line_prints(points: DataFrame, line: str, order: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(line, points, print): lines of equal vertices in equal order have equal prints; no line is gathered.

    The print is a pair of sums of hashes of place and vertex: different lines are told apart but for a chance of about 2 ** -100.
    """
    w = Window.partitionBy(line).orderBy(*order)
    d = points.select(line, F.row_number().over(w).alias("__pos"), F.round(F.col(lon) * 1e9).cast("long").alias("__x"), F.round(F.col(lat) * 1e9).cast("long").alias("__y"))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "__pos", "__x", "__y").cast("decimal(38,0)"))
    return d.groupBy(line).agg(F.count("*").alias("points"), F.struct(total(1).alias("a"), total(2).alias("b")).alias("print"))


def segment_members(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """(line, segment, stream_order, rank): the edges (line, start, end) of each of the ``segments`` they were merged to.

    ``segments`` has (line, first, segment, stream_order), named by the lowest edge. rank grows downstream.
    """
    links = downstream_lines(edges.select("line", "start", "end")).join(segments.select("line", F.lit(True).alias("__last")), "line", "left")
    links = links.select("line", F.when(F.col("__last").isNull(), F.col("down")).alias("down"), F.lit(1).cast("long").alias("one"))
    placed = jump(links, "one")
    return placed.join(segments.select(F.col("line").alias("root"), "segment", "stream_order"), "root").select("line", "segment", "stream_order", (-F.col("total")).alias("rank"))


def segment_topology(tree: DataFrame, numbered: DataFrame) -> DataFrame:
    """(segment, downstream, upstream) by segment number, from ``tree`` (line, down) and ``segments``: null below the outlet, a list above."""
    d = tree.select("line", "down").join(numbered.select("line", "segment"), "line")
    below = d.select(F.col("line").alias("down"), F.col("segment").alias("downstream"))
    d = d.join(below, "down", "left")
    above = d.where("downstream IS NOT NULL").groupBy(F.col("downstream").alias("segment")).agg(F.array_sort(F.collect_list("segment")).alias("upstream"))
    return d.join(above, "segment", "left").select("segment", "downstream", F.coalesce("upstream", F.array().cast("array<long>")).alias("upstream"))


def running_id(rows: DataFrame, order: list[str], column: str = "id") -> DataFrame:
    """All rows with ``column``: 1, 2, ... in the order of ``order`` over the whole table, which should leave no ties.

    The rows are cut into ranges, numbered within each, and the ranges' sizes summed (one number a range): no task
    sorts the whole table.
    """
    cut = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return cut.withColumn("__nth", inside).join(F.broadcast(starts), "__range").withColumn(column, (F.col("__start") + F.col("__nth")).cast("long")).drop("__range", "__nth", "__start")


def add_unique(known: DataFrame, more: DataFrame) -> DataFrame:
    """(vertex, place, added): the vertices of ``known`` (vertex, place) once each, at their first place, and those that only ``more`` has."""
    first = lambda d: d.groupBy("vertex").agg(F.min("place").alias("place"))
    new = first(more).join(known.select("vertex").distinct(), "vertex", "left_anti")
    return first(known).withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))
