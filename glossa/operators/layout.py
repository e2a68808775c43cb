"""Two-dimensional layout: a force simulation over the graph or over a coarsened one, then ranks that fill a cross evenly.

``cross`` needs ranks over all nodes. A global window would gather the graph in one task, so ranks are numbered by sorting into ranges,
counting each range and adding what came before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources.work import forget, settle

HALF_WIDTH = 0.28
KINDS = {"cites": 1.0, "authored_by": 0.4, "cites_scripture": 0.3}


def numbered(df: DataFrame, order: list[str], by: str | None = None, name: str = "i", size: str = "n", parts: int = 64) -> DataFrame:
    """``df`` with each row's number from 0 by ``order`` within ``by``, and the size of its group, without a global window.

    Rows are dealt to ranges of the first column of ``order`` by its approximate quantiles; a window numbers each range, and counts of
    the ranges before are added. The table of counts has a row per range and group of ``by``.
    """
    group = F.col(by) if by else F.lit(0)
    cuts = df.agg(F.percentile_approx(F.col(order[0]).cast("double"), [k / parts for k in range(1, parts)], 1000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    ranged = F.lit(0)
    if cuts:
        ranged = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(order[0]).cast("double")))
    rows = df.withColumn("_g", group).withColumn("_r", ranged)
    counts = rows.groupBy("_g", "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(size, F.sum("_n").over(Window.partitionBy("_g")))
    inside = F.row_number().over(Window.partitionBy("_g", "_r").orderBy(*order)) - 1
    return rows.withColumn("_k", inside).join(F.broadcast(counts.drop("_n")), ["_g", "_r"]).withColumn(name, F.col("_before") + F.col("_k")).drop("_g", "_r", "_k", "_before")


def polar(nodes: DataFrame, centre: str | None = None) -> DataFrame:
    """``nodes`` (id, px, py, ...) with raw angle and radius about the centre node, or else the middle of the frame."""
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    own = lambda c: F.max(F.when(F.col("id") == centre, F.col(c))) if centre else F.lit(None)
    middle = nodes.agg(F.coalesce(own("px"), mid("px"), F.lit(0.0)).alias("cx"), F.coalesce(own("py"), mid("py"), F.lit(0.0)).alias("cy"))
    rows = nodes.crossJoin(F.broadcast(middle))  # one row
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    return rows.withColumn("angle", F.atan2(dy, dx)).withColumn("radius", F.hypot(dx, dy)).drop("cx", "cy")


def cross_radius(theta: Column, arm: float, half: float) -> Column:
    """How far a ray at ``theta`` goes before it leaves the cross."""
    c, s = F.greatest(F.abs(F.cos(theta)), F.lit(1e-9)), F.greatest(F.abs(F.sin(theta)), F.lit(1e-9))
    return F.greatest(F.least(F.lit(arm) / c, F.lit(half) / s), F.least(F.lit(half) / c, F.lit(arm) / s))


def cross(nodes: DataFrame, centre: str | None = None, scale: float = 1000.0) -> DataFrame:
    """``nodes`` (id, px, py, seq) with x and y: angles evened out over the circle, radii over each arm of the cross."""
    rows = polar(nodes, centre)
    still = (F.col("radius") < 1e-9) | (F.col("id") == F.lit(centre) if centre else F.lit(False))
    moving = numbered(rows.where(~still), ["angle", "seq"], name="i", size="n")
    theta = -F.pi() + 2 * F.pi() * (F.col("i") + 0.5) / F.col("n")
    q = F.pi() / 4
    arm = F.when((theta > -q) & (theta <= q), 0).when((theta > q) & (theta <= 3 * q), 1).when((theta > 3 * q) | (theta <= -3 * q), 2).otherwise(3)
    moving = numbered(moving.withColumn("theta", theta).withColumn("arm", arm), ["radius", "i"], by="arm", name="j", size="m")
    reach = cross_radius(F.col("theta"), scale, scale * HALF_WIDTH) * (F.col("j") + 0.5) / F.col("m")
    placed = moving.withColumn("x", F.bround(F.cos("theta") * reach, 2)).withColumn("y", F.bround(F.sin("theta") * reach, 2))
    fixed = rows.where(still).withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    return placed.select(*nodes.columns, "x", "y").unionByName(fixed.select(*nodes.columns, "x", "y"))


def spring(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, fixed: int | None = None, iterations: int = 300, seed: int = 7) -> np.ndarray:
    """Positions of a force-directed simulation: all nodes repel, edges pull by weight; steps cool down linearly."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pos = rng.random((n, 2))
    if fixed is not None:
        pos[fixed] = 0
    if n < 2:
        return pos
    k = 1.4 / np.sqrt(n)
    heat = 0.1 * max(float(np.ptp(pos[:, 0])), float(np.ptp(pos[:, 1])))
    cool = heat / (iterations + 1)
    for _ in range(iterations):
        push = np.zeros((n, 2))
        x, y = np.ascontiguousarray(pos[:, 0]), np.ascontiguousarray(pos[:, 1])
        for start in range(0, n, 32):  # columns of the distance table at a time, as many as a processor's cache holds
            own = slice(start, start + 32)
            dx, dy = x[own] - x[:, None], y[own] - y[:, None]
            force = k * k / np.maximum(dx * dx + dy * dy, 1e-4)
            push[own, 0], push[own, 1] = (dx * force).sum(axis=0), (dy * force).sum(axis=0)
        gap = pos[a] - pos[b]
        pull = gap * (np.sqrt((gap**2).sum(axis=1)) * w / k)[:, None]
        np.add.at(push, a, -pull)
        np.add.at(push, b, pull)
        size = np.maximum(np.sqrt((push**2).sum(axis=1)), 1e-2)
        step = push * (heat / size)[:, None]
        if fixed is not None:
            step[fixed] = 0
        pos += step
        heat -= cool
    return pos


def _both_ways(forces: DataFrame) -> DataFrame:
    return forces.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").unionByName(forces.select(F.col("b").alias("id"), F.col("a").alias("other"), "w"))


def _unit(seed: int) -> Column:
    """A number from -0.5 to 0.5 by an id's hash."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5


def _relax(at: DataFrame, near: DataFrame, pull: float, step: float, cells: int) -> DataFrame:
    """One round on places (id, px, py): each node goes towards the weighted mean of its neighbours and away from the middles of the ``cells`` x ``cells``
    fields of the frame, by how many nodes each holds; that table has a fixed size."""
    mx, my, sx, sy = (v or 0.0 for v in at.agg(F.avg("px"), F.avg("py"), F.stddev_pop("px"), F.stddev_pop("py")).first())
    sx, sy = max(sx, 1e-9), max(sy, 1e-9)
    # The frame keeps its size whatever the pull: two deviations either way.
    at_unit = at.select("id", ((F.col("px") - mx) / (4 * sx)).alias("px"), ((F.col("py") - my) / (4 * sy)).alias("py"))
    field = lambda c: F.least(F.greatest(F.floor((F.col(c) + 0.5) * cells), F.lit(0)), F.lit(cells - 1))
    full = at_unit.groupBy(field("px").alias("i"), field("py").alias("j")).agg(F.count("*").alias("n"), F.avg("px").alias("x"), F.avg("py").alias("y")).collect()
    total = sum(f["n"] for f in full)
    middles = F.array(*[F.struct(F.lit(f["x"]).alias("x"), F.lit(f["y"]).alias("y"), F.lit(f["n"] / total).alias("w")) for f in full])

    def push(own: str) -> Column:
        def one(acc: Column, m: Column) -> Column:
            dx, dy = F.col("px") - m["x"], F.col("py") - m["y"]
            return acc + m["w"] * (dx if own == "px" else dy) / (dx * dx + dy * dy + 0.01)

        return F.aggregate(middles, F.lit(0.0), one)

    pulls = near.join(at_unit.select(F.col("id").alias("other"), "px", "py"), "other").groupBy("id").agg(
        (F.sum(F.col("px") * F.col("w")) / F.sum("w")).alias("qx"), (F.sum(F.col("py") * F.col("w")) / F.sum("w")).alias("qy")
    )
    toward = lambda c, q: F.col(c) + pull * F.coalesce(F.col(q) - F.col(c), F.lit(0.0)) + step * push(c)
    return settle(at_unit.join(pulls, "id", "left").select("id", toward("px", "qx").alias("px"), toward("py", "qy").alias("py")), "places")


def spread(nodes: DataFrame, forces: DataFrame, centre: str | None = None, rounds: int = 12, cells: int = 16) -> DataFrame:
    """``nodes`` (id, ...) with px, py for graphs of any size, from places by a hash of the id: all steps are joins and aggregations over the nodes."""
    near = _both_ways(forces)
    at = settle(nodes.select("id", _unit(1).alias("px"), _unit(2).alias("py")), "places")
    for r in range(rounds):
        before, at = at, _relax(at, near, 0.5, 0.05 * (1 - r / rounds), cells)
        forget(before)
    if centre is not None:
        at = at.withColumns({c: F.when(F.col("id") == centre, 0.0).otherwise(F.col(c)) for c in ("px", "py")})
    return nodes.join(at, "id")


def coarsen(nodes: DataFrame, forces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, nodes, forces) of a graph in which nodes (id, size) that pull each other most are one.

    Each node picks the neighbour with the strongest force for its size; two that pick each other become one, and a node that picked one of such a pair
    joins it.
    """
    sizes = nodes.select(F.col("id").alias("other"), F.col("size").alias("_size"))
    rank = F.struct((F.col("w") / F.col("_size")).alias("w"), F.xxhash64(F.least("id", "other"), F.greatest("id", "other")).alias("h"), F.col("other").alias("o"))
    picks = settle(_both_ways(forces).join(sizes, "other").groupBy("id").agg(F.max_by("other", rank).alias("mate")), "mates")
    back = picks.select(F.col("id").alias("mate"), F.col("mate").alias("_back"))
    pairs = settle(picks.join(back, "mate").where("_back = id").select("id", F.least("id", "mate").alias("parent")), "pairs")
    joined = picks.join(pairs.select(F.col("id").alias("mate"), F.col("parent").alias("_of_mate")), "mate").select("id", "_of_mate")
    parents = nodes.join(pairs, "id", "left").join(joined, "id", "left").select("id", F.coalesce("parent", "_of_mate", "id").alias("parent"), "size")
    return _merge(forces, parents)


def _merge(forces: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, nodes, forces) of the graph in which nodes are their ``parents`` (id, parent, size); forces between the same two sum up."""
    parents = settle(parents, "parents")
    up = lambda c: parents.select(F.col("id").alias(c), F.col("parent").alias(f"_{c}"))
    links = forces.join(up("a"), "a").join(up("b"), "b").where("_a <> _b")
    links = links.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("w").alias("w"))
    return parents, settle(parents.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("size")), "coarse-nodes"), settle(links, "coarse-forces")


def place(nodes: DataFrame, forces: DataFrame, centre: str | None = None, coarse: int = 2000, rounds: int = 4, iterations: int = 300) -> DataFrame:
    """``nodes`` (id, ...) with px, py for graphs of any size, by the simulation over a graph of at most ``coarse`` nodes.

    A larger graph is coarsened until it is that small; its places go back down level by level, where each node starts beside its parent and ``rounds`` of
    joins and aggregations move it. Where a graph no longer shrinks - its nodes have no forces left - they are dealt to ``coarse`` groups by a hash, so the simulation
    never runs over more nodes than that.
    """
    level = settle(nodes.select("id", F.lit(1).cast("long").alias("size")), "level")
    written = getattr(forces, "_settled_at", None) is not None and forces.columns == ["a", "b", "w"]
    links, levels, n = forces if written else settle(forces.select("a", "b", "w"), "level-forces"), [], level.count()
    while n > coarse:
        parents, above, above_links = coarsen(level, links)
        fewer = above.count()
        if fewer > 0.95 * n:
            forget(parents, above, above_links)
            parents, above, above_links = _merge(links, level.select("id", F.concat(F.lit("group-"), F.pmod(F.xxhash64("id"), F.lit(coarse)).cast("string")).alias("parent"), "size"))
            fewer = above.count()
        levels.append((parents, links, n))
        level, links, n = above, above_links, fewer
    at = force_layout(level, links, None if levels else centre, iterations).select("id", "px", "py")
    at = settle(at, "places")
    for parents, own_links, size in reversed(levels):
        sx, sy = (v or 1.0 for v in at.agg(F.stddev_pop("px"), F.stddev_pop("py")).first())
        beside = 2.0 / max(size, 1) ** 0.5
        start = parents.join(at.withColumnRenamed("id", "parent"), "parent").select("id", (F.col("px") / (4 * sx) + beside * _unit(1)).alias("px"), (F.col("py") / (4 * sy) + beside * _unit(2)).alias("py"))
        at, near = settle(start, "places"), _both_ways(own_links)
        for r in range(rounds):
            before, at = at, _relax(at, near, 0.3, 0.01 * (1 - r / rounds), 16)
            forget(before)
    if levels and centre is not None:
        own = at.where(F.col("id") == centre).first()
        if own:  # the frame moves with its middle
            at = at.select("id", *((F.col(c) - own[c]).alias(c) for c in ("px", "py")))
    return nodes.join(at, "id")


def force_layout(nodes: DataFrame, forces: DataFrame, centre: str | None = None, iterations: int = 300, seed: int = 7, largest: int = 20_000) -> DataFrame:
    """``nodes`` (id, ...) with px, py of the simulation over ``forces`` (a, b, w).

    The simulation runs in one process, for graphs a page can show: over ``largest`` nodes it is refused, and ``place`` is the way.
    """
    spark = nodes.sparkSession
    ids = [r["id"] for r in nodes.select("id").orderBy("id").limit(largest + 1).collect()]
    if len(ids) > largest:
        raise ValueError(f"a drawing of over {largest} nodes; place() places any number")
    at = {v: i for i, v in enumerate(ids)}
    rows = [(at[r["a"]], at[r["b"]], r["w"]) for r in forces.orderBy("a", "b").collect() if r["a"] in at and r["b"] in at]
    table = np.array(rows, dtype=np.float64).reshape(-1, 3)
    pos = spring(len(ids), table[:, 0].astype(int), table[:, 1].astype(int), table[:, 2], at.get(centre), iterations, seed)
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in zip(ids, pos, strict=True)], f"id {nodes.schema['id'].dataType.simpleString()}, px double, py double")
    return nodes.join(places, "id")
