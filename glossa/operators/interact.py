"""What a page's users do with a graph, as tables: clicks on nodes and bands, selections and filters over click streams, cameras.

Points meet shapes by cells and in rounds: nodes by distance, from the nearest ring outwards, bands by their order, from the first ones on. A click
that is answered leaves, so it meets a few shapes however many lie under it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glossa.operators import scan, views
from glossa.sources.work import forget, settle

# --- clicks and shapes ---------------------------------------------------------------------------------------------------------


def _in_cells(shapes: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """A row for each cell that a shape's rectangle touches: _sx, _sy, _cx, _cy. A cell's sides are the next powers of four of the rectangle's."""
    side = lambda extent: F.pow(F.lit(4.0), F.ceil(F.log2(F.greatest(extent, F.lit(1.0))) / 2))
    rows = shapes.withColumns({"_sx": side(x1 - x0), "_sy": side(y1 - y0)})
    between = lambda a, b, s: F.explode(F.sequence(F.floor(a / F.col(s)).cast("long"), F.floor(b / F.col(s)).cast("long")))
    return rows.withColumn("_cx", between(x0, x1, "_sx")).withColumn("_cy", between(y0, y1, "_sy"))


def _meet(clicks: DataFrame, cells: DataFrame) -> DataFrame:
    """Clicks (click, x, y) with the shapes whose cells hold them."""
    sizes = cells.select("_sx", "_sy").distinct()  # powers of four: at most some tens
    asked = clicks.join(F.broadcast(sizes)).withColumns({"_cx": F.floor(F.col("x") / F.col("_sx")).cast("long"), "_cy": F.floor(F.col("y") / F.col("_sy")).cast("long")})
    return asked.join(cells, ["_sx", "_sy", "_cx", "_cy"]).drop("_sx", "_sy", "_cx", "_cy")


def _rounds(clicks: DataFrame, steps: Iterable, answer: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """The union of ``answer(clicks, step)`` over the steps, each asked for the clicks that none before has answered; it ends when there are none."""
    left, parts = clicks, []
    for step in steps:
        parts.append(settle(answer(left, step), "click-answers"))
        before, left = left, settle(left.join(parts[-1].select("click"), "click", "left_anti"), "clicks-left")
        forget(before)
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def nodes_at(nodes: DataFrame, clicks: DataFrame, view: str = "explore") -> DataFrame:
    """(click, id, d): of each click (click, x, y) on any node the nearest one's; of equally near ones the first. Nodes carry sx, sy and op.

    Of the nodes of one place only those can be met whose reach is longer than that of all before them. A round looks as far as its ring
    and keeps the clicks that find a node there: none nearer can lie outside.
    """
    reach = views.node_radius(view, F.col("is_source"), F.col("type"), F.col("degree")) + 4
    shapes = nodes.where("op > 0.05").select("id", "first_seq", F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"), reach.cast("double").alias("reach"))
    first = shapes.groupBy("sx", "sy", "reach").agg(F.min(F.struct("first_seq", "id")).alias("f"))
    longest = F.max("reach").over(Window.partitionBy("sx", "sy").orderBy("f", F.desc("reach")).rowsBetween(Window.unboundedPreceding, -1))
    shapes = first.withColumn("_longest", longest).where("_longest is null or reach > _longest").select("sx", "sy", "reach", "f.first_seq", "f.id")
    shapes = settle(shapes, "click-nodes")
    of = lambda c: F.max(c) - F.min(c)
    width, height, n, most = shapes.agg(of("sx"), of("sy"), F.count("*"), F.max("reach")).first()
    if not n:
        return clicks.sparkSession.createDataFrame([], StructType([clicks.schema["click"], nodes.schema["id"], StructField("d", DoubleType())]))
    # The first ring holds about one node; the last one reaches as far as any node.
    ring = min(most, max(0.5 * ((width + 1) * (height + 1) / n) ** 0.5, most / 1024))
    rings = []
    while ring < most:
        rings.append(ring)
        ring *= 2

    def answer(left: DataFrame, ring: float) -> DataFrame:
        cell = 2.25 * ring  # a ring touches two cells each way
        ends = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1.1 * ring) / cell).cast("long"), F.floor((F.col(c) + 1.1 * ring) / cell).cast("long")))
        asked = left.select("click", "x", "y", ends("x").alias("_cx"), "_y").select("click", "x", "y", "_cx", ends("_y").alias("_cy"))
        own = shapes.withColumns({"_cx": F.floor(F.col("sx") / cell).cast("long"), "_cy": F.floor(F.col("sy") / cell).cast("long")})
        d = (F.col("sx") - F.col("x")) ** 2 + (F.col("sy") - F.col("y")) ** 2
        rows = asked.join(own, ["_cx", "_cy"]).withColumn("d", d).where((F.col("d") <= F.col("reach") * F.col("reach")) & (F.col("d") <= ring * ring))
        return rows.groupBy("click").agg(F.min(F.struct("d", "first_seq", "id")).alias("f")).select("click", "f.id", "f.d")

    return _rounds(settle(clicks.select("click", "x", "y", F.col("y").alias("_y")), "clicks"), [*rings, most], answer)


def bands_at(rects: DataFrame, clicks: DataFrame, slack: float = 3) -> DataFrame:
    """(click, id): of each click in any rectangle (id, x0, x1, y0, y1, seq), a little wider across, the first one.

    A round asks the rectangles up to a place in their order: a click that lies in one of them needs none behind it.
    """
    wide = rects.withColumns({"x0": F.col("x0") - slack, "x1": F.col("x1") + slack})
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    area, width, height, n = wide.agg(F.sum((x1 - x0 + 1) * (y1 - y0 + 1)), F.max("x1") - F.min("x0") + 1, F.max("y1") - F.min("y0") + 1, F.count("*")).first()
    # The first round holds about four rectangles a click, each further one eight times as many.
    share, shares = 4 * width * height / area if n else 1.0, []
    while share < 1:
        shares.append(share)
        share *= 8
    cuts = wide.agg(F.percentile_approx("seq", shares, 100_000)).first()[0] if shares else []
    cuts = sorted(set(cuts))

    def answer(left: DataFrame, step: tuple) -> DataFrame:
        low, high = step
        own = wide.where((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else (F.col("seq") <= high) | F.col("seq").isNull() & F.lit(low is None)))
        rows = _meet(left, _in_cells(own, x0, x1, y0, y1))
        rows = rows.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        return rows.groupBy("click").agg(F.min(F.struct("seq", "id")).alias("f")).select("click", "f.id")

    return _rounds(settle(clicks.select("click", "x", "y"), "clicks"), list(zip([None, *cuts], [*cuts, None], strict=True)), answer)


# --- cameras -------------------------------------------------------------------------------------------------------------------


def clamp_camera(view: str, x: Column, y: Column, scale: Column, width: Column, height: Column) -> Column:
    """struct(x, y, scale): in the timeline a camera stays near the swarm, no farther off than the whole axis and a little more and no nearer than a row of a year."""
    if view == "explore":
        return F.struct(x.alias("x"), y.alias("y"), scale.alias("scale"))
    within = lambda v, low, high: F.greatest(low, F.least(high, v))
    across, down = F.lit(views.TIMELINE_WIDTH * 0.6), F.lit(views.TIMELINE_HEIGHT / 2 + 120)
    return F.struct(within(x, -across, across).alias("x"), within(y, -down, down).alias("y"), within(scale, height / (views.TIMELINE_HEIGHT * 1.25), F.lit(6.0)).alias("scale"))


def view_frame(view: str, nodes: DataFrame, width: float, height: float) -> DataFrame:
    """One row (x, y, scale): the camera that a view opens with - all nodes, or the whole axis."""
    if view == "explore":
        return views.frame(nodes, width, height)
    return nodes.sparkSession.range(1).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(height / (views.TIMELINE_HEIGHT * 1.08)).alias("scale"))


def fit_text(text: Column, width: Column, measure: float = 1.0) -> Column:
    """A text cut to a width, with an ellipsis where it is cut; ``measure`` is the width of a sign."""
    room = F.floor(width / measure).cast("int")
    return F.when(F.length(text) <= room, text).when(room >= 2, F.concat(F.substring(text, F.lit(1), room - 1), F.lit("…"))).otherwise("")


# --- selections and filters over click streams ---------------------------------------------------------------------------------


class Selection:
    """The selected nodes in the order of their coming, the inspected one, and the categories its connections are cut down to."""

    def __init__(self, selected: Iterable[str] = (), detail: str | None = None, kinds: Iterable[str] = ()):
        self.selected, self.detail, self.kinds = dict.fromkeys(selected), detail, set(kinds)

    def click(self, action: str, id_: str | None) -> None:
        """``toggle`` and ``pin`` take a node (a toggle of none clears), ``kind`` a category; others leave the selection alone, but for clear and reset."""
        before = self.detail
        if action in ("clear", "reset") or action == "toggle" and id_ is None:
            self.selected, self.detail, before = {}, None, ""
        elif action == "toggle" and id_ in self.selected:
            del self.selected[id_]
            self.detail = next(reversed(self.selected), None)
        elif action in ("toggle", "pin") and id_ is not None:
            self.selected.setdefault(id_)
            self.detail = id_
        elif action == "kind":
            self.kinds ^= {id_}
        if self.detail != before:
            self.kinds = set()


def selections(clicks: DataFrame, size: int = scan.BLOCK) -> DataFrame:
    """(session, seq, selected array, detail, kinds array, filters array): the state after each click (session, seq, action, id).

    A clear makes what came before it immaterial, so a session is cut at its clears and the parts are folded apart, as streams of sorted rows that hold
    the selection and not its clicks. Filters outlive a clear and end at a reset; whether one is set is how often it was
    toggled since then, a running sum. ``seq`` is a whole number.
    """
    clears = F.col("action").isin("clear", "reset") | (F.col("action") == "toggle") & F.col("id").isNull()
    rows = scan.running(clicks, ["session"], "seq", sums={"_part": clears.cast("long"), "_era": (F.col("action") == "reset").cast("long")}, size=size)
    rows = settle(rows.withColumns({"_part": F.col("_part") + clears.cast("long"), "_era": F.col("_era") + (F.col("action") == "reset").cast("long")}), "click-parts")
    filters = sorted(r["id"] for r in rows.where("action = 'filter' and id is not null").select("id").distinct().limit(FILTERS + 1).collect())
    if len(filters) > FILTERS:
        raise ValueError(f"more than {FILTERS} filter categories")
    hit = {f: F.coalesce((F.col("action") == "filter") & (F.col("id") == f), F.lit(False)).cast("long") for f in filters}
    sets = scan.running(rows, ["session", "_era"], "seq", sums={f"_f{k}": hit[f] for k, f in enumerate(filters)}, size=size)
    on = F.filter(F.array(*(F.when((F.col(f"_f{k}") + hit[f]) % 2 == 1, f) for k, f in enumerate(filters))), lambda x: x.isNotNull()) if filters else F.array().cast("array<string>")
    session = clicks.schema["session"]
    schema = StructType([StructField("session", session.dataType), *StructType.fromDDL("seq long, selected array<string>, detail string, kinds array<string>").fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Selection()
        for batch in batches:
            out = []
            for part, action, id_ in zip(zip(batch.column("session").to_pylist(), batch.column("_part").to_pylist(), strict=True), batch.column("action").to_pylist(), batch.column("id").to_pylist(), strict=True):
                if part != now:
                    now, state = part, Selection()
                state.click(action, id_)
                out.append((list(state.selected), state.detail, sorted(state.kinds)))
            kinds = (pa.list_(pa.string()), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("seq"), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=schema.names)

    picked = rows.select("session", F.col("seq").cast("long").alias("seq"), "action", "id", "_part").repartition("session", "_part").sortWithinPartitions("session", "_part", "seq").mapInArrow(fold, schema)
    return picked.join(sets.select("session", F.col("seq").cast("long").alias("seq"), on.alias("filters")), ["session", "seq"])


#: Most categories that filters may name; the graph has four.
FILTERS = 64
