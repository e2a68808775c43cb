"""Interactive queries over the graph: search, neighbourhoods, details, filters, time line and ribbons."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossa.functions import text as X
from glossa.operators.graph import symmetric
from glossa.sources.work import settle

TIMELINE_HEIGHT, TIMELINE_WIDTH = 4200, 2400
PITCH, LANE_PITCH = 28, 22
ZONES = ["reign", "life", "council"]


def search(nodes: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The best ``limit`` nodes whose label (or id) holds ``query``: early matches first, the start of a label before all, then degree."""
    label = F.coalesce(F.nullif("label", F.lit("")), "id")
    at = F.instr(F.lower(label), query.lower()) - 1
    score = F.when(at == 0, 0).otherwise(1_000_000) + at * 1000 - F.least(F.coalesce("degree", F.lit(0)), F.lit(99))
    size = len(query)
    hits = nodes.where(at >= 0).select(
        "id", label.alias("label"), score.cast("long").alias("score"), "first_seq",
        F.substring(label, F.lit(1), at).alias("before"), F.substring(label, at + 1, F.lit(size)).alias("match"), F.substring(label, at + 1 + size, F.lit(1 << 20)).alias("after"),
    )
    return hits.orderBy("score", "first_seq").limit(limit)


def selection_highlight(edges: DataFrame, selected: Sequence[str]) -> DataFrame:
    """(id, role): nothing selected: nothing; one: it and its neighbours; more: they and what touches at least two of them."""
    spark = edges.sparkSession
    chosen = spark.createDataFrame([(s,) for s in dict.fromkeys(selected)], "id string")
    own = chosen.select("id", F.lit("selected").alias("role"))
    near = symmetric(edges.where(F.col("source").isin(list(selected)) | F.col("target").isin(list(selected)))).where(F.col("id").isin(list(selected)))
    near = near.where(~F.col("neighbour").isin(list(selected))).groupBy(F.col("neighbour").alias("id")).agg(F.count_distinct("id").alias("k"))
    least = 1 if len(set(selected)) == 1 else 2
    return own.unionByName(near.where(F.col("k") >= least).select("id", F.lit("neighbour" if least == 1 else "bridge").alias("role")))


def selection_summary(nodes: DataFrame, edges: DataFrame, selected: Sequence[str], shown: int = 6) -> DataFrame:
    """One row: how many bridges join the selection, and the first few names."""
    bridges = selection_highlight(edges, selected).where("role = 'bridge'").join(nodes.select("id", "label", "first_seq"), "id")
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first_seq", "label"))), 1, shown), lambda x: x["label"])
    return bridges.agg(F.count("*").alias("n"), names.alias("names")).select("n", F.when(F.col("n") > 0, F.array_join("names", ", ")).otherwise("no direct connection").alias("names"))


def detail_rows(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """(key, unit, category, id) of a node's connections, by row of its panel; rows without members are absent."""
    near = edges.where((F.col("source") == id_) | (F.col("target") == id_))
    me = nodes.where(F.col("id") == id_).select(F.col("type").alias("mine"))
    out = near.where(F.col("source") == id_).select(F.col("target").alias("id"), "type", F.lit("out").alias("way"))
    into = near.where(F.col("target") == id_).select(F.col("source").alias("id"), "type", F.lit("in").alias("way"))
    other = nodes.select("id", F.coalesce("is_source", F.lit(False)).alias("seed"))
    rows = out.unionByName(into).distinct().join(other, "id").crossJoin(F.broadcast(me))  # one row
    t, doc, way, seed = F.col("type"), F.col("mine") == "document", F.col("way"), F.col("seed")
    incoming = F.when(F.col("mine") == "author", "authored_by").otherwise("cites_scripture")
    key = (
        F.when(doc & (way == "in") & (t == "cites") & seed, "source").when(doc & (way == "out") & (t == "cites"), "document")
        .when(doc & (way == "out") & (t == "authored_by"), "author").when(doc & (way == "out") & (t == "cites_scripture"), "scripture")
        .when(~doc & (way == "in") & (t == incoming) & seed, "source").when(~doc & (way == "in") & (t == incoming), "document")
    )
    unit = F.when(F.col("key") == "source", "encyclical").when(F.col("key") == "document", "work").when(F.col("key") == "author", "person").otherwise("passage")
    return rows.withColumn("key", key).where("key is not null").select("key", unit.alias("unit"), "id").distinct()


def neighbours_by_category(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    near = symmetric(edges.where((F.col("source") == id_) | (F.col("target") == id_))).where(F.col("id") == id_)
    rows = nodes.join(near.select(F.col("neighbour").alias("id")), "id", "left_semi")
    return rows.groupBy(X.category(F.col("is_source"), F.col("type")).alias("category")).agg(F.count("*").alias("n"))


def highlight(nodes: DataFrame, edges: DataFrame, selected: Sequence[str] = (), filters: Sequence[str] = (), detail: str | None = None, detail_keys: Sequence[str] = (), hovered: str | None = None) -> DataFrame | None:
    """(id) of what stays lit; None where nothing is dimmed.

    The selection and the filters add up; rows chosen in the detail panel narrow a selection of that node alone and else add to it; hovering
    counts only where nothing else does.
    """
    spark = nodes.sparkSession
    base = selection_highlight(edges, selected).select("id") if selected else None
    if detail and detail_keys:
        chosen = detail_rows(nodes, edges, detail).where(F.col("key").isin(list(detail_keys))).select("id").unionByName(spark.createDataFrame([(detail,)], "id string"))
        base = chosen if base is None or set(selected) == {detail} else base.unionByName(chosen)
    if filters:
        kept = nodes.where(X.category(F.col("is_source"), F.col("type")).isin(list(filters))).select("id")
        base = kept if base is None else base.unionByName(kept)
    if base is None:
        return selection_highlight(edges, [hovered]).select("id").distinct() if hovered else None
    return base.distinct()


def toggle(selected: Sequence[str], id_: str) -> list[str]:
    """The selection after a click: ``id_`` goes out if it is in, else it comes in last."""
    return [s for s in selected if s != id_] if id_ in selected else [*selected, id_]


def year_y(year: Column, low: Column, high: Column) -> Column:
    return F.lit(TIMELINE_HEIGHT) * (year - low) / (high - low) - F.lit(TIMELINE_HEIGHT) / 2


def timeline(nodes: DataFrame, year_min: int, year_max: int, width: int = TIMELINE_WIDTH, root: str | None = None) -> DataFrame:
    """(id, x, y, op): documents with a year as swarms by year, the most connected first, spread over lanes; other nodes keep their place, hidden."""
    cols = max(2, width // PITCH)
    dated = (F.col("type") == "document") & (F.coalesce("year", F.lit(0)) != 0)
    rows = nodes.where(dated).withColumn("bucket", F.greatest("year", F.lit(year_min)))
    first = F.when(F.col("id") == F.lit(root), 0).otherwise(1) if root else F.lit(1)
    by_year = Window.partitionBy("bucket")
    rows = rows.withColumn("i", F.row_number().over(by_year.orderBy(first, F.desc("degree"), "first_seq")) - 1).withColumn("n", F.count("*").over(by_year))
    rows = rows.withColumn("lanes", F.ceil(F.col("n") / cols)).withColumn("lane", F.col("i") % F.col("lanes"))
    across = F.ceil((F.col("n") - F.col("lane")) / F.col("lanes"))
    x = (F.floor(F.col("i") / F.col("lanes")) - (across - 1) / 2) * PITCH
    y = year_y(F.col("bucket"), F.lit(year_min), F.lit(year_max)) + (F.col("lane") - (F.col("lanes") - 1) / 2) * LANE_PITCH
    seen = rows.select("id", x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1).alias("op"))
    return seen.unionByName(nodes.where(~dated).select("id", F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0).alias("op")))


def bands(nodes: DataFrame, year_min: int, year_max: int) -> DataFrame:
    """(id, kind, start, end, ongoing, label, cs, ce, early, first_seq): one band for each span, its best-connected node's."""
    s = F.col("span")
    best = Window.partitionBy("span.kind", "span.start", "span.end", "span.label").orderBy(F.desc("degree"), "first_seq")
    rows = nodes.where(s.isNotNull()).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    end = F.coalesce(s["end"], F.lit(year_max))
    return rows.select(
        "id", s["kind"].alias("kind"), s["start"].alias("start"), end.alias("end"), s["end"].isNull().alias("ongoing"), F.coalesce(F.nullif(s["label"], F.lit("")), "label").alias("label"),
        F.greatest(F.lit(year_min), s["start"]).alias("cs"), F.least(F.lit(year_max), end).alias("ce"), (end < year_min).alias("early"), "first_seq",
    )


def packed(bands: DataFrame) -> DataFrame:
    """(id, kind, lane): bands (id, kind, cs, ce, first_seq) in the first lane of their kind that is free when they start.

    Where all earlier bands have ended every lane is free, so a kind is cut there and the parts are packed apart, each as a sweep over sorted rows with a
    heap of the lanes' ends and one of free lanes. The cuts come from a kind's distinct starting years.
    """
    by_year = bands.groupBy("kind", "cs").agg(F.max("ce").alias("ce"))
    years = Window.partitionBy("kind").orderBy("cs")  # as many rows as years
    latest = F.max("ce").over(years.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("cs") >= latest).cast("long"), F.lit(1))
    parts = by_year.select("kind", "cs", cut.alias("cut")).withColumn("part", F.sum("cut").over(years)).drop("cut")
    rows = bands.select("kind", "cs", "ce", "first_seq", "id").join(parts, ["kind", "cs"])
    schema = StructType([bands.schema["id"], bands.schema["kind"], *StructType.fromDDL("lane int").fields])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, busy, free, lanes = None, [], [], 0
        for batch in batches:
            out = []
            for part, cs, ce in zip(zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), strict=True), batch.column("cs").to_pylist(), batch.column("ce").to_pylist(), strict=True):
                if part != now:
                    now, busy, free, lanes = part, [], [], 0
                while busy and busy[0][0] <= cs:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    lane = heapq.heappop(free)
                else:
                    lane, lanes = lanes, lanes + 1
                heapq.heappush(busy, (ce, lane))
                out.append(lane)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), pa.array(out, pa.int32())], names=["id", "kind", "lane"])

    return rows.repartition("kind", "part").sortWithinPartitions("kind", "part", "cs", "ce", "first_seq", "id").mapInArrow(sweep, schema)


def early(bands: DataFrame) -> DataFrame:
    """(kind, rank, id, label, start, end) of the bands that end before the window, by start."""
    order = Window.partitionBy("kind").orderBy("start", "end", "first_seq", "id")
    return bands.where("early").select("kind", F.row_number().over(order).alias("rank"), "id", "label", "start", "end")


def lanes(bands_: DataFrame) -> DataFrame:
    """(id, kind, lane, zone): bands of a kind in the first lane that is free when they start; zones stack by kind."""
    found = settle(packed(bands_.where("not early")), "lanes")
    depth = found.groupBy("kind").agg((F.max("lane") + 1).alias("depth"))
    # Kinds without bands still take their least width, so all zones are laid out.
    spark = bands_.sparkSession
    zones = spark.createDataFrame([(z, i + 1, 0 if z == "council" else 1) for i, z in enumerate(ZONES)], "kind string, place int, least int")
    sized = zones.join(depth, "kind", "left").withColumn("depth", F.greatest(F.coalesce("depth", F.lit(0)), "least"))
    base = F.coalesce(F.sum("depth").over(Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # three rows
    return found.join(F.broadcast(sized.select("kind", base.cast("int").alias("zone"))), "kind").select("id", "kind", "lane", "zone")


def node_radius(view: str, is_source: Column, type_: Column, degree: Column) -> Column:
    root = F.sqrt(degree)
    if view != "explore":
        return F.when(F.coalesce(is_source, F.lit(False)), 5.0).otherwise(3.0)
    return F.when(type_ == "scripture", 3 + root * 1.1).when(type_ == "author", 3.5 + root * 1.3).otherwise(F.when(F.coalesce(is_source, F.lit(False)), 14.0).otherwise(3.2) + root * 1.5)


def node_at(nodes: DataFrame, x: float, y: float, view: str = "explore") -> DataFrame:
    """The node under a point of the screen, the nearest of several: one row or none. Nodes carry sx, sy and op."""
    d = (F.col("sx") - x) ** 2 + (F.col("sy") - y) ** 2
    reach = node_radius(view, F.col("is_source"), F.col("type"), F.col("degree")) + 4
    return nodes.where((F.col("op") > 0.05) & (d <= reach * reach)).select("id", d.alias("d"), "first_seq").orderBy("d", "first_seq").limit(1)


def band_at(rects: DataFrame, x: float, y: float, slack: float = 3) -> DataFrame:
    """The first rectangle (x0, x1, y0, y1, seq) that holds a point, a little wider across."""
    return rects.where((F.lit(x) >= F.col("x0") - slack) & (F.lit(x) <= F.col("x1") + slack) & F.lit(y).between(F.col("y0"), F.col("y1"))).orderBy("seq").limit(1)


def edge_tiers(edges: DataFrame, lit: DataFrame | None, focus: Sequence[str] = ()) -> DataFrame:
    """(source, target, type, tier): 0 dimmed, 1 lit at both ends, 2 lit and touching the focus. Without a highlight all are lit."""
    rows = edges.select("source", "target", "type")
    if lit is None:
        on = F.lit(True)
    else:
        ids = lit.select("id").distinct().withColumn("on", F.lit(True))
        rows = rows.join(ids.select(F.col("id").alias("source"), F.col("on").alias("_a")), "source", "left").join(ids.select(F.col("id").alias("target"), F.col("on").alias("_b")), "target", "left")
        on = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    near = F.col("source").isin(list(focus)) | F.col("target").isin(list(focus)) if focus else F.lit(False)
    return rows.select("source", "target", "type", F.when(on & near, 2).when(on, 1).otherwise(0).alias("tier"))


def edge_fade(view: str, scale: Column) -> Column:
    return F.lit(1.0) if view == "explore" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (scale - 0.3) / 0.4))


def labels(nodes: DataFrame, lit: DataFrame | None, selected: Sequence[str] = (), bridges: Sequence[str] = (), filtered: bool = False, small: int = 30, chrono: bool = False) -> DataFrame:
    """(id, why) of the nodes whose label shows: pinned, a small neighbourhood's, a filter's well-connected ones, or the large documents'."""
    rows = nodes.select("id", "type", "degree")
    if lit is not None:
        rows = rows.join(lit.select("id").distinct().withColumn("member", F.lit(True)), "id", "left").withColumn("member", F.coalesce("member", F.lit(False)))
        count = lit.select("id").distinct().agg((F.count("*") <= small).alias("few"))
        rows = rows.crossJoin(F.broadcast(count))  # one row
    else:
        rows = rows.withColumn("member", F.lit(True)).withColumn("few", F.lit(False))
    pinned = F.col("id").isin(list(selected)) | F.col("id").isin(list(bridges)) if selected or bridges else F.lit(False)
    near = F.col("few") & F.col("member") if lit is not None and len(selected) <= 1 else F.lit(False)
    chosen = F.col("member") & (F.col("degree") >= 12) if filtered and lit is not None else F.lit(False)
    large = (F.col("type") == "document") & (F.col("degree") >= 16) & F.col("member") if not chrono else F.lit(False)
    why = F.when(pinned, "pinned").when(near, "neighbour").when(chosen, "filter").when(large, "large")
    return rows.withColumn("why", why).where("why is not null").select("id", "why")


def stack_labels(points: DataFrame, gap: float) -> DataFrame:
    """``points`` (id, y) with ly: labels pushed down just enough to stand ``gap`` apart, in one window over what a screen shows."""
    down = Window.partitionBy(F.lit(0)).orderBy("y", "id")
    rows = points.withColumn("_i", F.row_number().over(down))
    free = F.max(F.col("y") - F.col("_i") * gap).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("ly", free + F.col("_i") * gap).drop("_i")


def axis_ticks(spark, year_min: int, year_max: int, years_shown: float) -> DataFrame:
    """(year, major) of the axis's marks: the more years show, the wider their step."""
    step = 100 if years_shown > 350 else 50 if years_shown > 140 else 20 if years_shown > 60 else 10 if years_shown > 30 else 5
    start = -(-year_min // step) * step
    return spark.range(start, year_max + 1, step).select(F.col("id").cast("int").alias("year"), (F.col("id") % 100 == 0).alias("major"))


def frame(points: DataFrame, width: float, height: float, margin: float = 1.18, least: float = 1.0) -> DataFrame:
    """One row (x, y, scale): the camera that shows all points (x, y)."""
    dx, dy = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    fit = F.least(F.lit(width) / (F.greatest(dx, F.lit(least)) * margin), F.lit(height) / (F.greatest(dy, F.lit(least)) * margin))
    return points.agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"), fit.alias("scale"))


def focus_frame(nodes: DataFrame, edges: DataFrame, id_: str, width: float, height: float) -> DataFrame:
    """The camera on a node and its neighbours, neither too near nor too far."""
    near = symmetric(edges.where((F.col("source") == id_) | (F.col("target") == id_))).where(F.col("id") == id_).select(F.col("neighbour").alias("id"))
    rows = nodes.join(near.unionByName(nodes.sparkSession.createDataFrame([(id_,)], "id string")).distinct(), "id", "left_semi")
    return frame(rows, width, height, least=60.0).withColumn("scale", F.greatest(F.lit(0.5), F.least(F.lit(1.6), "scale")))


def to_screen(x: Column, camera: Column, scale: Column, size: float) -> Column:
    return (x - camera) * scale + size / 2


def to_world(s: Column, camera: Column, scale: Column, size: float) -> Column:
    return (s - size / 2) / scale + camera
