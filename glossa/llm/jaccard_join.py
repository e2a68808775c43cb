"""N-gram Jaccard join: a metric-space join on the Jaccard distance of word-shingle sets, exact in its components.

Documents whose sets are equal form one class; classes are joined. The distance 1 - J is a metric, but documents that share
nothing all lie at distance 1 from each other, so pivots drawn from the documents alone would send every document to
every region. The join therefore has two levels of pivots:

1. *Shingle pivots.* The home region of a class is that of its rarest shingle (the Voronoi cell among one-shingle pivots, ties
   in distance broken by rarity). Boundary windows: a partner within the threshold misses fewer than n - ceil(t n) + 1 of
   a set's n shingles, so a class is replicated to the regions of that many of its rarest shingles, and two classes within
   the threshold always meet. Rarity comes from a count sketch of fixed size (``BUCKETS``) over all documents; any order gives
   the same result, a good one gives small regions.
2. *Document pivots.* In each region the least class is the pivot, and its true distances to the region's other classes
   are computed (once for a pair, however many regions it meets in). Classes linked to one pivot need no comparison with each
   other: their component is known. Regions whose classes are then all of one component are closed. In the others each class
   outside the largest component meets the classes whose distance to the pivot differs from its own by at most the
   threshold (triangle inequality); regions over BLOCK_BYTES of text are cut into blocks that meet pairwise.

No region's pairs are ever expanded for copies or for near copies that a pivot links, and no component is split for it.
The links are a spanning set of each component, not all of its links, so they give no number of links by document.
Nothing recurses: an oversize region is cut into blocks once.
Shingles and sets are compared by 64-bit digests (two different ones share a digest with probability 2**-64 a pair).

Defined cases: a null text or one without words has an empty set, is linked with nothing and is its own component; fewer words than
the width give one shingle of the whole sequence; rows of equal id and other columns are kept (a component's id is the least
non-null id in it; null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glossa.llm.common import exchanges_go, forget, mix, partitions, raw, settle, shingle_set, shingle_sets, string_blocks
from glossa.llm.components import connected_components

WIDTH, PERCENT = 5, 75
BUCKETS, CHUNK = 1 << 22, 1 << 15
BLOCK_BYTES, SMALL = 1 << 20, 8
SALT_PAIRS = 500
FILTER_BITS = 1 << 24
SEEN = 200_000


def digest(sets: np.ndarray) -> int:
    """A 64-bit digest of a sorted set, as a signed number; 0 is kept for the empty set."""
    if not len(sets):
        return 0
    h = sets * (np.arange(len(sets), dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    return int(mix(np.array([h.sum() + np.uint64(len(sets))], dtype=np.uint64)).astype(np.int64)[0]) or 1


def window_size(n: int, percent: int = PERCENT) -> int:
    """How many of a set's n shingles, rarest first, a partner within the threshold cannot all miss."""
    return n - -(-n * percent // 100) + 1


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for _, _, arr in string_blocks(batch, "_text", 1 << 18):
        yield from shingle_sets(*raw(arr), width)


def _first_pass(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, np.ndarray]:
    """Rows (_id, n, c) of each document, and the commonness of shingle buckets: one reading of the texts gives both.

    The table of that reading, which holds each task's sketch beside the rows, is deleted once the sketches are added up.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, id_type, task = np.zeros(BUCKETS, dtype=np.uint32), set(), None, 0
        for batch in batches:
            id_type = batch.schema.field("_id").type
            n, c = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in enumerate(_sets(batch, width)):
                n[i], c[i] = len(s), digest(s)
                if len(s) and int(c[i]) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(int(c[i]))
                    np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
            task = (task * 31 + int(c.sum() & 0x7FFFFFFF)) & 0x7FFFFFFF
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n), pa.array(c), *none], names=["_id", "n", "c", "part", "task", "counts"])
        if id_type is not None:
            parts = range(BUCKETS // CHUNK)
            blobs = [zlib.compress(counts[p * CHUNK : (p + 1) * CHUNK].tobytes(), 1) for p in parts]
            k = len(blobs)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(parts, pa.int32()), pa.array([task & 63] * k, pa.int32()), pa.array(blobs, pa.binary())],
                names=["_id", "n", "c", "part", "task", "counts"],
            )

    fields = [StructField("_id", docs.schema[id_col].dataType), *StructType.fromDDL("n long, c long, part int, task int, counts binary").fields]
    read = settle(base.mapInArrow(run, StructType(fields)), "jaccard-read")
    common = _commonness(read)
    sets = settle(read.where(F.col("c").isNotNull()).select("_id", "n", "c"), "jaccard-sets")
    forget(read)
    return sets, common


def _add_up(sketches: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """The sum of the sketches of equal ``keys``, one chunk in memory at a time; of the ``last`` sums a byte of their logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def row() -> pa.RecordBatch:
            out = np.minimum(np.log2(total + 1.0) * 7, 255).astype(np.uint8) if last else total
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["part", "task", "counts"])

        for batch in batches:
            for part, task, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "task", "counts")), strict=True):
                now = (part, task if "task" in keys else 0)
                if now != key:
                    if key is not None:
                        yield row()
                    key, total = now, np.zeros(CHUNK, dtype=np.uint32)
                more = np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
                total = np.where(total > np.uint32(2**32 - 1) - more, np.uint32(2**32 - 1), total + more)
        if key is not None:
            yield row()

    dealt = sketches.repartition(partitions(sketches.sparkSession), *keys).sortWithinPartitions("part", "task")
    return dealt.mapInArrow(run, "part int, task int, counts binary")


def _commonness(first: DataFrame) -> np.ndarray:
    """For each of BUCKETS shingle buckets a byte that grows with the logarithm of its count: a fixed size at any scale."""
    sketches = first.where(F.col("part").isNotNull()).select("part", "task", "counts")
    out = np.zeros(BUCKETS, dtype=np.uint8)
    with exchanges_go(first.sparkSession):
        sums = _add_up(_add_up(sketches, ["part", "task"]), ["part"], last=True).collect()  # BUCKETS bytes
    for row in sums:
        out[row["part"] * CHUNK : (row["part"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint8)
    return out


def _regions(docs: DataFrame, text_col: str, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """(key, c, n, r): each class in the regions of its home and boundary shingles.

    ``n`` is the set's size, ``r`` how many of its shingles are no rarer than the key: if the key is the first that two sets
    share, they share at most the lesser ``r`` of them.
    """
    base = docs.select(F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        lists = keys, owners, sizes = [], [], []

        def rows_of() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(x)) for x in lists]
            for x in lists:
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=["key", "c", "nr"])

        for batch in batches:
            size = 0
            for s in _sets(batch, width):
                c = digest(s)
                if not len(s) or c in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                n = len(s)
                k = window_size(n, percent)
                order = (common[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                near = np.argpartition(order, k - 1)[:k] if k < n else np.arange(n)
                part = s[near[np.argsort(order[near], kind="stable")]]
                keys.append((part >> np.uint64(16)).astype(np.int64))
                owners.append(np.full(k, c, dtype=np.int64))
                sizes.append((n << 32) + np.arange(n, n - k, -1, dtype=np.int64))
                size += k
                if size > 300_000:
                    yield rows_of()
                    size = 0
            if keys:
                yield rows_of()

    # Rows cross the exchange packed: 48 bits of the shingle (more sets may meet for it, none fewer), and n and r as one number.
    dealt = base.mapInArrow(run, "key long, c long, nr long").repartition(partitions(docs.sparkSession), "key")
    return dealt.select("key", "c", F.shiftright("nr", 32).cast("int").alias("n"), F.col("nr").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("r"))


def _cells(regions: DataFrame, percent: int) -> DataFrame:
    """(key, k, m, mn, mr, c, n, r): the regions of several classes, cut where sizes leave a gap that no link can cross.

    ``k`` is the cell's number of rows; ``m`` is the pivot, its least class, and ``mn`` and ``mr`` are its size and reach.
    """
    by_key = Window.partitionBy("key").orderBy("n", "c")
    apart = lambda small, large: F.col(small) * 100 < F.col(large) * percent
    rows = regions.withColumn("a", F.lag("n").over(by_key)).withColumn("b", F.lead("n").over(by_key))
    rows = rows.withColumn("starts", F.col("a").isNull() | apart("a", "n")).withColumn("ends", F.col("b").isNull() | apart("n", "b"))
    rows = rows.where("not (starts and ends)").select("key", "c", "n", "r", "starts")
    rows = rows.withColumn("cell", F.sum(F.col("starts").cast("int")).over(by_key))
    # Still dealt by key, so these windows need no further exchange.
    in_cell = Window.partitionBy("key", "cell")
    rows = rows.withColumn("p", F.min(F.struct("c", "n", "r")).over(in_cell)).withColumn("k", F.count("*").over(in_cell))
    rows = rows.where("c <> p.c or n <> p.n").withColumn("mn", F.col("p.n")).withColumn("mr", F.col("p.r"))
    # Most cells are two sets that share one shingle by chance: they go unless they can be linked.
    return rows.where((F.col("k") > 2) | _candidate(percent)).select(F.xxhash64("key", "cell").alias("key"), "k", F.col("p.c").alias("m"), "mn", "mr", "c", "n", "r")


def _texts(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(c, text) of the ``wanted`` classes (c), one text each, found through a filter of FILTER_BITS bits."""
    bit = F.pmod(F.xxhash64("c"), F.lit(FILTER_BITS)) + 1
    maps = wanted.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    filters = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in maps.collect():  # FILTER_BITS bits at most
        filters[(row["k"] - 1) * 4096 : row["k"] * 4096] = np.frombuffer(row["m"], dtype=np.uint8)
    base = docs.select(F.col(text_col).alias("_text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            c = np.array([digest(s) for s in _sets(batch, width)], dtype=np.int64)
            fresh = np.array([x != 0 and x not in seen and not seen.add(x) for x in c.tolist()], dtype=bool)
            if len(seen) > SEEN:
                seen.clear()
            keep = pa.array(fresh & _may_hold(filters, c))
            yield pa.RecordBatch.from_arrays([pa.array(c), batch.column("_text")], names=["c", "text"]).filter(keep)

    found = base.mapInArrow(digests, "c long, text string").join(wanted, "c", "left_semi")
    return found.groupBy("c").agg(F.first("text").alias("text"))


def _may_hold(filters: np.ndarray, c: np.ndarray) -> np.ndarray:
    at = (_xxhash_long(c) % FILTER_BITS).astype(np.int64)
    return (filters[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _xxhash_long(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column (seed 42), as signed numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.full(len(x), 42, dtype=np.uint64) + p5 + np.uint64(8)
    h ^= turn(x.astype(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    return h.astype(np.int64)


def _distances(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(m, c, inter, size_m, size_c) of the pairs (m, c): each pivot's text meets its partners' in tasks of SALT_PAIRS pairs."""
    spark = pairs.sparkSession
    salts = pairs.groupBy("m").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("s"))
    rows = pairs.join(salts, "m").select("m", F.pmod(F.xxhash64("c"), F.col("s")).cast("int").alias("s"), "c")
    rows = rows.join(texts, "c").select("m", "s", "c", F.lit(1).alias("o"), "text")
    heads = salts.join(texts.withColumnRenamed("c", "m"), "m").select("m", F.explode(F.expr("sequence(0, s - 1)")).alias("s"), F.col("m").alias("c"), F.lit(0).alias("o"), "text")
    dealt = rows.unionByName(heads).repartition(partitions(spark), "m", "s").sortWithinPartitions("m", "s", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for m, c, o, text in zip(batch.column("m").to_pylist(), batch.column("c").to_pylist(), batch.column("o").to_pylist(), batch.column("text"), strict=True):
                s = shingle_set(text.as_buffer(), width)
                if not o:
                    head, own = m, s
                elif head == m:
                    both = np.concatenate((own, s))
                    both.sort()
                    out.append((m, c, int((both[1:] == both[:-1]).sum()), len(own), len(s)))
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(cols, names=["m", "c", "inter", "size_m", "size_c"])

    return dealt.mapInArrow(run, "m long, c long, inter long, size_m long, size_c long")


def _candidate(percent: int):
    """Whether sets of n and mn shingles that share a key first, with reaches r and mr, can be linked."""
    return (100 + percent) * F.least("r", "mr") >= percent * (F.col("n") + F.col("mn"))


def _linked(percent: int):
    return F.col("inter") * 100 >= percent * (F.col("size_m") + F.col("size_c") - F.col("inter"))


def _open_regions(region: DataFrame, done: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(key, c, sim, label, outside): the regions that still hold classes of different components, one of each equal membership.

    ``sim`` is the class's similarity to the region's pivot; ``outside`` marks the classes outside the region's largest component.
    """
    # A pair that is no candidate in any region has no distance.
    near = done.select("m", "c", (F.col("inter") / (F.col("size_m") + F.col("size_c") - F.col("inter"))).alias("sim"))
    # A class whose reach is too small for a link with even the region's smallest set has nothing open here.
    least = region.groupBy("key").agg(F.min("n").alias("n0"))
    live = region.join(least, "key").where((100 + percent) * F.col("r") >= percent * (F.col("n") + F.col("n0")))
    named = live.select("key", "m", "c").distinct().join(near, ["m", "c"], "left").select("key", "c", "sim")
    named = named.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    sign = F.sum(F.pmod(F.xxhash64("c"), F.lit(1 << 44)))
    groups = named.groupBy("key").agg(F.count("*").alias("k"), sign.alias("sign"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    groups = groups.groupBy("k", "sign").agg(F.min("key").alias("key")).select("key")
    named = named.join(groups, "key")
    owned = named.groupBy("key", "label").agg(F.count("*").alias("own"))
    largest = owned.groupBy("key").agg(F.max_by("label", F.struct("own", "label")).alias("main"))
    return named.join(largest, "key").withColumn("outside", F.col("label") != F.col("main")).drop("main")


def _inner_links(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) links between classes of different components within each open region, enough to join those components.

    Every class outside the region's largest component meets every other class of the region in one task: regions over
    BLOCK_BYTES of text are cut into blocks, and each block of outside classes meets each block of all classes.
    """
    spark = open_.sparkSession
    # Blocks are laid out by the texts' lengths alone; the texts join in once, at the end.
    rows = open_.join(texts.select("c", (F.octet_length("text") + 64).alias("size")), "c")
    cuts = rows.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("nj"), F.ceil(F.sum(F.when(F.col("outside"), F.col("size")).otherwise(0)) / BLOCK_BYTES).cast("int").alias("ni"))
    rows = rows.join(cuts, "key")
    at = F.pmod(F.xxhash64("c"), F.lit(1 << 30))
    cols = ["key", "i", "j", "side", "c", "label", "sim"]
    outer = rows.where("outside").withColumn("i", (at % F.col("ni")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, nj - 1)"))).withColumn("side", F.lit(0))
    inner = rows.withColumn("j", (at % F.col("nj")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, ni - 1)"))).withColumn("side", F.when(F.col("outside"), 2).otherwise(1))
    # A block's outside classes that also stand among all classes of it come with their text once (side 3).
    twice = F.when((F.col("side") == 2) & ((at % F.col("ni")).cast("int") == F.col("i")), True).otherwise(False)
    outer = outer.where((at % F.col("nj")).cast("int") != F.col("j"))
    inner = inner.withColumn("side", F.when(twice, 3).when(F.col("side") == 2, 1).otherwise(F.col("side")))
    dealt = outer.select(cols).unionByName(inner.select(cols)).join(texts, "c").repartition(partitions(spark), "key", "i", "j")
    dealt = dealt.sortWithinPartitions("key", "i", "j", F.asc_nulls_last("sim"))
    cols = [*cols, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for *now, side, c, label, sim, text in zip(*(batch.column(x).to_pylist() for x in cols), strict=True):
                if now != key:
                    found += _block_links(group, percent)
                    key, group = now, []
                group.append((side, c, label, sim, shingle_set(text, width)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        found = _block_links(group, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _block_links(group: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between a block's outside classes and all its classes, one for each pair of components it joins.

    Only shingles that stand in several sets can add to an intersection; their incidence is multiplied out in dense pieces. Both
    sides are in order of similarity to the pivot, so an outside class meets the window the triangle inequality leaves.
    """
    outer = [g for g in group if g[0] in (0, 3)]
    inner = [g for g in group if g[0] in (1, 3)]
    if not outer or not inner:
        return []
    sets = [g[4] for g in outer] + [g[4] for g in inner]
    sizes = np.array([len(x) for x in sets], dtype=np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    values, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[code] > 1
    column = np.cumsum(counts > 1) - 1
    code, owner = column[code[shared]], owner[shared]
    n, width = len(outer), int(column[-1]) + 1 if len(column) else 0
    sims = np.array([np.inf if g[3] is None else g[3] for g in inner])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    found = []
    slack = 1 - percent / 100 + 1e-9
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, n, 256):
        b = min(a + 256, n)
        known = [g[3] for g in outer[a:b] if g[3] is not None]
        lo, hi = (int(np.searchsorted(sims, known[0] - slack, "left")), int(np.searchsorted(sims, known[-1] + slack, "right"))) if len(known) == b - a else (0, len(inner))
        meet = np.concatenate((np.arange(lo, hi), np.arange(max(hi, int(np.searchsorted(sims, np.inf))), len(inner))))
        if not len(meet):
            continue
        place = np.full(len(inner), -1)
        place[meet] = np.arange(len(meet))
        inter = np.zeros((b - a, len(meet)), dtype=np.float32)
        for first in range(0, width, 2048):
            p, q = np.searchsorted(code, (first, first + 2048))
            who, col = owner[p:q], code[p:q] - first
            left, right = np.zeros((b - a, 2048), np.float32), np.zeros((len(meet), 2048), np.float32)
            mine = (who >= a) & (who < b)
            left[who[mine] - a, col[mine]] = 1
            theirs = who >= n
            theirs[theirs] = place[who[theirs] - n] >= 0
            right[place[who[theirs] - n], col[theirs]] = 1
            inter += left @ right.T
        union = sizes[a:b, None] + sizes[None, n + meet] - inter
        for x, y in zip(*np.nonzero(inter.astype(np.float64) * 100 >= percent * union.astype(np.float64)), strict=True):
            u, v = outer[a + int(x)], inner[int(meet[y])]
            ru, rv = find(u[2]), find(v[2])
            if ru != rv:
                root[ru] = rv
                found.append((u[1], v[1]))
    return found


def class_links(docs: DataFrame, text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, common: np.ndarray | None = None, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The classes' links that join their components, (u, v), and the labels of linked classes, (node, label)."""
    common = common if common is not None else _first_pass(docs, id_col, text_col, width)[1]
    region = settle(_cells(_regions(docs, text_col, width, percent, common), percent), "jaccard-regions")
    small, other = F.col("k") <= SMALL, region.select("key", F.col("c").alias("m"), F.col("n").alias("mn"), F.col("r").alias("mr"), "k").where(F.col("k") <= SMALL).drop("k")
    star = region.where(_candidate(percent)).select("m", "c")
    inner = region.where(small).select("key", "c", "n", "r").join(other, "key").where(F.col("m") < F.col("c")).where(_candidate(percent)).select("m", "c")
    pairs = settle(star.unionByName(inner).distinct(), "jaccard-pairs")
    wanted = pairs.select("c").unionByName(pairs.select(F.col("m").alias("c"))).unionByName(region.where(~small).select("c")).distinct()
    texts = settle(_texts(docs, text_col, width, wanted), "jaccard-texts")
    done = settle(_distances(pairs, texts, width), "jaccard-distances")
    links = done.where(_linked(percent)).select(F.col("m").alias("u"), F.col("c").alias("v"))
    labels = settle(connected_components(links), "jaccard-labels")
    open_ = settle(_open_regions(region.where(~small), done, labels, percent), "jaccard-open")
    if not open_.isEmpty():
        links = links.unionByName(settle(_inner_links(open_, texts, width, percent), "jaccard-links"))
        forget(labels)
        labels = settle(connected_components(links), "jaccard-labels")
    forget(region, pairs, texts, open_)
    return links, labels


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, class_id (documents of one set share it; 0: empty), label (the component's least class)."""
    rows, common = _first_pass(docs, id_col, text_col, width)
    _, labels = class_links(docs, text_col, width, percent, common, id_col)
    classes = rows.where("c <> 0").groupBy("c").agg(F.min("_id").alias("least"))
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(least, "label").select("c", "component", "label")
    out = rows.join(named, "c", "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("c") == 0, F.col("_id")).otherwise(F.col("component")).alias("component_id"), F.col("c").alias("class_id"), "label",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one of least id.

    Rows without words stay all. Rows whose id is shared or null: of the rows of a component that have its least id (or,
    where all its ids are null, no id) one stays.
    """
    found = components(docs, id_col, text_col, width, percent)
    found = settle(found.select(F.col(id_col).alias("_id"), F.col("component_id").alias("_comp"), "class_id", "label"), "jaccard-found")
    go = ~F.col("_id").eqNullSafe(F.col("_comp"))
    counts = found.groupBy("_id").agg(F.count("*").alias("_k"), F.max(go).alias("_go"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    doubtful = counts.where("_k > 1 or _id is null").select("_id")
    # Where an id has one row, the verdict is the id's; rows of doubtful ids are judged by their text's class below.
    calm = rows.join(counts.where("_id is not null and (_go or _k > 1)").select("_id"), "_id", "left_anti").where(F.col("_id").isNotNull())
    if doubtful.isEmpty():
        return calm.select("_row.*")
    twice = doubtful.where("_id is not null")
    odd = _classed(rows.join(twice, "_id", "left_semi").unionByName(rows.where(F.col("_id").isNull())), width)
    comp = found.where("class_id <> 0").groupBy("class_id").agg(F.min("_comp").alias("_comp"), F.min("label").alias("label"))
    one = odd.join(comp, "class_id").where(F.col("_id").eqNullSafe(F.col("_comp"))).groupBy("label").agg(F.first("_row").alias("_row"))
    return calm.select("_row").unionByName(one.select("_row")).unionByName(odd.where("class_id = 0").select("_row")).select("_row.*")


def _classed(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (_row, _id, _text) with the class of each text."""
    base = rows.select("_row", "_id", F.col("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.array([digest(s) for s in _sets(batch, width)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(c)], names=["_row", "_id", "class_id"])

    return base.mapInArrow(run, StructType([*base.select("_row", "_id").schema.fields, StructField("class_id", LongType())]))
