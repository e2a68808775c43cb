"""Exact deduplication through a log-structured merge index, in DataFrame operations only.

The index maps the SHA-256 digest of a normalised text (A-Z lower-cased) to the row that stays:

* *flush*: every task's rows are one memtable; it is written as one run, sorted by digest, with Parquet bloom
  filters and min/max statistics on the digest. Flushing needs no shuffle.
* *compaction*: all runs merge into one level that keeps, for each digest, the identifier first in keep order, how
  many rows it has and how many rows share that identifier. Counting is pre-aggregated in each task, so a text that a
  third of all rows hold is still one row a task.
* *hits*: only digests with several rows are hits. A bitmap of fixed size (``FILTER_BITS``) of their hashes lets
  each scan drop the other rows before any text moves; the hits' texts are then compared byte by byte with the
  text of the row that stays. Groups are salted by their size. A hit whose bytes differ (a digest collision) is
  taken out of its group and grouped by its whole text instead.

A task's run is dealt to the tables of digests by hash; where one digest holds very many rows, counting combines in each task first, and the
joins that give rows their verdict have one short row of the level on the other side, so adaptive execution can split them.

Keep order: ``keep="smallest"`` or ``"largest"`` identifier. Defined cases: a very long text is one row like any other, hashed where it is
read and moved only as a possible hit; a null text equals an empty one; a null
identifier is never preferred to another; of several rows with the same identifier and text one stays; other columns
pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import ascii_lower, settle, shared_path

FILTER_BITS = 1 << 26
SALT_ROWS = 1000


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS)) + 1


class LsmIndex:
    """A log-structured merge index from text digests to the row that stays."""

    def __init__(self, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256_digest):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.id_col, self.text_col, self.keep, self.digest = spark, id_col, text_col, keep, digest
        self.runs: list[str] = []

    def _keyed(self, docs: DataFrame) -> DataFrame:
        norm = ascii_lower(F.col(self.text_col))
        return docs.select(F.col(self.id_col).alias("_id"), norm.alias("_norm")).withColumn("_digest", self.digest(F.col("_norm")))

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write one sorted run for each task's memtable; returns the rows (_id, _digest) just written."""
        rows = self._keyed(docs).select("_id", "_digest")
        path = shared_path(self.spark, "lsm-run")
        (rows.sortWithinPartitions("_digest").write.option("parquet.bloom.filter.enabled#_digest", "true").parquet(path))
        self.runs.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def compact(self) -> DataFrame:
        """Merge all runs into one level (_digest, _keep, _rows, _same), sorted by digest, and return it."""
        best = F.min if self.keep == "smallest" else F.max
        by_id = self.spark.read.parquet(*self.runs).groupBy("_digest", "_id").agg(F.count("*").alias("_n"))
        level = by_id.groupBy("_digest").agg(best("_id").alias("_keep"), F.sum("_n").alias("_rows"))
        same = by_id.select("_digest", F.col("_id").alias("_keep"), F.col("_n").alias("_same"))
        merged = level.alias("l").join(
            same.alias("s"), (F.col("l._digest") == F.col("s._digest")) & F.col("l._keep").eqNullSafe(F.col("s._keep"))
        ).select("l._digest", "l._keep", "l._rows", "s._same")
        return settle(merged.sortWithinPartitions("_digest"), "lsm-level")

    def probe(self, keyed: DataFrame, level: DataFrame) -> DataFrame:
        """``keyed`` (with _digest) and _hit: false where the filter shows that no other row has the digest."""
        filters = (
            level.where("_rows > 1")
            .select(_bit(F.col("_digest")).alias("_bit"))
            .groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
        )
        keyed = keyed.withColumn("_bucket", F.bitmap_bucket_number(_bit(F.col("_digest")))).withColumn(
            "_at", F.bitmap_bit_position(_bit(F.col("_digest")))
        )
        byte = F.conv(F.hex(F.expr("substring(_map, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
        # The filter has FILTER_BITS bits at most, however many digests it holds.
        joined = keyed.join(F.broadcast(filters), "_bucket", "left")
        return joined.withColumn("_hit", F.coalesce(bit, F.lit(False))).drop("_bucket", "_at", "_map")

    def hits(self, docs: DataFrame, level: DataFrame) -> DataFrame:
        """(_digest, _id, _norm, _at, _keep, _rows): the rows of ``docs`` whose digest has several rows, found through the filter."""
        maybe = self.probe(self._keyed(docs), level).where("_hit")
        several = level.where("_rows > 1").select("_digest", "_keep", "_rows")
        # Rows are numbered where they are read, so that a task that runs again deals them alike.
        maybe = maybe.select("_digest", "_id", "_norm", F.monotonically_increasing_id().alias("_at"))
        return maybe.join(several, "_digest")

    def collisions(self, docs: DataFrame, level: DataFrame) -> DataFrame:
        """(_digest, _id, _norm) of the hits whose bytes differ from those of the row that stays."""
        salts = F.ceil(F.col("_rows") / SALT_ROWS).cast("int")
        hits = self.hits(docs, level)
        # One text for each group, repeated for each salt: of rows with the identifier that stays, the least text.
        kept = hits.where(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_digest").agg(F.min("_norm").alias("_kept"), F.max("_rows").alias("_rows"))
        kept = kept.select("_digest", "_kept", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
        hits = hits.withColumn("_salt", F.pmod(F.xxhash64("_at"), salts).cast("int"))
        return hits.join(kept, ["_digest", "_salt"]).where(F.col("_norm") != F.col("_kept")).select("_digest", "_id", "_norm")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256_digest) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, digest (binary).

    ``kept`` marks the rows with the identifier and text that stay; rows that share both are marked alike (``deduplicate`` keeps one of them).
    """
    index = LsmIndex(docs.sparkSession, id_col, text_col, keep, digest)
    rows = index.flush(docs)
    level = index.compact()
    odd = settle(index.collisions(docs, level), "lsm-collisions")
    found = rows.join(level, "_digest") if odd.isEmpty() else _with_collisions(index, docs, rows, level, odd, keep)
    same = F.col("_id").eqNullSafe(F.col("_keep"))
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_rows").alias("group_size"), same.alias("kept"), F.col("_digest").alias("digest"))


def _with_collisions(index: LsmIndex, docs: DataFrame, rows: DataFrame, level: DataFrame, odd: DataFrame, keep: str) -> DataFrame:
    """The rows with their groups when digests collide: colliding texts form groups of their own by whole text."""
    best = F.min if keep == "smallest" else F.max
    hit = odd.select("_digest").distinct()
    calm = rows.join(hit, "_digest", "left_anti").join(level, "_digest")
    texts = index._keyed(docs).join(hit, "_digest", "left_semi")
    groups = texts.groupBy("_digest", "_norm").agg(best("_id").alias("_keep"), F.count("*").alias("_rows"))
    clash = texts.join(groups, ["_digest", "_norm"])
    return calm.select("_digest", "_id", "_keep", "_rows").unionByName(clash.select("_digest", "_id", "_keep", "_rows"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256_digest) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    Rows that the filter of hits excludes stay without any shuffle of their texts; only possible hits are looked up
    in the compacted level.
    """
    index = LsmIndex(docs.sparkSession, id_col, text_col, keep, digest)
    index.flush(docs)
    level = index.compact()
    best = F.min if keep == "smallest" else F.max
    odd = settle(index.collisions(docs, level), "lsm-collisions")
    # The row travels as one struct, so that its column names never meet those used here.
    work = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_norm"))
    probed = index.probe(work.withColumn("_digest", digest(F.col("_norm"))), level)
    alone = F.col("_id").eqNullSafe(F.col("_keep"))
    calm = probed.where("_hit").select("_row", "_id", "_norm", "_digest")
    clash = calm.limit(0).select("_row", F.col("_norm").alias("_part"), "_digest", F.lit(1).cast("long").alias("_same"))
    if not odd.isEmpty():
        hit = odd.select("_digest").distinct()
        by_id = calm.join(hit, "_digest", "left_semi").groupBy("_digest", "_norm", "_id").agg(F.count("*").alias("_same"))
        groups = by_id.groupBy("_digest", "_norm").agg(best("_id").alias("_keep"))
        groups = by_id.withColumnRenamed("_id", "_kid").join(groups, ["_digest", "_norm"])
        groups = groups.where(F.col("_kid").eqNullSafe(F.col("_keep"))).select("_digest", "_norm", "_keep", "_same")
        clash = calm.join(groups, ["_digest", "_norm"]).where(alone).select("_row", F.col("_norm").alias("_part"), "_digest", "_same")
        calm = calm.join(hit, "_digest", "left_anti")
    calm = calm.join(level.select("_digest", "_keep", "_same"), "_digest").where(alone)
    stay = calm.select("_row", F.lit("").alias("_part"), "_digest", "_same").unionByName(clash)
    again = stay.where("_same > 1").groupBy("_digest", "_part").agg(F.first("_row").alias("_row"))
    kept = probed.where("not _hit").select("_row").unionByName(stay.where("_same = 1").select("_row"))
    return kept.unionByName(again.select("_row")).select("_row.*")
