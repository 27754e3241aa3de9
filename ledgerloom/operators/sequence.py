"""Ordered numbering and running sums that stay parallel under skew.

``row_number()`` / running ``sum()`` windows put every row of one group in
one task.  When one account holds a third of all rows that task is the job.
Here the rows are range-partitioned on (group, order), so a hot group is
spread over several partitions; each partition numbers its own slice, and
the slices are stitched together with per-(partition, group) offsets.  The
offset table has at most one row per (partition, group) pair, so the only
window over groups runs on a frame bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark import StorageLevel
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


#: Excluded numbers are broadcast up to ranges of this size.
BROADCAST_NUMBERS = 1_000_000

# Frames kept by ``materialise``, until ``release``.
_KEPT: list[DataFrame] = []


def release() -> None:
    """Unpersist every kept frame; call it once the outputs are written."""
    while _KEPT:
        _KEPT.pop().unpersist()


def materialise(df: DataFrame, how: str = "persist") -> DataFrame:
    """Compute a frame once for several consumers.

    ``persist``: cached (memory, spilling to disk), recomputed from lineage
    if an executor is lost.  ``checkpoint``: written to the shared folder
    named by ``spark.checkpoint.dir`` and the lineage cut.
    """
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return _KEPT[-1]
    return df


def ranked_within(df: DataFrame, group_cols: list[str], order_cols: list, value_col: str | None = None,
                  rank_col: str = "seq", running_col: str = "running",
                  num_partitions: int | None = None, value_cols: list[str] | None = None,
                  materialize: str = "persist", beside: list[DataFrame] | None = None) -> DataFrame:
    """Add ``rank_col`` (1, 2, ... within each group, in order) and running
    sums: ``running_col`` for ``value_col`` and ``running_<c>`` for each of
    ``value_cols`` (inclusive of the current row).

    ``order_cols`` must order rows totally within a group (add a unique id
    as last key); then the result is deterministic, also on task retries.
    An empty ``group_cols`` numbers the whole frame.

    ``beside``: frames keyed by the group columns. Their other columns come
    with the offsets (left join), so the rows are shuffled once for both.
    """
    # without a number Spark starts with a shuffle's usual one and joins small neighbours, which keeps the order
    n = [num_partitions] if num_partitions else []
    g = list(group_cols) if group_cols else []
    gkey = g if g else ["_g"]
    base = df if g else df.withColumn("_g", F.lit(0))
    order = _cols(order_cols)
    sums = {}
    if value_col:
        sums[value_col] = running_col
    for c in value_cols or []:
        sums[c] = f"running_{c}"

    # Range partitions hold contiguous slices of (group, order); sorted
    # inside, the id from monotonically_increasing_id() is the position in
    # the slice.  Both branches below (slice sizes, rows) must see the same
    # ids, so the tagged frame is materialised once: persisted (default) or
    # checkpointed to the shared folder (``materialize="checkpoint"``, which
    # also cuts the lineage).  A lost cached block is recomputed from the
    # same range bounds and total order, so the ids do not change.
    ranged = (base.repartitionByRange(*n, *[F.col(c) for c in gkey], *order)
              .sortWithinPartitions(*[F.col(c) for c in gkey], *order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = materialise(ranged, materialize)

    # slice sizes and their prefix over partitions of the same group; this
    # window sees at most one row per partition for a group
    aggs = ([F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")]
            + [F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    sizes = ranged.groupBy("_pid", *gkey).agg(*aggs)
    w_off = Window.partitionBy(*gkey).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_noff", F.coalesce(F.sum("_n").over(w_off), F.lit(0)))
    keep = ["_pid", *gkey, "_noff", "_m0"]
    for i, _ in enumerate(sums):
        offs = offs.withColumn(f"_soff{i}", F.sum(f"_s{i}").over(w_off))
        keep.append(f"_soff{i}")
    offs = offs.select(*keep)
    for frame in beside or []:
        offs = offs.join(frame, gkey, "left")
    if not g:
        offs = F.broadcast(offs)  # one row per partition: bounded by n

    local = ranged
    if sums:
        # running sums inside one (partition, group) slice
        w_run = (Window.partitionBy("_pid", *gkey).orderBy(*order)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for i, c in enumerate(sums):
            local = local.withColumn(f"_lsum{i}", F.sum(c).over(w_run))
    out = local.join(offs, ["_pid", *gkey])
    out = out.withColumn(rank_col, (F.col("_noff") + F.col("_mid") - F.col("_m0") + 1).cast("bigint"))
    drop = ["_pid", "_mid", "_m0", "_noff"]
    for i, (c, name) in enumerate(sums.items()):
        zero = F.lit(0).cast(df.schema[c].dataType)
        out = out.withColumn(name, F.coalesce(F.col(f"_soff{i}"), zero) + F.coalesce(F.col(f"_lsum{i}"), zero))
        drop += [f"_lsum{i}", f"_soff{i}"]
    if not g:
        drop.append("_g")
    return out.drop(*drop)


def rank_ascending_range(spark, lo: Column, hi: int, exclude: DataFrame | None = None,
                         num_partitions: int | None = None) -> DataFrame:
    """Integers ``lo..hi`` not in ``exclude`` (column ``number``), ranked
    1, 2, ... ascending, as (number, k).

    ``spark.range`` already yields contiguous ascending slices per
    partition, and the excluded numbers are cut to ``[lo, hi]`` (at most
    hi - lo + 1 rows, so broadcasting them is bounded) and removed with a
    broadcast anti join, which keeps the slices in place: no sort, no
    shuffle of the range. Ranges above ``BROADCAST_NUMBERS`` are anti joined
    without a hint and ranked like any rows.
    """
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nums = spark.range(1, hi + 1, numPartitions=n).select(F.col("id").alias("number")).filter(F.col("number") >= lo)
    if exclude is not None:
        ex = (exclude.select(F.col("number").cast("bigint").alias("number"))
              .filter((F.col("number") >= lo) & (F.col("number") <= hi)).distinct())
        if hi > BROADCAST_NUMBERS:
            return ranked_within(nums.join(ex, "number", "left_anti"), [], ["number"], rank_col="k").select("number", "k")
        nums = nums.join(F.broadcast(ex), "number", "left_anti")
    tagged = (nums.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_pid", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_noff"))
    out = tagged.join(F.broadcast(offs), "_pid")
    return out.select("number", (F.col("_noff") + F.col("_mid") - F.col("_m0") + 1).cast("bigint").alias("k"))
