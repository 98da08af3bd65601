"""Order, batch and shard numbers without a single-partition sort.

``global_index`` gives every row its position in a total order:

1. range-partition on the order key and sort inside each task;
2. checkpoint (reliable, to the shared folder) so the two passes below see
   the same rows in the same places even if an executor is lost;
3. count rows per partition - at most ``n`` rows, one per partition;
4. running sum of those counts -> offset per partition (a table whose size
   is the partition count, so broadcasting it is bounded by construction);
5. position = offset + position inside the partition.

A global ``row_number()`` window would instead move every row to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID, _LOCAL = "_pid", "_local"


def global_index(df: DataFrame, order: list, name: str = "pos", n_parts: int | None = None,
                 base: int = 0) -> DataFrame:
    """Add ``name`` = position of the row in the order ``order`` (which must
    be a total order: end it with a unique key).  ``base`` 0 or 1."""
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fixed_rows = cut_lineage(ranged)
    local = fixed_rows.select(
        "*", F.spark_partition_id().alias(_PID),
        (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
        .alias(_LOCAL))
    counts = local.groupBy(_PID).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        _PID, (F.sum("_n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = local.join(F.broadcast(offsets), _PID, "inner")
    pos = F.coalesce(F.col("_off"), F.lit(0)) + F.col(_LOCAL) + F.lit(base)
    return out.select(*df.columns, pos.alias(name))


def shuffle_key(seed: int, epoch, key: str = "sample_id") -> Column:
    """Deterministic per-epoch order key md5('<seed>:<epoch>:<id>')."""
    ep = epoch if isinstance(epoch, Column) else F.lit(str(epoch))
    return F.md5(F.concat(F.lit(f"{seed}:"), ep.cast("string"), F.lit(":"), F.col(key).cast("string")))


def seeded_shuffle(df: DataFrame, seed: int, epoch: int, key: str = "sample_id",
                   split: str | None = "split", shuffled_splits=("train",),
                   keep_order: str = "sample_id", name: str = "pos") -> DataFrame:
    """Positions in a per-epoch seeded order for the shuffled splits; the
    other splits keep their order (``keep_order``).  Positions restart at 1
    within each split when a split column is given."""
    sk = shuffle_key(seed, epoch, key)
    if split is None:
        return global_index(df.withColumn("_k", sk), ["_k", key], name, base=1).drop("_k")
    shuffled = F.col(split).isin(*shuffled_splits)
    ordered = df.withColumn("_k", F.when(shuffled, sk).otherwise(F.lit(None).cast("string")))
    idx = global_index(ordered, [split, "_k", keep_order, key], "_g", base=0)
    first = idx.groupBy(split).agg(F.min("_g").alias("_first"))  # one row per split
    return (idx.join(F.broadcast(first), split)
            .select(*df.columns, (F.col("_g") - F.col("_first") + 1).alias(name)))


def batch_ids(df: DataFrame, batch_size: int | dict[str, int], pos: str = "pos", base: int = 1,
              name: str = "batch_id", split: str = "split") -> DataFrame:
    """Consecutive rows in batches of ``batch_size``, the last one short.
    With a size per split, ids count within the split: a batch is (split, id)."""
    size = F.lit(batch_size)
    if isinstance(batch_size, dict):
        size = F.create_map(*[F.lit(x) for pair in batch_size.items() for x in pair])[F.col(split)]
    return df.withColumn(name, F.floor((F.col(pos) - F.lit(base)) / size).cast("bigint"))


def shard_ids(df: DataFrame, n_shards: int, batch: str = "batch_id", name: str = "shard") -> DataFrame:
    """Batches dealt round-robin to ``n_shards`` processes."""
    return df.withColumn(name, F.pmod(F.col(batch), F.lit(n_shards)).cast("int"))
