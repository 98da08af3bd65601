"""Skew-safe equi-join of a big table with a per-key table (salting).

Any key may hold a large share of the big side (one sample delivered a
billion times, one image shared by most samples, the most frequent token,
or NULL where an id is missing).  A sort-merge join would put all of that
key's rows into one task, and AQE's skew-join split does not apply when the
small side comes straight out of an aggregate.  So hot keys are salted
explicitly:

1. per-key row counts of the big side (a partial + final aggregate, so a
   hot key collapses map-side) - often already at hand (group statistics,
   vocabulary counts);
2. N = total rows (a scalar subquery over the counts); a key is hot when it
   holds more than N / (4 P) rows, P = shuffle partitions.  At most 4 P
   keys can be hot, so the hot-key table is broadcast with a size bound
   that holds by construction;
3. each hot key gets ceil(n / (N / 4P)) salt buckets; big-side rows of a
   hot key take bucket ``salt mod buckets``; the small side's row of a hot
   key is replicated once per bucket (at most about 8 P extra rows in all).
   NULL keys match nothing and are simply dealt to P buckets;
4. the join runs on (key, bucket): a hot key is split over many tasks.

The salt reads no column but those it names, so the big side's scan stays
pruned, and nothing is sorted.  A re-run of a lost task must give each row
the bucket it had: a salt of columns always does; ``position()`` does if
the big side comes from files by narrow steps (write it first otherwise).

Cold keys keep bucket 0 and join exactly as before.  Works for inner,
left, left_semi and left_anti joins; for the first two the small side must
have at most one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
BUCKETS = "_buckets"


def position() -> Column:
    """A row's place in its file split: spreads identical rows too."""
    return F.monotonically_increasing_id()


def content(*columns: str) -> Column:
    """A hash of columns that tell a hot key's rows apart."""
    return F.xxhash64(*columns)


def hot_keys(counts: DataFrame, key: str, n: str = "n", parts: int | None = None,
             share: int = 4) -> DataFrame:
    """Keys holding more than N / (share * parts) rows, with their bucket
    count.  At most ``share * parts`` rows by construction."""
    spark = counts.sparkSession
    p = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = counts.select(F.sum(F.col(n).cast("double"))).scalar()
    limit = F.greatest(total / F.lit(float(share * p)), F.lit(1.0))
    return (counts.where(F.col(key).isNotNull() & (F.col(n).cast("double") > limit))
            .select(key, F.ceil(F.col(n).cast("double") / limit).cast("int").alias(BUCKETS)))


def salted_join(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, how: str = "inner",
                n: str = "n", parts: int | None = None, salt: Column | None = None) -> DataFrame:
    """``big.join(small, key, how)`` with hot keys of ``big`` split across
    tasks.  ``counts`` holds (key, n) = rows per key of ``big`` (an upper
    bound is fine); ``salt`` defaults to ``position()``."""
    p = parts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(counts.select(key, n), key, n, p))
    salted = big.select("*", (position() if salt is None else salt).alias(SALT)).join(hot, key, "left")
    buckets = F.when(F.col(key).isNull(), F.lit(p)).otherwise(F.coalesce(F.col(BUCKETS), F.lit(1)))
    b = salted.select(*[F.col(c) for c in big.columns], F.pmod(F.col(SALT), buckets.cast("long")).cast("int").alias(SALT))
    s = small.join(hot, key, "left")
    s = s.select(*[F.col(c) for c in small.columns],
                 F.explode(F.sequence(F.lit(0), F.coalesce(F.col(BUCKETS), F.lit(1)) - 1)).alias(SALT))
    joined = b.join(s, [key, SALT], how)
    return joined.drop(SALT)


def key_counts(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Rows per key (partial aggregation first, so hot keys are cheap)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
