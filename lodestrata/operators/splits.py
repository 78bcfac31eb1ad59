"""Leak-free splits by content fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVAL, TRAIN = "eval", "train"


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key (journals: the last write wins)."""
    return first_of(df, keys, [F.col(order).desc()])


#: Fingerprint prefixes of this many hex digits make the ranges that are ranked apart.
PREFIX = 3


def range_rank(df: DataFrame, groups: list[str], digest: str, ties: list[str] | None = None) -> DataFrame:
    """`df` with `rank` (from 1, in order of a hexadecimal digest) and `n` (rows) of each group.

    A rank is the number of rows in earlier digest ranges plus the rank within a
    range, so that a group with most of the rows is not sorted in one task.
    """
    tagged = df.withColumn("_p", F.substring(digest, 1, PREFIX))
    sizes = tagged.groupBy(*groups, "_p").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.withColumn("_before", F.sum("_c").over(Window.partitionBy(*groups).orderBy("_p")) - F.col("_c")).withColumn("n", F.sum("_c").over(Window.partitionBy(*groups)))
    inside = tagged.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_p").orderBy(digest, *(ties or []))))
    return inside.join(sizes.drop("_c"), [*groups, "_p"]).withColumn("rank", F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def half_split(df: DataFrame, subset: str = "subset", fp: str = "fp") -> DataFrame:
    """(subset, fp, rank, n, half): of each subset's n distinct fingerprints in order, the first ceil(n / 2) are eval."""
    ranked = range_rank(df.select(subset, fp).distinct(), [subset], fp)
    return ranked.select(subset, fp, "rank", "n", F.when(F.col("rank") <= F.ceil(F.col("n") / 2), EVAL).otherwise(TRAIN).alias("half"))


def boundary(split: DataFrame, subset: str = "subset") -> DataFrame:
    """Per subset: sizes of both halves and the smallest train fingerprint (null if there is none)."""
    return split.groupBy(subset).agg(
        F.count_if(F.col("half") == EVAL).alias("eval_half"), F.count_if(F.col("half") == TRAIN).alias("train_half"), F.min(F.when(F.col("half") == TRAIN, F.col("fp"))).alias("boundary")
    )


def sample_per_subset(df: DataFrame, k: int, seed: int, subset: str = "subset", fp: str = "fp") -> DataFrame:
    """k rows of each subset without replacement, by a hash of seed and fingerprint (a rank limit is pushed below the shuffle)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(fp)), 256)
    w = Window.partitionBy(subset).orderBy("_o", fp)
    return df.withColumn("_o", order).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn", "_o")


def overlap(train: DataFrame, golden: DataFrame, fp: str = "fp") -> DataFrame:
    """Rows of both sides that share a fingerprint: must be empty."""
    return train.join(golden.filter(F.col(fp).isNotNull()), fp)


def without(train: DataFrame, golden: DataFrame, fp: str = "fp") -> DataFrame:
    return train.join(golden.select(fp).distinct(), fp, "left_anti")


def outside(sample: DataFrame, whole: DataFrame) -> DataFrame:
    """(subset, fp) of sampled rows that the whole does not have: must be empty."""
    return sample.select("subset", "fp").exceptAll(whole.select("subset", "fp"))
