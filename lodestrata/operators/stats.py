"""Percentiles, effect sizes, sample sizes and bootstrap intervals."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut

#: One-sided 95 % and 80 % power.
Z_ALPHA, Z_POWER = 1.6449, 0.8416
#: Draws that are worked out at once, and those that a block of ranks gets from all resamples, about.
DRAWS, DRAWN = 1 << 18, 1 << 22


def ranked(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """`df` with `rank` (from 0, in that order) and `n` (rows) of each group.

    Rows are range-partitioned by group and order, so that a group of any size is dealt
    over the tasks: a rank is the size of the group's ranges before plus the rank inside.
    """
    tagged = cut(df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_b", F.spark_partition_id()))
    sizes = tagged.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_c"))  # a row for each range, and one for each group
    whole = Window.partitionBy(*groups)
    sizes = sizes.withColumn("_above", F.sum("_c").over(whole.orderBy("_b")) - F.col("_c")).withColumn("n", F.sum("_c").over(whole)).drop("_c")
    sizes = sizes.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_b").alias("_gb"), "_above", "n")
    inside = tagged.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*order)))
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(groups)]
    joined = inside.join(sizes, reduce(lambda x, y: x & y, same, F.col("_b") == F.col("_gb")))
    return joined.withColumn("rank", F.col("_above") + F.col("_r") - 1).drop("_b", "_r", "_above", "_gb", *[f"_g{k}" for k in range(len(groups))])


def prefix_sums(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """`df` with `<column>_before`: the sum of whole numbers over all rows before, in that order; by ranges, like ranks."""
    tagged = cut(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = tagged.groupBy("_b").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns)])
    sums = sums.select("_b", *[F.coalesce(F.sum(f"_s{k}").over(earlier), F.lit(0)).alias(f"_e{k}") for k in range(len(columns))])
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = tagged.withColumns({f"_i{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in enumerate(columns)})
    return within.join(sums, "_b").select(*df.columns, *[(F.col(f"_i{k}") + F.col(f"_e{k}")).alias(f"{c}_before") for k, c in enumerate(columns)])


def percentiles(df: DataFrame, groups: list[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """(groups, points): linear interpolation at rank p / 100 * (n - 1) of each group's values. Only ranks meet, no group's values; nulls do not count."""
    rows = ranked(df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL"), groups, [F.col("_v")])

    def point(p: float) -> Column:
        at = F.lit(p / 100.0) * (F.col("n") - 1)
        below = F.max(F.when(F.col("rank") == F.floor(at), F.col("_v")))
        above = F.max(F.when(F.col("rank") == F.ceil(at), F.col("_v")))
        share = F.max(at - F.floor(at))
        return below + (above - below) * share

    return rows.groupBy(*groups).agg(*[point(p).alias(name) for name, p in points.items()])


def with_percentiles(aggregates: DataFrame, df: DataFrame, groups: list[str], points: Mapping[str, tuple[str, float]]) -> DataFrame:
    """`aggregates` (a row for each group) with percentiles {name: (value, p)}."""
    out = aggregates
    for value in dict.fromkeys(v for v, _ in points.values()):
        found = percentiles(df, groups, value, {name: p for name, (v, p) in points.items() if v == value})
        found = found.withColumnsRenamed({g: f"_p{k}" for k, g in enumerate(groups)})
        same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_p{k}")) for k, g in enumerate(groups)])
        out = out.join(found, same, "left").drop(*[f"_p{k}" for k in range(len(groups))])
    return out


def sample_variance(col: Column | str) -> Column:
    return F.coalesce(F.var_samp(col), F.lit(0.0))


def rounded_mean(col: Column | str) -> Column:
    return F.round(F.coalesce(F.avg(col), F.lit(0.0)), 4)


def sizing(df: DataFrame, group: str, delta: str = "delta") -> DataFrame:
    """Overall (group null, overall true) and by group: n, mean, standard deviation, Cohen's d and required n."""
    base = df.rollup(group).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_observed"), F.avg(delta).alias("mean_delta"), F.sqrt(sample_variance(delta)).alias("std_delta")
    )
    flat = (F.col("std_delta") == 0) | (F.col("mean_delta") == 0)
    raw = F.when(~flat, F.pow(F.lit(Z_ALPHA + Z_POWER) * F.col("std_delta") / F.abs("mean_delta"), 2))
    return base.select(
        group, (F.col("_g") == 1).alias("overall"), "n_observed", "mean_delta", "std_delta", F.try_divide("mean_delta", F.nullif("std_delta", F.lit(0.0))).alias("cohens_d"),
        raw.alias("n_required_raw"), F.ceil(raw).alias("n_required"), flat.alias("degenerate"),
    )


def resample_means(df: DataFrame, group: str, order: str, delta: str, resamples: int, seed: int) -> DataFrame:
    """(group, r, mean): hash-indexed resamples with replacement.

    Draws are worked out DRAWS at a time, dealt over all tasks, and cross as two bytes each: the
    places in a block of ranks that a resample takes. A block's deltas meet their draws in one
    task, some DRAWN of them, so that neither a group's deltas nor its draws stand in one place.
    """
    rows = cut(ranked(df.select(group, order, F.col(delta).cast("double").alias("_v")), [group], [F.col(order)]).select(group, "rank", "_v", "n"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    block, kind = max(1, min(1 << 16, DRAWN // resamples)), df.schema[group].dataType.simpleString()
    items = (sizes.agg(F.sum(F.ceil(F.col("_n") / DRAWS))).first()[0] or 0) * resamples
    parts = sizes.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(DRAWS).cast("long"))))
    parts = parts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    parts = parts.repartition(max(1, min(items, 4 * df.sparkSession.sparkContext.defaultParallelism)))  # few small rows, each much work: a number, as AQE would join them to one task

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for b in batches:
            for k, (n, first, r) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_n", "_from", "r")))):
                head = b"%d:%d:" % (seed, r)
                digests = b"".join([md5(head + b"%d" % i, usedforsecurity=False).digest()[:4] for i in range(first, min(n, first + DRAWS))])
                rank = np.sort(np.frombuffer(digests, ">u4").astype(np.int64) % n)
                blocks, starts = np.unique(rank // block, return_index=True)
                places = (rank % block).astype("<u2")
                taken = pa.array([x.tobytes() for x in np.split(places, starts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(group).take(pa.array([k] * len(blocks))), pa.array(blocks, pa.int64()), pa.array([r] * len(blocks), pa.int32()), taken], [group, "_k", "r", "_at"])

    def meet(key: tuple[pa.Scalar, ...], draws: pa.Table, values: pa.Table) -> pa.Table:
        at = values.column("rank").to_numpy() % block
        known = values.column("_v").is_valid().to_numpy()
        v, valid = np.zeros(block), np.zeros(block, np.int64)
        v[at[known]], valid[at[known]] = values.column("_v").drop_null().to_numpy(), 1
        taken = draws.column("_at").to_pylist()
        places = np.frombuffer(b"".join(taken), "<u2")
        starts = np.cumsum([0, *(len(x) // 2 for x in taken[:-1])])[: len(taken)]
        r, back = np.unique(draws.column("r").to_numpy(), return_inverse=True)
        total, found = (np.bincount(back, np.add.reduceat(x[places], starts) if len(taken) else [], len(r)) for x in (v, valid))
        return pa.table([pa.array([key[0].as_py()] * len(r), draws.schema.field(group).type), pa.array(r, pa.int32()), pa.array(total, pa.float64()), pa.array(found, pa.float64())], [group, "r", "_s", "_c"])

    drawn = parts.mapInArrow(draw, f"`{group}` {kind}, _k long, r int, _at binary")
    values = rows.select(group, F.floor(F.col("rank") / block).cast("long").alias("_k"), F.col("rank").cast("long").alias("rank"), "_v")
    met = drawn.groupBy(group, "_k").cogroup(values.groupBy(group, "_k")).applyInArrow(meet, f"`{group}` {kind}, r int, _s double, _c double")
    sums = met.groupBy(group, "r").agg(F.when(F.sum("_c") > 0, F.sum("_s")).alias("_s")).withColumnRenamed(group, "_g")
    return sums.join(sizes, F.col("_g").eqNullSafe(F.col(group))).select(group, "r", (F.col("_s") / F.col("_n")).alias("mean"))


def bootstrap(df: DataFrame, group: str, order: str = "id", delta: str = "delta", resamples: int = 200, seed: int = 7, confidence: float = 0.95, bounds: str = "linear") -> DataFrame:
    """Percentile bootstrap of each group's mean. bounds: "linear" interpolates, "order" takes order statistics. What meets in a group is its `resamples` means."""
    df = cut(df.select(group, order, delta))  # read for ranges, ranks and the observed means: not worked out thrice
    means = resample_means(df, group, order, delta, resamples, seed)
    low = (1 - confidence) / 2
    if bounds == "linear":
        cis = means.groupBy(group).agg(F.percentile("mean", F.lit(low)).alias("ci_low"), F.percentile("mean", F.lit(1 - low)).alias("ci_high"))
    else:
        sorted_ = F.array_sort(F.collect_list("mean"))
        cis = means.groupBy(group).agg(
            F.element_at(sorted_, int(low * resamples) + 1).alias("ci_low"), F.element_at(sorted_, int((1 - low) * resamples)).alias("ci_high")
        )
    observed = df.groupBy(group).agg(F.avg(delta).alias("mean_delta"), F.count(F.lit(1)).alias("n_items"))
    return observed.join(cis, group).withColumn("not_negative", F.col("ci_low") >= 0)


def seeded_bootstrap(df: DataFrame, group: str, order: str = "id", delta: str = "delta", resamples: int = 1000, seed: int = 7, confidence: float = 0.95) -> DataFrame:
    """The same interval with CPython's seeded generator, one group a task: for parity with published runs on exam-sized groups."""
    kind = df.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[delta].tolist()
        rng, n = random.Random(seed), len(values)
        means = sorted(sum(values[int(rng.random() * n)] for _ in range(n)) / n for _ in range(resamples))

        def at(p: float) -> float:
            k = p * (len(means) - 1)
            i = int(k)
            return means[i] + (means[min(i + 1, len(means) - 1)] - means[i]) * (k - i)

        low = (1 - confidence) / 2
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean_delta": [sum(values) / n], "ci_low": [at(low)], "ci_high": [at(1 - low)], "n_items": [n]})

    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, mean_delta double, ci_low double, ci_high double, n_items long")


def distributions(df: DataFrame, metrics: list[str], scope: str) -> DataFrame:
    """p50, p90, p95 and mean of each metric in each scope."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = cut(df.select(scope, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")))
    means = long.groupBy(scope, "metric").agg(F.avg("value").alias("mean"))
    points = {"p50": ("value", 50), "p90": ("value", 90), "p95": ("value", 95)}
    return with_percentiles(means, long, [scope, "metric"], points).select(scope, "metric", "p50", "p90", "p95", "mean")


def drop_top(df: DataFrame, metric: str, fraction: float, id_col: str = "id") -> DataFrame:
    """`df` with `dropped`: the ceil(fraction * n) rows with the largest (metric, id), and `threshold`: the largest metric that stays (null if none does)."""
    rows = ranked(df.withColumn("_all", F.lit(0)), ["_all"], [F.desc(metric), F.desc(id_col)])
    cutoff = F.ceil(F.lit(float(fraction)) * F.col("n"))
    marked = cut(rows.withColumn("dropped", F.col("rank") < cutoff).withColumn("_edge", F.when(F.col("rank") == cutoff, F.col(metric))))
    edge = marked.agg(F.max("_edge").alias("threshold"))
    return marked.drop("_all", "rank", "n", "_edge").crossJoin(F.broadcast(edge))  # one row
