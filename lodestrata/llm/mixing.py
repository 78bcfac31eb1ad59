"""Mix sources to target weights.

Words are totalled per source, targets come from the weights by water-filling
under a cap of `max_repeat` times the source's size, and each document is emitted
floor(rate) times plus once more with probability equal to the fraction, by a
draw that is a hash of seed and id: reruns and retries agree.

Per-source totals (one row a source) are ranked over ranges; documents are read twice
and not shuffled while the sources, which are counted, can be broadcast. Defined results: a null text has size 0; a null
source is a source of its own, ordered last; sources without words get target 0;
rows that repeat an id share its draw; very long texts count whole; a draw equal to the
fraction takes no copy; an empty table gives an empty table; other columns are passed
through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import prefix_sums, ranked
from .common import BROADCAST_ROWS, NON_SPACES, cut, quoted

WEIGHTS, MAX_REPEAT, SEED, SALTS = (5, 2, 1), 3, "mix", 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACES)), F.lit(0)).cast("long")


def draw(id_col: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Water-filling in closed form: with sources by cap/weight, the first k that
    reach their cap are those whose level, if they were left uncapped, is above
    it; the rest share what is left by weight. Integer prefix sums make it exact.
    Ranks and prefix sums are taken over ranges, so that no task sees all sources.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_name = ranked(sizes.select("source", "source_size"), [], [F.col("source").asc_nulls_last()])
    weighed = by_name.select("source", "source_size", F.col("rank").alias("_r"), w.cast("long").alias("_w"), (F.col("source_size") * max_repeat).alias("_c")).withColumn("_k", F.col("_c") / F.col("_w"))
    before = prefix_sums(weighed, [F.col("_k"), F.col("_r")], ["_c", "_w"])
    sums = before.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_weights"))  # one row
    level = (F.col("_all") - F.col("_c_before")).cast("double") / (F.col("_weights") - F.col("_w_before")).cast("double")
    levelled = cut(before.crossJoin(F.broadcast(sums)).withColumn("_level", level))
    least = levelled.agg(F.min(F.when(F.col("_level") <= F.col("_k"), F.struct("_k", "_r", "_level"))).alias("_m"))  # one row
    share = F.least(F.col("_c").cast("double"), F.col("_m._level") * F.col("_w").cast("double"))
    return levelled.crossJoin(F.broadcast(least)).select("source", "source_size", F.coalesce(share, F.lit(0.0)).alias("target"))


def plan_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
) -> DataFrame:
    """`df` with __ls_size, __ls_source_size, __ls_target and __ls_copies. Counts the sources (one job) to choose the join."""
    sized = df.withColumn("__ls_size", n_words(F.col(text_col)))
    totals = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("__ls_size").alias("source_size"))
    targets = source_targets(totals, weights, max_repeat).select(
        F.col("source").alias("__ls_source"), F.col("source_size").alias("__ls_source_size"), F.col("target").alias("__ls_target")
    )
    n_sources = df.select(source_col).distinct().count()
    rate = F.when(F.col("__ls_source_size") > 0, F.col("__ls_target") / F.col("__ls_source_size").cast("double")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col(id_col), seed) < rate - F.floor(rate)).cast("long")
    same = F.col(source_col).eqNullSafe(F.col("__ls_source"))
    if n_sources > BROADCAST_ROWS:  # too many to broadcast: a source of a third of all rows is dealt over the salts
        targets = targets.withColumn("__ls_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn("__ls_own", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        joined = sized.join(targets, same & (F.col("__ls_own") == F.col("__ls_salt"))).drop("__ls_own", "__ls_salt")
    else:
        joined = sized.join(F.broadcast(targets), same)
    return joined.drop("__ls_source").withColumn("__ls_copies", copies)


def emit_mix(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of `df`, each document as often as the mix takes it."""
    planned = plan_mix(df, **options)
    times = F.explode(F.array_repeat(F.lit(0), F.col("__ls_copies").cast("int"))).alias("__ls_i")
    return planned.select(*quoted(df.columns), times).select(*quoted(df.columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    planned = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return planned.select(
        "doc_id",
        F.col("__ls_size").alias("size"),
        F.col("__ls_source_size").alias("source_size"),
        F.col("__ls_target").alias("target"),
        (F.col("__ls_size") * F.col("__ls_copies")).alias("taken"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((r - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS c FROM s),
l AS (SELECT *, c::DOUBLE / w AS k,
        (sum(source_size) OVER () - coalesce(sum(c) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lvl
      FROM w WINDOW b AS (ORDER BY c::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(c::DOUBLE,
        (SELECT lvl FROM l WHERE lvl <= k ORDER BY k, r LIMIT 1) * w::DOUBLE), 0.0) AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM j
"""
