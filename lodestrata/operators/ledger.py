"""Replay of paid calls: append-only journal, latest record per key, hit and miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import last_of


def latest(journal: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return last_of(journal, keys, pos)


def replay(items: DataFrame, ledger: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """`items` with the recorded answer where key and payload agree: source is reused or fresh. Payloads are compared by hash, so long texts do not shuffle; a null payload never matches."""
    digest = lambda df: F.sha2(df[payload], 256)
    known = ledger.select(*keys, digest(ledger).alias("_h"), F.col("answer").alias("replayed"))
    joined = items.withColumn("_h", digest(items)).join(known, [*keys, "_h"], "left").drop("_h")
    return joined.withColumn("source", F.when(F.col("replayed").isNotNull(), "reused").otherwise("fresh"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_h", F.sha2("payload", 256))


def _same(originals: bool) -> str:
    """A call is known by kind, item, level and payload; an original also by its item alone, where its payload was not recorded."""
    return "kind = _k AND item = _i AND level <=> _l AND (_h = _g" + (" OR (kind = 'original' AND _g IS NULL))" if originals else ")")


def found(wanted: DataFrame, journal: DataFrame) -> DataFrame:
    """`wanted` (kind, item, level, payload, ...) with the answer, scores and served model that the journal has; null where it has none."""
    known = _keyed(journal).select(F.col("kind").alias("_k"), F.col("item").alias("_i"), F.col("level").alias("_l"), F.col("_h").alias("_g"), "answer", "scores", "served")
    known = known.groupBy("_k", "_i", "_l", "_g").agg(F.min(F.struct("answer", "scores", "served")).alias("r"))
    joined = _keyed(wanted).join(known, F.expr(_same(True)), "left")
    best = joined.groupBy(*[c for c in wanted.columns]).agg(F.min(F.when(F.col("r").isNotNull(), F.struct(F.col("_g").isNull().alias("loose"), "r"))).alias("m"))
    return best.select(*wanted.columns, "m.r.answer", "m.r.scores", "m.r.served")


def misses(wanted: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows of `wanted` that the journal does not answer."""
    known = _keyed(journal).select(F.col("kind").alias("_k"), F.col("item").alias("_i"), F.col("level").alias("_l"), F.col("_h").alias("_g"))
    return _keyed(wanted).join(known, F.expr(_same(True)), "left_anti").drop("_h")


def accounting(calls: DataFrame, *keys: str) -> DataFrame:
    """Counts come from the data, not from accumulators, which retried tasks would raise twice."""
    return calls.groupBy(*keys).agg(F.count_if(F.col("source") == "fresh").alias("fresh"), F.count_if(F.col("source") == "reused").alias("reused"))


def conflicts(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys whose rows disagree."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("versions")).filter("versions > 1")
